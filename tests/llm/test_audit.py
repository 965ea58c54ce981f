"""Filter audit against a plain walk through all orders."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from cuewise.llm import audit
from tests.llm import plain

MARKED = "a sign & more"


def rows_with_all():
    rng = random.Random(5)
    rows = plain.corpus(40)
    rows += [(300 + i, ("WORD " * (i * 7) + plain.speech(rng, 60, plain.EN)) + (MARKED if i % 2 else ""), "en", f"src{i % 3}") for i in range(12)]
    rows += [(400 + i, "one text, many copies", "en", "hot") for i in range(60)]
    rows += [(5, "one text, many copies", "en", "hot"), (5, "one text, many copies", "en", None), (None, "one text, many copies", "en", "hot")]
    rows += [(None, None, None, ""), (None, "only without id", "en", "src1"), (None, "only without id", "en", "src1"), (700, "\x1c\x85 ", "en", "src1"), (701, "É" * 30 + "A", "en", "é")]
    return rows


def labels_of(rows):
    rng = random.Random(6)
    out = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if r[0] is not None and r[0] % 3]
    return out + [(out[0][0], 1, 1), (99_999, 1, 1), (None, 1, 1)]


def fails(rows):
    texts = {}
    for i, text, _, _ in rows:
        if i is not None:
            texts[text or ""] = min(texts.get(text or "", i), i)
    for i, text, _, source in rows:
        t = text or ""
        w = plain.words(t)
        out = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        out += "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and texts[t] < i)
        yield i, source or "", set(out)


def walked(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = list(fails(rows))
    out = {}
    for order in permutations("ABCDE"):
        for i, part, bad in docs:
            gone = False
            for k, f in enumerate(order):
                c = out.setdefault((part, "".join(order), k + 1), Counter())
                if f in bad:
                    c["redundant" if gone else "removed"] += 1
                    c["unique_fails"] += bad == {f}
                    if not gone:
                        c["good_lost"] += i in good
                        c["toxic_lost"] += i in toxic
                    gone = True
                c["kept"] += not gone
    share = Counter()
    for (part, order, k), c in out.items():
        share[part, order[k - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*key, *[c[n] for n in names], share[key[0], key[1][key[2] - 1]]) for key, c in out.items())


@pytest.mark.parametrize("most_bits", [audit.MOST_BITS, 0])
def test_audit(spark, most_bits):
    """With the sketch, and with the shuffle of hashes that stands in for a sketch too large to broadcast."""
    rows = rows_with_all()
    labels = labels_of(rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS good", "1 AS doc")
    docs = plain.table(spark, rows).selectExpr("*", "'x' AS part", "1 AS h", "1 AS maybe", "1 AS doc", "'x' AS firsts")
    got = audit.audited(docs.repartition(7), known, most_bits=most_bits)
    assert sorted(map(tuple, got.collect())) == walked(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(plain.table(spark, []), none).count() == 0
    got = audit.audited(plain.table(spark, [(1, None, None, None)]), none).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and all(r.shapley == (120 if r.filter_order[r.step - 1] == "A" else 0) for r in got)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "same", "s"), ("a", "same", "s")], "doc_id string, text string, source string")
    got = audit.audited(docs, spark.createDataFrame([("b", 1, 1)], "doc_id string, quality int, toxic int")).where("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.removed, r.good_lost, r.toxic_lost) for r in got] == [(1, 1, 1)]


def test_sketch_clears_single_texts_only(spark):
    """No repeated hash is cleared, whatever the number of tasks, and few others stay."""
    rng = np.random.default_rng(3)
    single, twice = rng.integers(-(1 << 63), 1 << 63, 3000), rng.integers(-(1 << 63), 1 << 63, 50)
    hashes = [(int(h),) for h in [*single, *np.repeat(twice, 400)]]
    df = spark.createDataFrame(hashes, "h long").repartition(11)
    flagged = {r.h: r.maybe for r in audit.with_maybe(df)(df).distinct().collect()}
    assert all(flagged[int(h)] for h in twice)
    assert sum(flagged[int(h)] for h in single) < 60
