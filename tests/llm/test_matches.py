"""Jaccard join, decontamination and substring dedup against plain versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cuewise.llm import common, decontamination, jaccard, passages
from tests.llm import plain

KEY = lambda r: tuple(map(str, r))


@pytest.mark.parametrize("small,block", [(64, 1 << 20), (1, 300)])
def test_jaccard(spark, small, block):
    rows = plain.corpus()
    got = jaccard.linked_components(plain.table(spark, rows), small=small, block=block).collect()
    want = [(r[0], len(plain.shingles(r[1])), c) for r, c in zip(rows, plain.classes(rows))]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=KEY) == sorted(want, key=KEY)


def test_jaccard_near_group(spark):
    """A group of near copies around the limit, where linked texts are linked through others only."""
    import random

    rng = random.Random(5)
    base = plain.speech(rng, 120, plain.EN).split(" ")
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    for small, block in ((64, 1 << 20), (8, 2000)):
        got = {r.doc_id: r.component_id for r in jaccard.linked_components(plain.table(spark, rows), small=small, block=block).collect()}
        assert [got[i] for i in range(90)] == plain.classes(rows)


def test_jaccard_empty(spark):
    assert jaccard.linked_components(plain.table(spark, [])).count() == 0
    got = jaccard.linked_components(plain.table(spark, [(3, None, None, None), (2, "", None, None), (4, "", None, None)])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(3, 0, 3), (2, 0, 2), (4, 0, 4)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 140))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def items(rows):
    w = plain.folded(rows[6][1])
    return [(1, " ".join(w[10:40])), (2, " ".join(w[20:24])), (3, "nowhere to be found in any of these texts at all ok"), (4, None), (5, "!!"), (6, "WORD"), (7, "er er"), (10, " ".join(w[10:40]))]


def overlap(rows, tests):
    out = []
    texts = [(i, plain.folded(t)) for i, t in tests]
    for i, text, *_ in rows:
        w = plain.folded(text)
        hit, ids = set(), set()
        for item, t in texts:
            n = min(10, len(t))
            for k in range(len(t) - n + 1) if t else ():
                for p in range(len(w) - n + 1):
                    if w[p] == t[k] and w[p : p + n] == t[k : k + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most", [200_000, 4])
def test_decontamination(spark, most):
    rows = [r for r in plain.corpus() if len(r[1] or "") < 10_000]
    tests = items(rows)
    bench = spark.createDataFrame(tests, "item_id long, text string")
    got = decontamination.overlap(plain.table(spark, rows), bench, most=most).collect()
    assert sorted((tuple(r) for r in got), key=KEY) == sorted(overlap(rows, tests), key=KEY)
    bad = {r._id for r in decontamination.contaminated(plain.table(spark, rows), bench).collect()}
    assert bad == {r[0] for r in got if r[5]}


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.overlap(plain.table(spark, plain.corpus()[:5]), none).collect()
    assert len(got) == 5 and not any(r.contaminated for r in got)
    assert decontamination.overlap(plain.table(spark, []), none).count() == 0


def test_proximity(spark):
    rows = [(1, "alpha x beta y gamma z", None, None), (2, "alpha " + "x " * 90 + "beta gamma", None, None), (3, None, None, None)]
    bench = spark.createDataFrame([(1, "gamma beta alpha")], "item_id long, text string")
    docs = plain.table(spark, rows).select(F.col("doc_id").alias("d"), decontamination.folded_words(F.col("text")).alias("w"))
    got = decontamination.near_matches(docs, bench, doc=["d"], within=10, share=1.0)
    assert {r.d for r in got.collect()} == {1}


def test_passages(spark):
    """All documents that share 51 words or more, and none that don't share a paragraph or a window."""
    rows = [r for r in plain.corpus() if r[0] is not None]
    found = passages.repeats(plain.table(spark, rows)).collect()
    first, long_, short = {}, set(), set()
    for size, into in ((51, long_), (20, short)):
        first.clear()
        for i, t, *_ in rows:
            w = plain.words(plain.low(t))
            for a in range(len(w) - size + 1):
                j = first.setdefault(tuple(w[a : a + size]), i)
                if j != i:
                    into.update((i, j))
    near = {r[0] for r in rows if r[0] in range(60, 66)} | {1}
    got = {r.doc for r in found}
    assert long_ <= got <= short | near
    kept = {(r["class"], r.line): 0 for r in found}
    for r in found:
        kept[r["class"], r.line] += not r.removed
    assert set(kept.values()) == {1}


def test_paragraphs_verified(spark):
    """Paragraphs alike by 0.8 or more are found and others are not, as by comparing all pairs."""
    import random

    rng = random.Random(9)
    base = plain.speech(rng, 60, plain.EN).split(" ")
    rows = []
    for i in range(30):
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(27, 33)] = f"new{rng.randrange(10**6)}"
        rows.append((i, plain.speech(rng, 3, plain.EN) + "\n" + " ".join(w), "en", "s"))
    rows.append((99, plain.speech(rng, 60, plain.DE), "de", "s"))
    sets = [plain.shingles(r[1].split("\n")[-1], 5) for r in rows]
    alike = {r[0] for r, a in zip(rows, sets) if sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) > 1}
    got = {r.doc for r in passages.repeats(plain.table(spark, rows)).where("line").collect()}
    assert got == alike


def test_passages_empty(spark):
    assert passages.repeats(plain.table(spark, [])).count() == 0
    assert passages.repeats(plain.table(spark, [(1, None, None, None), (2, "", None, None)])).count() == 0


def test_tuning():
    bands, rows = passages.tuned(0.8, 0.97)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.97 and bands * rows <= 20


def test_passages_short_wrapped_and_without_id(spark):
    """Short texts, blocks of short lines and rows without id have units; one row per document says its classes."""
    import random

    rng = random.Random(12)
    verse = lambda n: "\n".join(plain.speech(rng, 6, plain.EN) for _ in range(n))
    wrapped = verse(12).split("\n")
    other = [*wrapped[:-1], plain.speech(rng, 6, plain.EN)]  # 62 of 74 shingles alike, no line of 20 words
    parts = "\n\n".join(plain.speech(rng, 3, plain.EN) for _ in range(4))
    texts = {1: "one two three four five", 2: "ONE two three  four five", 3: verse(3) + "\n\n" + "\n".join(wrapped[3:6]), 4: verse(2) + "\n \n" + "\n".join(wrapped[3:6]),
             5: parts, 6: parts, 7: "\n".join(wrapped), 8: "\n".join(other), 9: plain.speech(rng, 90, plain.DE), 10: None, 11: "four words are none"}
    rows = [(i, t, "en", "s") for i, t in texts.items()] + [(None, plain.speech(rng, 3, plain.EN) + "\n\n" + texts[1], "en", "s")] * 2 + [(None, plain.speech(rng, 40, plain.DE), "de", "s")]
    got = passages.classified(plain.table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(set(by[a].class_ids) & set(by[b].class_ids) for a, b in ((1, 2), (3, 4), (5, 6), (7, 8)))
    assert all(by[i].n_classes == 0 and by[i].class_ids == [] and by[i].repeated_words == 0 for i in (9, 10, 11))
    assert by[1].removed_words == 0 and by[2].removed_words == 5
    alone = [r for r in got if r.doc_id is None]
    assert sorted(bool(set(r.class_ids) & set(by[1].class_ids)) for r in alone) == [False, True, True]
    # the two equal rows without id are documents of their own: all of the second goes, of the first what stands elsewhere
    assert sorted(r.removed_words for r in alone) == [0, 5, 8]


def test_bands_lose_no_links():
    import inspect

    bands, rows = passages.tuned(0.8, inspect.signature(passages.repeats).parameters["recall"].default, 40)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_unit_hashes_are_made_one_at_a_time():
    """The bands of a text of 60,000 words must not stand side by side in memory."""
    import tracemalloc

    read = passages.Reader(*passages.tuned(0.8, 0.9999, 40))
    text = "\n".join(" ".join(f"w{i % 977}x{j}" for j in range(30)) for i in range(2000))
    read.units(["a b c d e f"])
    tracemalloc.start()
    own, keys, *_ = read.units([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) > 13 * 2000 and most < 30_000_000
    assert int(read.words([b"word"])[0]) == passages.xxhash.xxh3_64_intdigest(b"word")


def test_candidates_hand_on_pairs_within_a_batch():
    """A batch of lists of 64 texts has 315,000 pairs; they must not stand side by side in memory."""
    import tracemalloc

    import pandas as pd

    class Index:
        repartition = sortWithinPartitions = lambda self, *by: self
        mapInPandas = lambda self, run, schema: run

    shared = [s for s in range(156) for _ in range(64)]
    batch = pd.DataFrame({"shingle": shared + [999] * 16, "fp": range(10_000), "n": 1})
    more = pd.DataFrame({"shingle": 999, "fp": range(10_000, 70_000), "n": 1})
    run = jaccard.candidates(Index(), 80)
    tracemalloc.start()
    most = max(len(rows) for rows in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 20_000 + 64 * 63 // 2 and peak < 12_000_000
    pairs, stars = [], 0
    for rows in run(iter([batch])):
        pairs += zip(rows["a"].tolist(), rows["b"].tolist())
    want = [(s * 64, s * 64 + 64) for s in range(156)] + [(9_984, 10_000)]
    assert pairs == [(a, b) for lo, hi in want for a in range(lo, hi) for b in range(a + 1, hi)]
    # a list that goes on over batches
    for rows in run(iter([batch.tail(16), *(more[k : k + 10_000] for k in range(0, 60_000, 10_000))])):
        assert rows["na"].isna().all() and (rows["a"] == 9_984).all() and len(rows) <= 30_000
        stars += rows["b"].nunique()
    assert stars == 16 + 60_000 - 1
