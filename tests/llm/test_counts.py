"""Quality rules and mixing against plain versions, with nulls, empty and long texts, repeats and clashing names."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cuewise.llm import mixing, quality_rules
from tests.llm import plain


def labels(spark, ids, quality=1):
    return spark.createDataFrame([(i, quality) for i in ids], "doc_id long, quality int")


def test_quality_counts(spark):
    rows = plain.corpus() + [(900, "a b c a b c x\n\nq w\nq w\n a#$|", "en", "s"), (901, "x x x x x", "en", "s")]
    got = quality_rules.scored(plain.table(spark, rows), labels(spark, range(0, 40)), doc_id=F.col("doc_id"), source=F.col("source")).collect()
    assert len(got) == len(rows)
    want = []
    for i, text, _, source in rows:
        w, t = plain.words(text), text or ""
        lines = [x for x in t.split("\n") if plain.words(x)]
        n = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), plain.repeat_words(w))
        want.append((i, source, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.source, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_ratio(spark):
    """The ratio itself, bucket by bucket, and that it tells junk from ordinary texts."""
    rows = plain.corpus(150)
    junk = [(1000 + i, " ".join(w + "&&&" for w in plain.words(r[1])), "en", "s") for i, r in enumerate(rows[:40])]
    docs = plain.table(spark, rows + junk)
    got = {r.doc_id: r for r in quality_rules.scored(docs, labels(spark, range(0, 140)), smooth=2.0, doc_id=F.col("doc_id")).collect() if r.doc_id is not None}
    clean = [got[i].llr for i in range(140)]
    assert min(clean) > max(got[1000 + i].llr for i in range(40))
    empty = quality_rules.log_ratios(docs, labels(spark, []), 64, 1.0)
    assert empty == [0.0] * 64


def test_quality_empty(spark):
    assert quality_rules.scored(plain.table(spark, []), labels(spark, []), doc_id=F.col("doc_id")).count() == 0


def test_mixing_equals_sql(spark):
    rows = plain.corpus()
    got = mixing.taken(plain.table(spark, rows)).collect()
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, plain.SCHEMA).toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(mixing.SQL).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc, r.source, r["size"], r.source_size, r.target, r.taken) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(n == round(t) for n, t in by.values())


def test_mixing_goal(spark):
    """Shares stop at three times the size; the rest goes by weight to those below."""
    rows = [(1, "a " * 10, None, "a"), (2, "b " * 500, None, "b"), (3, "c " * 500, None, None), (4, None, None, "d")]
    goal = {r.src: r.target for r in mixing.targets(mixing.sized(plain.table(spark, rows))).collect()}
    assert goal["a"] == 30 and goal["d"] == 0
    assert goal["b"] + goal[None] + 30 == pytest.approx(1010)
    assert goal[None] == pytest.approx(980 * 5 / 7)


def test_mixing_blocks(spark):
    """Every slot is filled, from the right source, and blocks of one turn don't repeat."""
    rows = mixing.sized(plain.table(spark, plain.corpus()))
    goal = mixing.targets(rows)
    mix = mixing.mixture(rows, goal, block=16, shard=8).collect()
    slots = mixing.slots(goal, 16, 8, 7).collect()
    assert len({(r.shard, r.place) for r in slots}) == len(slots)
    assert sorted(r.shard * 8 + r.place for r in slots) == list(range(len(slots)))
    assert sum(r.words for r in mix) == sum(round(r.target) for r in goal.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 256])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))


def test_mixing_empty(spark):
    assert mixing.taken(plain.table(spark, [])).count() == 0
    assert mixing.taken(plain.table(spark, [(1, None, None, None)])).collect()[0].taken == 0
