"""The pipeline against plain versions of its stages, on a small fixture and on edge cases."""

import duckdb
import pytest

import corpus_pipeline
from cuewise.llm import mixing
from tests.llm import plain
from tests.llm.test_matches import KEY, items, overlap


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with ordinary texts, copies, junk, benchmark passages and secrets."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = __import__("random").Random(8)
    rows = [r for r in plain.corpus(120) if len(r[1] or "") < 10_000]
    rows += [(2000 + i, " ".join(w + "&&&" for w in plain.words(r[1])), "en", "src1") for i, r in enumerate(rows[:30])]
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows += [(3000 + i, plain.speech(rng, 60, plain.EN) + f' token = "{h}" ' + plain.speech(rng, 30, plain.EN), "en", "src2") for i, h in enumerate(hexes)]
    table = lambda data, name, schema: spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    table(rows, "documents", plain.SCHEMA)
    table([(i, 1) for i in range(0, 100)] + [(2000 + i, 0) for i in range(10)], "labels", "doc_id long, quality int")
    table([(i, t) for i, t in items(rows) if i in (1, 4)], "benchmark", "item_id long, text string")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    # quality: the counts are the plain ones (test_counts); junk goes, ordinary texts of 50 words or more stay
    good = corpus_pipeline.saved(corpus_pipeline.quality_stage(spark, docs, path))
    left = [tuple(r) for r in good.collect()]
    assert good.columns == columns and not set(left) - set(rows)
    fails = lambda t: len(plain.words(t)) < 50 or 2 * plain.repeat_words(plain.words(t)) > len(plain.words(t))
    ordinary = [r for r in rows if not fails(r[1]) and not (r[0] is not None and 2000 <= r[0] < 2030)]
    assert sorted(left, key=KEY) == sorted(ordinary, key=KEY)
    # near duplicates: the smallest id of each class, and one of equal rows
    once = corpus_pipeline.saved(corpus_pipeline.near_duplicate_stage(spark, good, path))
    want = {r for r, c in zip(left, plain.classes(left)) if r[0] is not None and r[0] == c or r[0] is None and c is None}
    assert once.columns == columns and sorted((tuple(r) for r in once.collect()), key=KEY) == sorted(want, key=KEY)
    # benchmark passages
    clean = corpus_pipeline.saved(corpus_pipeline.benchmark_stage(spark, once, path))
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    ordered = sorted(want, key=KEY)
    want = [r for r, o in zip(ordered, overlap(ordered, tests)) if not o[5]]
    assert 0 < len(want) < len(ordered)
    assert clean.columns == columns and sorted((tuple(r) for r in clean.collect()), key=KEY) == sorted(want, key=KEY)
    # secrets
    safe = corpus_pipeline.saved(corpus_pipeline.secret_stage(spark, clean, path))
    want = [r for r in want if "token = " not in r[1]]
    assert safe.columns == columns and sorted((tuple(r) for r in safe.collect()), key=KEY) == sorted(want, key=KEY)
    # mix
    got = corpus_pipeline.mixing_stage(spark, safe, path)
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(want, plain.SCHEMA).toPandas().astype({"doc_id": "Int64"}))
    assert sorted((tuple(r) for r in got.select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=KEY) == sorted(con.execute(mixing.SQL).fetchall(), key=KEY)
    # the whole is its parts
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, path).collect()), key=KEY) == sorted((tuple(r) for r in got.collect()), key=KEY)


def test_stages_edges(spark, folder):
    """Clashing columns stay as they are; empty input gives empty output."""
    path, _ = folder
    rows = plain.corpus(20)
    for data in (rows[:3] + rows[-9:], []):
        docs = corpus_pipeline.saved(plain.table(spark, data))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns
            docs = corpus_pipeline.saved(out)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() <= len(data)


def test_near_duplicates_with_a_header(spark):
    """A copy with a header of a fifth of its length goes: similarity 0.8 on five-word shingles, 85 on four was not reached."""
    rng = __import__("random").Random(3)
    text = plain.speech(rng, 100, plain.EN)
    rows = [(1, text, "en", "s"), (2, plain.speech(rng, 21, plain.EN) + " " + text, "en", "s"), (3, plain.speech(rng, 100, plain.EN), "en", "s")]
    assert plain.classes(rows) == [1, 2, 3] and plain.classes(rows, 80, 5) == [1, 1, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, plain.table(spark, rows), "").collect()) == [1, 3]
