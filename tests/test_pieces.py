"""Sources, streams and bounded folds on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from cuewise.functions.timefmt import hms_to_sec
from cuewise.operators import boundedfolds as bf
from cuewise.operators import chapters as ch
from cuewise.operators import similarity as si
from cuewise.operators.lexicon import snap
from cuewise.plans.captionscores import TERMS
from cuewise.sources import records as re
from cuewise.streaming import live
from tests.test_functions import REPLY


def test_reply_balances_to_four_chapters_in_the_legacy_form(spark):
    rows = [("v", *line.split(" - ", 1), 11303) for line in REPLY.strip().split("\n")]
    df = spark.createDataFrame(rows, "video_id string, stamp string, title string, duration int").withColumn("start_s", hms_to_sec(F.col("stamp")))
    got = sorted(r["start_s"] for r in bf.merge_close(df.withColumn("min_gap", F.lit(600)), legacy=True).collect())
    assert got == [2114, 3136, 7774, 8883]
    assert sorted(r["start_s"] for r in bf.merge_close(df.withColumn("min_gap", F.lit(540)), legacy=True).collect()) == got


def test_boundaries_tile_the_video(spark):
    df = spark.createDataFrame([("a", 10, 60), ("a", 30, 60), ("a", 60, 60), ("b", 0, 5)], "video_id string, start_s long, duration int")
    rows = ch.segments(df).orderBy("video_id", "s").collect()
    assert [(r["video_id"], r["s"], r["e"]) for r in rows] == [("a", 0.0, 10.0), ("a", 10.0, 30.0), ("a", 30.0, 60.0), ("b", 0.0, 5.0)]


def test_stamp_collisions(spark):
    rows = [("v", i, s, 12, f"t{i}", None, None) for i, s in enumerate([5, 5, 5, 11, 11, 11])]
    df = spark.createDataFrame(rows, "video_id string, idx int, start_s long, duration int, title string, unit_no int, unit_title string")
    got = {r["title"]: r["start_s"] for r in bf.place_stamps(df).collect()}
    assert got == {"t0": 5, "t1": 6, "t2": 7, "t3": 11, "t4": 10, "t5": 9}


def test_unit_prefixes(spark):
    df = spark.createDataFrame([("v", 0, 5, 99, "a", 2, "u"), ("v", 1, 6, 99, "b", 3, None)], "video_id string, idx int, start_s long, duration int, title string, unit_no int, unit_title string")
    assert sorted(r["title"] for r in bf.place_stamps(df).collect()) == ["[單元2：u] a", "[單元3] b"]


def test_equal_titles_merge(spark):
    rows = [("v", 0, 10, "Intro to Python", 0.5), ("v", 10, 20, "intro to python", 0.7), ("v", 20, 30, "Loops", 0.9)]
    got = bf.merge_titles(spark.createDataFrame(rows, "video_id string, start_s long, end_s long, title string, confidence double")).orderBy("start_s").collect()
    assert [(r["start_s"], r["end_s"], r["title"], r["confidence"]) for r in got] == [(0, 20, "Intro to Python", 0.6), (20, 30, "Loops", 0.9)]


def test_reading_lines(spark):
    tok = [("v", 0, 100.0, 140.0, 10.0, 20.0, "world"), ("v", 0, 10.0, 95.0, 12.0, 22.0, "hello"), ("v", 0, 400.0, 450.0, 11.0, 21.0, "far"), ("v", 0, 10.0, 60.0, 100.0, 110.0, "second")]
    df = spark.createDataFrame([(*t[:6], 1000, 700, t[6]) for t in tok], "video_id string, frame long, x1 double, x2 double, y1 double, y2 double, w int, h int, text string")
    assert [r["text"] for r in bf.reading_lines(df).orderBy("line_no").collect()] == ["hello world", "far", "second"]


def test_chunks_cover_and_carry(spark):
    rows = [("v", 0, "t", n, n * 10.0, n * 10.0 + 10, "w" * 100) for n in range(9)]  # 30 tokens each
    df = spark.createDataFrame(rows, "video_id string, chapter_idx int, title string, line_no long, start_s double, end_s double, text string")
    got = si.chunk_chapters(df, most=100, carry=35).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == ["ch0_0", "ch0_1", "ch0_2", "ch0_3"]
    assert [(r["start_s"], r["end_s"]) for r in got] == [(0.0, 30.0), (30.0, 50.0), (50.0, 70.0), (70.0, 90.0)]
    assert [r["text"].count(" ") + 1 for r in got] == [3, 3, 3, 3]
    whole = si.chunk_chapters(df, most=600).collect()
    assert len(whole) == 1 and whole[0]["end_s"] == 90.0


def test_lexicon_snap(spark):
    df = spark.createDataFrame([("Pythn",), ("Jupiter",), ("colab",), ("zebra",)], "w string")
    assert {r.w: r.snapped for r in snap(df, TERMS).collect()} == {"Pythn": "Python", "Jupiter": "Jupyter", "colab": "colab", "zebra": "zebra"}


def test_weighted_choice_prefers_early_starts(spark):
    n = 3000
    b = spark.range(n).select(F.col("id").cast("string").alias("video_id"), F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 100, 200)])).alias("start_s"))
    got = ch.weighted_start(b, seed=3).groupBy("place").count().collect()
    share = {r["place"]: r["count"] / n for r in got}
    total = 1 + 0.8 + 0.64
    for place, weight in ((0, 1), (1, 0.8), (2, 0.64)):
        assert share[place] == pytest.approx(weight / total, abs=0.03)


def test_prediction_files(spark, tmp_path):
    for vid in ("ab1", "cd2"):
        (tmp_path / vid[:2]).mkdir()
        (tmp_path / vid[:2] / f"{vid}.json").write_text(json.dumps({"chapters": {"00:00:00": f"start {vid}", "00:01:00": "next"}}, indent=1))
    rows = re.read_predictions(spark, f"{tmp_path}/*/*.json").collect()
    assert {(r["video_id"], r["stamp"]) for r in rows} == {(v, s) for v in ("ab1", "cd2") for s in ("00:00:00", "00:01:00")}


def test_segment_files(spark):
    bodies = {"array": '[{"start": 1.7, "end": 3, "text": " a "}, 5, {"text": ""}]', "wrapped": '{"segments": [{"text": "b"}]}', "lines": '{"start": 2, "text": "c"}\n\n{"start": 4, "end": 6, "text": "d"}\n',
              "plain": " just text\nmore ", "other": '{"a": 1}', "number": "5 apples", "empty": "[]"}
    df = spark.createDataFrame(list(bodies.items()), "file string, body string")
    got = sorted((r["file"], r["start"], r["end"], r["text"]) for r in re.load_segments(df, "file", "body").collect())
    assert got == [("array", 1, 3, "a"), ("lines", 2, 2, "c"), ("lines", 4, 6, "d"), ("number", 0, 0, "5 apples"), ("plain", 0, 0, "just text\nmore"), ("wrapped", 0, 0, "b")]


def test_metadata_blocks(spark):
    text = ";FFMETADATA1\ntitle=Lecture\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=1500\nEND=4000\ntitle=One=1\n[CHAPTER]\nSTART=4000"
    df = spark.createDataFrame([("v", text)], "video_id string, text string")
    got = [(r["start_sec"], r["end_sec"], r["title"]) for r in re.metadata_blocks(df).orderBy("block").collect()]
    assert got == [(0.0, 0.0, "Lecture"), (1.5, 4.0, "One=1"), (4.0, 0.0, "")]


def test_admission_over_several_triggers_equals_one(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    rows = src.toPandas()
    third = len(rows) // 3
    for n in range(3):
        part = rows.iloc[n * third:(n + 1) * third if n < 2 else None]
        spark.createDataFrame(part, src.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    many = live.drain(live.admitted(stream, 2, 21600.0, delay="30 days"), str(tmp_path / "out"))
    once = live.drain(live.admitted(live.event_stream(spark, "/root/testdata/sf0.001"), 2, 21600.0), str(tmp_path / "one"))
    key = lambda df: sorted((r["event_id"], r["allowed"], r["remaining"]) for r in df.collect())
    assert key(many) == key(once)


def test_corpus_cap_counts_what_is_left(spark):
    """Lines that are scrubbed away don't use up the cap."""
    from cuewise.operators.textrows import capped_corpus

    rows = [("v", i, "mute " + "x" * 60) for i in range(10)] + [("v", 10 + i, f"good line {i}") for i in range(5)]
    speech = spark.createDataFrame([], "video_id string, pos long, text string")
    got = capped_corpus(spark.createDataFrame(rows, "video_id string, pos long, text string"), speech, 40).first()["text"]
    whole = capped_corpus(spark.createDataFrame(rows, "video_id string, pos long, text string"), speech, 10_000).first()["text"]
    assert "good line 0" in got and got == whole[:40]


def test_alignment_counts_videos_without_predictions(spark):
    from cuewise.operators import captions as ca
    from cuewise.operators import metrics as me

    refs = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0)], "video_id string, s double, e double")
    preds = spark.createDataFrame([("a", 0.0, 10.0)], "video_id string, s double, e double")
    counts = me.side_counts(refs, preds).where("n_ref > 0")
    pairs = spark.createDataFrame([("a", 0, 0, 1.0, 1.0)], "video_id string, i long, j long, iou double, text double")
    got = {r["video_id"]: r["f1"] for r in ca.alignment(pairs, counts).where("variant = 'd'").collect()}
    assert got["b"] == 0.0 and got["a"] > 0.99


def test_admin_blocks_neither_pass_nor_refill(spark):
    from cuewise.operators.textrows import relevance_filter

    rows = [("v", i, "t", s, a, 10) for i, (s, a) in enumerate([(0.9, True), (0.5, False), (0.4, None), (0.3, False), (0.01, True), (0.02, False)])]
    df = spark.createDataFrame(rows, "video_id string, pos int, text string, score double, is_admin boolean, size int")
    kept = lambda **k: sorted(r["pos"] for r in relevance_filter(df, **k).collect())
    assert kept() == [0, 1, 2, 3]
    assert kept(drop_admin=True) == [1, 2, 3]
    assert kept(drop_admin=True, refill=5) == [1, 2, 3, 5]


def test_null_keys_are_one_group(spark):
    from cuewise.operators.folds import grouped

    df = spark.createDataFrame([(None, i) for i in range(5)] + [("a", 1)], "k string, i int")
    got = grouped(df, ["k"], ["i"], ["i"], lambda rows: [(len(rows),)], "n int").collect()
    assert sorted((str(r["k"]), r["n"]) for r in got) == [("None", 5), ("a", 1)]


def test_titles_of_one_character_are_bare(spark):
    from cuewise.functions import text as tx

    rows = spark.createDataFrame([("x",), ("",), ("ok title",), ("Part 2",)], "t string").select(tx.is_bare_title(F.col("t")).alias("b"), tx.is_generic_title(F.col("t")).alias("g")).collect()
    assert [r["b"] for r in rows] == [True, True, False, True] and [r["g"] for r in rows] == [False, True, False, True]
