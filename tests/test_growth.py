"""What grows with the input: calls to the state of a stream, rows that are shuffled, work per line."""

import math

import pandas as pd
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions.chapterlines import parse_chapters
from cuewise.operators import boundedfolds as bf
from cuewise.operators import captions as ca
from cuewise.operators import chapters as ch
from cuewise.operators import folds as fo
from cuewise.operators import neardup as nd
from cuewise.operators import similarity as si
from cuewise.operators import textrows as tr
from cuewise.operators import thinning as th
from cuewise.operators.keywords import single, top_lists, top_words
from cuewise.plans.captionscores import misread
from cuewise.plans.stage import Tables
from cuewise.streaming import live


class Handle:
    """Counts what a processor asks of its state."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_signal_of_many_chunks_reads_and_writes_its_state_once():
    chunks, handle = live.ChunkParts(600_000_000, 0, 0, None), Handle()
    chunks.init(handle)
    us = [k * 600_000_000 for k in range(500)]
    list(chunks.handleInputRows((1,), iter([pd.DataFrame({"us": us, "end_us": [u + 1 for u in us]})]), None))
    assert handle.calls <= 3 and len(handle.timers) == 1
    handle.timers.clear()
    out = pd.concat(chunks.handleExpiredTimer((1,), At(300 * 600_000), At(300 * 600_000)))
    assert out["chunk_no"].tolist() == list(range(300)) and handle.timers == {301 * 600_000}


def test_kinds_of_an_owner_share_one_state():
    keep, handle = live.Retention({"a": 1.0, "b": 2.0}), Handle()
    keep.init(handle)
    rows = pd.DataFrame({"kind": ["a", "b", "a"], "us": [0, 0, 3 * 3600_000_000]})
    out = pd.concat(keep.handleInputRows((1,), iter([rows]), None))
    assert out.values.tolist() == [[1, "a", 0, 3600_000_000]] and handle.calls <= 3 and handle.timers == {2 * 3600_000}
    handle.timers.clear()
    out = pd.concat(keep.handleExpiredTimer((1,), At(4 * 3600_000), At(4 * 3600_000)))
    assert sorted(out["kind"]) == ["a", "b"] and not handle.timers and handle.value is None


def test_lines_of_short_groups_meet_without_pieces(spark, monkeypatch):
    texts = ["the quick brown fox jumps", "the quick brown fox jumped", "another line of words", "another line of word", "x", "the quick brown fox jumps over it"]
    rows = [(v, k, t) for v in ("a", "b") for k, t in enumerate(texts)] + [(None, 9, texts[0]), (None, 10, texts[1])]
    lines = spark.createDataFrame(rows, "video_id string, line_no long, text string")
    found = {}
    for few in (0, 1 << 10):
        monkeypatch.setattr(nd, "FEW_LINES", few)
        found[few] = sorted(map(tuple, nd.similar_pairs(lines, ["video_id"], 0.9, F.col("line_no_y") < F.col("line_no_x")).collect()))
    assert found[0] == found[1 << 10] == [("a", 1, 0), ("a", 3, 2), ("b", 1, 0), ("b", 3, 2)]
    frame = pd.DataFrame({"video_id": ["a"] * 3, "text": ["abc", "abcd", "zzzzzzzzzz"]})
    assert [(x.tolist(), y.tolist()) for x, y in nd._within(frame, ["video_id"], 0.8)] == [([0, 1], [1, 0])]


def shuffles(df):
    """Exchanges of the plan that deal out rows by a word."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "word" in x.split("hashpartitioning", 1)[1].split(")")[0]]


def test_words_of_single_texts_are_counted_where_they_are(spark):
    df = spark.createDataFrame([(1, "bbbb aaaa bbbb cccc"), (2, "aaaa bbbb"), (2, "bbbb dddd"), (3, ""), (None, "eeee"), (None, "eeee ffff"), (4, None)], "id long, text string")
    got = sorted(map(tuple, top_words(df, ["id"], "text", 2).collect()), key=str)
    assert got == sorted([(1, 1, "bbbb", 2, 0), (1, 2, "aaaa", 1, 1), (2, 1, "bbbb", 2, 0), (2, 2, "aaaa", 1, 0), (None, 1, "eeee", 2, 0), (None, 2, "ffff", 1, 1)], key=str)
    one, more = single(df, ["id"])
    assert {r.id for r in one.collect()} == {1, 3, 4} and more.count() == 4
    assert {r.id: r.top for r in top_lists(df, ["id"], "text", 2).collect()}[1] == ["bbbb", "aaaa"]


def test_line_weights_shuffle_lines_and_not_words(spark):
    rows = [("a", 0, "one two two"), ("a", 1, "one three"), ("a", 2, ""), ("a", 3, "one"), (None, 1, "one two")]
    lines = spark.createDataFrame(rows, "video_id string, line_no int, text string")
    assert not shuffles(tr.tfidf(lines))
    w = {(r.line_no, r.word): r.weight for r in tr.tfidf(lines).collect()}
    one, two = math.log(5 / 4) + 1, 2 * (math.log(5 / 2) + 1)
    assert set(w) == {(0, "one"), (0, "two"), (1, "one"), (1, "three"), (3, "one")}
    assert abs(w[0, "one"] - one / math.hypot(one, two)) < 1e-12 and w[3, "one"] == 1.0
    sims = {(r.video_id, r.line_no): r.sim for r in si.line_similarity(lines).collect()}
    assert sims == {("a", 1): round(w[0, "one"] * w[1, "one"], 9), ("a", 2): None, ("a", 3): None, (None, 1): None}


def test_tokens_of_texts_that_share_a_key_count_together(spark):
    df = spark.createDataFrame([(1, "a b a a b"), (2, "a a"), (2, "a b"), (3, "  ")], "id long, text string")
    got = {r.id: r.text for r in tr.limit_tokens(df, "id", "text", 2).collect()}
    assert got[1] == "a b a b" and sorted(got[2].split()) == ["a", "a", "b"] and set(got) == {1, 2}


def test_places_count_together_on_rows_that_come_twice(spark):
    df = spark.createDataFrame([("a", 0, ["x"]), ("a", 1, ["x", "y", "x"]), ("a", 1, ["x", "y", "x"]), ("a", 2, None)], "video_id string, line_no long, k array<string>")
    got = sorted((r.line_no, r.n, sorted(r.back)) for r in fo.with_last_places(df, ["video_id"], "line_no", "k").collect())
    assert got == [(0, 1, []), (1, 4, [0, 1, 1]), (1, 4, [0, 1, 1]), (2, 0, [])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_scores_shuffle_no_gram(spark):
    rows = [(0.5, "a", 0, 0, ["x", "y", "z"], ["x", "y"]), (0.5, "a", 1, -1, ["x", "x"], []), (0.5, "b", 0, 0, ["q"], ["q"])]
    pairs = spark.createDataFrame(rows, "tiou double, video_id string, j long, i long, pw array<string>, rw array<string>")
    for scores in (ca.bleu(pairs), ca.cider(pairs)):
        assert "gram" not in plan(scores)
    got = {(r.video_id, r.n): r.precision for r in ca.bleu(pairs).collect()}
    assert round(got["a", 1], 6) == 0.4 and round(got["a", 2], 6) == round(1 / 3, 6) and round(got["b", 1], 6) == 1.0
    # one pair of two holds the words: idf log 2, so dot / norms is the share of shared grams
    want = (2 / math.sqrt(2 * 3) + 1 / math.sqrt(2)) / 4 * 10 * math.exp(-1 / 72) / 2
    assert abs({r.video_id: r.score for r in ca.cider(pairs).collect()}["a"] - want) < 1e-9


def test_replies_are_parsed_once(spark):
    text = "00:00:10 - a\n00:00:10 - b\n* [00:00:20] c"
    df = spark.createDataFrame([(1, text), (2, "* [00:00:20] c\n* [00:00:20] d"), (None, text)], "k long, t string")
    got = parse_chapters(df, "k", "t")
    assert plan(got).split("== Initial Plan ==")[0].count("posexplode") == 1
    assert sorted(map(tuple, got.select("k", "stamp", "title", "pos").collect())) == [(1, "00:00:10", "b", 0), (2, "00:00:20", "c", 0)]


def test_work_per_line_is_not_the_square_of_its_length(spark):
    df = spark.createDataFrame([("a體b體b", ["abc", "x"], ["zabcz"], ["y"])], "t string, g array<string>, c array<string>, d array<string>")
    row = df.select(tx.bigrams(F.col("t")).alias("b"), tx.relevance(F.col("g"), F.col("c")).alias("near"), tx.relevance(F.col("g"), F.col("d")).alias("far"), tx.relevance(F.col("c"), F.col("g")).alias("back"))
    assert "substring" not in plan(row.select("b"))
    assert tuple(row.first()) == (["a體", "體b", "b體"], 0.1, 0.0, 0.1)
    assert [r.b for r in spark.createDataFrame([("",), ("x",), (None,)], "t string").select(tx.bigrams(F.col("t")).alias("b")).collect()] == [[], [], []]


def test_length_is_looked_at_before_any_pattern(spark):
    low = plan(spark.createDataFrame([("x",)], "t string").select(tx.is_low_information(F.col("t")).alias("low")))
    assert low.index(">= 25") < low.index("https?")


def test_misread_words_are_hashed_once_each(spark):
    words = misread(Tables(spark, "/root/testdata/sf0.001"))
    # the distinct words are read back, not the texts
    assert "FileScan" not in plan(words) and words.count() == words.distinct().count() > 1000


def test_chapters_are_cut_without_a_second_join(spark):
    hits = spark.createDataFrame([("a", 0, "t", 0, 0.0, 15.0, "one"), ("a", 0, "t", 1, 15.0, 30.0, "two")], "video_id string, chapter_idx int, title string, line_no long, start_s double, end_s double, text string")
    got = si.chunk_chapters(hits.join(hits.select("video_id").distinct(), "video_id"), 600)
    assert "Join" not in plan(got.where("chunk_index = 0").select("text")).split("== Initial Plan ==")[0].split("Union")[0]
    assert got.first().text == "one two"


def test_short_corpora_are_cleaned_as_a_whole(spark):
    lines = [("a", 0, "°"), ("a", 1, "hello there"), ("a", 2, "join now"), ("a", 3, None), ("b", 0, "Zoom 12:30:00 x"), ("b", 1, "ab  c"), (None, 0, "lone")]
    slides = spark.createDataFrame(lines, "video_id string, pos long, text string")
    speech = spark.createDataFrame([("b", 0, "said"), ("c", 0, "only log-in said")], "video_id string, pos long, text string")
    want = {"a": "【Slides(OCR)】\nthere 【Audio(ASR)】", "b": "【Slides(OCR)】 x\nab c 【Audio(ASR)】\nsaid", "c": "【Slides(OCR)】 【Audio(ASR)】\nonly said", None: "【Slides(OCR)】\nlone 【Audio(ASR)】"}
    for whole in (1 << 16, 0):
        assert {r.video_id: r.text for r in tr.capped_corpus(slides, speech, 3000, whole).collect()} == want


def test_boxes_of_a_frame_are_shuffled_once(spark):
    rows = [("v", 0, x, x + 10.0, y, y + 10.0, 1280, 720, w) for x, y, w in [(0.0, 0.0, "b"), (0.0, 0.0, "a"), (50.0, 0.0, "far"), (0.0, 40.0, "low")]] + [("v", 0, None, 5.0, 0.0, 10.0, 1280, 720, "none")]
    df = spark.createDataFrame(rows, "video_id string, frame long, x1 double, x2 double, y1 double, y2 double, w int, h int, text string")
    got = bf.reading_lines(df)
    first = plan(got).split("== Initial Plan ==")[0]
    assert first.count("Exchange") == 1 and "Window" not in first
    assert [(r.line_no, r.text) for r in got.orderBy("line_no").collect()] == [(0, "none a b"), (1, "far"), (2, "low")]


def test_nearest_frames_and_stamps_grow_with_their_rows(spark):
    stamps = spark.createDataFrame([("v", x, i, 100) for i, x in enumerate((10, 20, 31))], "video_id string, start_s long, idx int, duration int")
    near = ch.nearest_frame(stamps, spark.createDataFrame([("v", 12), ("v", 18), ("v", 90)], "video_id string, x long"), 5.0)
    assert "unboundedfollowing" not in plan(near).lower()
    assert sorted((r.idx, r.frame) for r in near.select("idx", "frame").collect()) == [(0, 12), (1, 18), (2, None)]
    seen, real = [], th.grouped
    th.grouped = lambda *a: seen.append(a[1]) or real(*a)
    try:
        got = th.thin_gaps(spark.createDataFrame([("v", float(x)) for x in (0, 1, 5, 6, 9)] + [(None, 3.0)], "video_id string, t double"), 3)
        assert sorted((str(r.video_id), r.t) for r in got.collect()) == [("None", 3.0), ("v", 0.0), ("v", 5.0), ("v", 9.0)]
    finally:
        th.grouped = real
    assert seen == [["video_id", "part"]]
