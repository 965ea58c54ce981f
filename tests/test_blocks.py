"""Matching-block ratio, the joins that use it, and the terms that words snap to, against pairwise loops."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuewise.functions import blocks
from cuewise.operators import neardup as nd
from cuewise.operators.lexicon import snap
from cuewise.plans.captionscores import TERMS
from tests.test_scale import brute_dedup

LETTERS = ["ab", "abc d", "abcdefghijklmnop ", "äöü漢字x😀"]


def some(rng, n, letters):
    return "".join(rng.choice(letters) for _ in range(n))


def changed(rng, text, letters, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        k = rng.randint(0, len(out))
        if rng.random() < 0.5 or not out:
            out.insert(k, rng.choice(letters))
        else:
            out.pop(k - 1)
    return "".join(out)


def pairs(n, sizes, most, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(LETTERS)
        a = some(rng, rng.choice(sizes), letters)
        yield a, changed(rng, a, letters, most) if rng.random() < 0.6 else some(rng, rng.choice(sizes), letters)


@pytest.mark.parametrize("sizes, n, most", [((0, 1, 2, 5, 12, 40), 1500, 6), ((150, 199, 200, 260, 400), 150, 40)])
def test_ratio(sizes, n, most):
    """Also from the length on at which frequent characters open no block."""
    a, b = zip(*pairs(n, sizes, most, n))
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert blocks.ratios(a, b).tolist() == want
    assert (blocks.most_ratios(a, b) >= np.array(want)).all()
    assert blocks.alike(a, b, 0.9).tolist() == [w >= 0.9 for w in want]


def test_ratio_in_small_steps(monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 50)
    a, b = zip(*pairs(200, (0, 3, 30), 5, 2))
    assert blocks.ratios(a, b).tolist() == [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert blocks.ratios([], []).tolist() == [] and blocks.alike([], [], 0.5).tolist() == []


def test_ratio_column(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "a"), ("", ""), ("a", None), ("xy", "ab")], "a string, b string")
    assert [r[0] for r in df.select(blocks.block_ratio(F.col("a"), F.col("b"))).collect()] == [0.75, None, 1.0, None, 0.0]
    assert [r[0] for r in df.select(blocks.block_ratio(F.col("a"), F.col("b"), 0.8)).collect()] == [None, None, 1.0, None, None]


@pytest.mark.parametrize("cutoff", [0.7, 0.82, 0.9, 0.93])
def test_pairs_equal_all_pairs(spark, cutoff):
    """Every pair of any length that reaches the cutoff is met."""
    rng = random.Random(int(cutoff * 100))
    base = [some(rng, n, "abcdef gh") for n in (1, 2, 3, 4, 5, 7, 9, 12, 20, 33, 60, 240)]
    lines = [changed(rng, rng.choice(base), "abcdef gh", 6) for _ in range(150)]
    lines = [x for x in dict.fromkeys(lines) if x]
    df = spark.createDataFrame([("v", n, t) for n, t in enumerate(lines)], "video_id string, line_no long, text string")
    got = {(r.x, r.y) for r in nd.similar_pairs(df, ["video_id"], cutoff, F.col("line_no_y") < F.col("line_no_x")).collect()}
    assert got == {(i, j) for i in range(len(lines)) for j in range(i) if difflib.SequenceMatcher(None, lines[i], lines[j]).ratio() >= cutoff}


def test_low_cutoff_refused(spark):
    with pytest.raises(ValueError):
        nd.similar_pairs(spark.createDataFrame([], "video_id string, line_no long, text string"), ["video_id"], 0.5, F.lit(True))


def test_repeats_in_chains(spark):
    """Each line is like the one before only: every second one stays. A line like two that went stays."""
    pairs = [("v", i, i - 1) for i in range(1, 12)] + [("w", 1, 0), ("w", 2, 0), ("w", 3, 1), ("w", 3, 2)]
    got = {tuple(r) for r in nd.repeats(spark.createDataFrame(pairs, "video_id string, x long, y long")).collect()}
    assert got == {("v", i) for i in range(1, 12, 2)} | {("w", 1), ("w", 2)}


@pytest.mark.parametrize("most_lines", [None, 5])
def test_dedup_equals_loop(spark, most_lines):
    rng = random.Random(9)
    base = ["The quick brown fox jumps", "over a lazy dog again", "numbers one two three four", "ab", "a", "an unrelated line of words " * 9]
    rows, lines = [], {}
    for v in "pqr":
        lines[v] = []
        for n in range(80):
            t = changed(rng, rng.choice(base), "abcXYZ ", 3)
            t = t.upper() if rng.random() < 0.1 else t
            if t:
                lines[v].append((n // 7 if n < 42 else 20 + n // 4, n, t))
        rows += [(v, *x) for x in lines[v]]
    df = spark.createDataFrame(rows, "video_id string, window_no long, line_no long, text string")
    got = sorted((r.video_id, r.line_no, r.text) for r in nd.dedup_lines(df, most_lines=most_lines).collect())
    assert got == sorted((v, *x) for v in lines for x in brute_dedup(lines[v], most_lines or 10**9))


def test_dedup_empty(spark):
    assert nd.dedup_lines(spark.createDataFrame([], "video_id string, window_no long, line_no long, text string")).count() == 0


def test_snap_equals_closest_match(spark):
    rng = random.Random(3)
    letters = "abcdeghinoprstuyJAGPULDMTENC"
    words = {changed(rng, rng.choice(TERMS), letters, 4) for _ in range(600)} | {"字Python", "Pythonpython", "Colab", "12", ""}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    share = lambda w: sum(c.isascii() and c.isalpha() for c in w) / max(1, sum(c.isalpha() for c in w))
    want = {w: (difflib.get_close_matches(w, TERMS, n=1, cutoff=0.82) or [w])[0] if share(w) >= 0.7 else w for w in words}
    assert {r.w: r.snapped for r in snap(df, TERMS).collect()} == want
    ties = ["abcx", "abcd"]
    assert snap(spark.createDataFrame([("abc",)], "w string"), ties).first().snapped == difflib.get_close_matches("abc", ties, n=1, cutoff=0.82)[0]


def test_common_words_equal_table(spark):
    """Also over the border between the numbers that hold the bits, with repeated words and carries."""
    rng = random.Random(11)
    rows = [(k, [rng.choice("abc") for _ in range(n)], [rng.choice("abcd") for _ in range(m)]) for k, (n, m) in enumerate(
        [(0, 3), (3, 0), (1, 1), (7, 9), (20, 62), (30, 63), (70, 61), (90, 130), (200, 190)] + [(rng.randint(0, 80), rng.randint(0, 140)) for _ in range(40)])]
    rows += [(1000, ["x"] * 130, ["x"] * 128), (1001, ["x"] * 60, ["y"] * 70 + ["x"] * 70)]

    def lcs(a, b):
        prev = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
            prev = row
        return prev[-1]

    from cuewise.operators.captions import common_words

    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = {r.k: r.n for r in df.select("k", common_words(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {k: lcs(a, b) for k, a, b in rows}


def test_long_pairs_settle_early():
    """Turned, mixed and long strings: what is looked at first never rejects a pair wrongly."""
    a, b = zip(*pairs(300, (198, 200, 230, 420), 60, 11))
    a, b = [*a, "ab" * 150, "x" * 300, "", "abc" * 80], [*b, "ba" * 150, "x" * 260, "y" * 300, "cab" * 80]
    want = np.array([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
    assert (blocks.ratios(a, b) == want).all()
    for cutoff in (0.7, 0.9, 0.93, *np.unique(want)[::20]):
        assert (blocks.alike(a, b, cutoff) == (want >= cutoff)).all()
    assert blocks.may_match(a, b, want * [(len(x) + len(y)) / 2 for x, y in zip(a, b)]).all()


def test_mixed_characters_are_not_matched(monkeypatch):
    """The same characters in another order: known by their short runs, no block is sought."""
    rng = random.Random(2)
    a = [some(rng, n, "abcdefghijklmnop ") for n in (60, 150, 250, 900) for _ in range(20)]
    b = ["".join(rng.sample(t, len(t))) for t in a]
    monkeypatch.setattr(blocks, "_matched_short", None)
    monkeypatch.setattr(blocks, "SequenceMatcher", lambda *_: None)
    assert not blocks.alike(a, b, 0.9).any()


@pytest.mark.parametrize("most_lines", [None, 6])
def test_held_videos_equal_joined_ones(spark, monkeypatch, most_lines):
    """Also where line numbers come twice, with the same text or another one; null keys and texts; held videos take one Python step."""
    rng = random.Random(21)
    base = ["The quick brown fox jumps", "over a lazy dog again", "ab", "", "numbers one two three four " * 10]
    rows = []
    for v in ("p", "q", "r", None):
        for n in range(60):
            for _ in range(rng.choice([1, 1, 1, 2])):
                t = changed(rng, rng.choice(base), "abcXYZ ", 2)
                rows += [(v, n // 8, n, t.upper() if rng.random() < 0.1 else t)] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame([*rows, ("p", 0, 3, None)], "video_id string, window_no long, line_no long, text string")
    held = nd.dedup_lines(df, most_lines=most_lines)
    plan = held._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInPandas") == 1 and plan.count("Exchange") == 1 and "ExistingRDD" in plan
    found = {}
    for few in (0, 1 << 10):
        monkeypatch.setattr(nd, "FEW_LINES", few)
        found[few] = sorted(map(tuple, nd.dedup_lines(df, most_lines=most_lines).collect()))
    assert found[0] == found[1 << 10] and len(found[0]) > 20


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_within_edits():
    a, b = zip(*pairs(1500, (0, 1, 2, 3, 5, 12, 40), 4, 5))
    want = np.array([edit_distance(x, y) for x, y in zip(a, b)])
    for edits in range(4):
        assert (blocks.within_edits(a, b, edits) == (want <= edits)).all()
    assert blocks.within_edits([], [], 2).tolist() == []


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_near_an_earlier_one(spark, monkeypatch, edits):
    """Held or joined, also with empty lines, texts and numbers that come twice, and nulls; held videos are shuffled once, as lines."""
    rng = random.Random(edits)
    base = ["", "a", "abc", "the quick brown fox", "over a lazy dog again", "漢字😀 line of words"]
    rows = []
    for v in ("p", "q", None):
        for n in range(70):
            t = changed(rng, rng.choice(base), "abcXYZ ", 4)
            rows += [(v, n - n % 9 // 8, t)] * rng.choice([1, 1, 2])
    df = spark.createDataFrame([*rows, ("p", 1, None), ("q", None, "abc")], "video_id string, line_no long, text string")
    plan = nd.near_earlier(df, edits)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = sorted((v, n) for v, n, t in rows if v and any(w == v and m < n and edit_distance(t, u) <= edits for w, m, u in rows))
    for few in (0, 1 << 10):
        monkeypatch.setattr(nd, "FEW_LINES", few)
        assert sorted(map(tuple, nd.near_earlier(df, edits).collect())) == want


def test_lines_settle_in_parts(monkeypatch):
    """However many lines of a held video are settled at once; 5,000 lines are held."""
    rng = random.Random(31)
    base = ["The quick brown fox jumps", "over a lazy dog again", "ab", "numbers one two three " * 11, "row 1234 of the table"]
    rows = [(v, n // 8, n, changed(rng, rng.choice(base), "abXYZ 123", 4)) for v in range(5) for n in range(rng.choice([5, 40, 250]))]
    frame = pd.DataFrame(rows, columns=["video_id", "window_no", "line_no", "text"])
    frame["low"] = frame["text"].str.lower()
    found = []
    for at_once, pairs_ in ((1, 7), (3, 1 << 14), (64, 50), (1 << 20, 1 << 14)):
        monkeypatch.setattr(nd, "AT_ONCE", at_once)
        monkeypatch.setattr(nd, "PAIRS", pairs_)
        found.append(sorted(map(tuple, nd._deduped(frame, 0.9, 0.93, None).to_numpy())))
    assert all(f == found[0] for f in found) and 50 < len(found[0]) < len(rows)
    assert nd.FEW_LINES >= 5000
