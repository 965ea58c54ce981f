"""Token counts against the library, text by text."""

import pickle
import random

import pytest

from cuewise.llm import tokens
from tests.llm import plain

NAME = "byte_bpe_50k.json"
ODD = [
    "a  b", "a   b\n\n\nc", " lead", "trail  ", "\n", "\t\t x", "a b   c", "x  y", "a\x1cb \x1d c\x85d", "don't 's 're  'll", "über Straße 12 34ab", "漢字 かな  漢", "😀😀 😀", "᠎ ᠎x", "a　 b", "﻿a ​ b",
    "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "< |endoftext|>", "a" * 5000, " " * 3000, "a\r\nb\r\n", "0" * 300 + " " + "!" * 300,
]


def library(texts):
    """Whole texts, one by one."""
    return [len(tokens.loaded(NAME)[0].encode(t or "", add_special_tokens=False).ids) for t in texts]


def odd_texts(n=300):
    rng = random.Random(8)
    parts = ["a", "Bc", "'s", "12", "é", "漢", "!", "?!", " ", "  ", "\n", "\t", " ", " ", "\x1f", "<|endoftext|>", "_", "-x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_equal_library(spark):
    rows = plain.corpus() + [(500 + i, t, "en", "s") for i, t in enumerate(ODD + odd_texts())] + [(None, "no id", None, None), (500, "again", "en", "s")]
    docs = plain.table(spark, rows).selectExpr("*", "1 AS t", "1 AS n_bytes", "1 AS doc")
    got = sorted(tuple(map(str, r)) for r in tokens.token_counts(docs.repartition(5)).collect())
    n = library([r[1] for r in rows])
    assert got == sorted(tuple(map(str, (r[0], len((r[1] or "").encode()), k, k > 1024))) for r, k in zip(rows, n))


def test_misses_and_cache(monkeypatch):
    """Without a frequent table, with a full one, and with a cache that is full again and again."""
    texts = ODD + odd_texts(80)
    want = library(texts)
    none = tokens.Lengths([], [])
    assert tokens.counts(texts, NAME, none) == want and tokens.counts(texts, NAME, none) == want
    keys = [k for k in {k for t in texts for k in tokens.pre_tokens(t)} if len(k.encode()) < 255]
    made = tokens.Lengths(keys, tokens.encoded_keys(NAME, keys))
    made.add({"later": 1})
    held = pickle.loads(pickle.dumps(made))
    assert held.known == dict(zip(keys, tokens.encoded_keys(NAME, keys)))
    assert tokens.counts(texts, NAME, held) == want
    assert tokens.counts([], NAME, none) == [] and tokens.counts([""], NAME, none) == [0]
    monkeypatch.setattr(tokens, "CACHED", 20)
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    small = tokens.Lengths(keys[:5], tokens.encoded_keys(NAME, keys[:5]))
    for some in (texts[:30], texts[30:90], texts):
        assert tokens.counts(some, NAME, small) == library(some)
        assert len(small.known) <= 5 + 20 and set(keys[:5]) <= set(small.known)


def test_borders_hold_for_every_character():
    """No token reaches over a border between pre-tokens, whatever character stands there."""
    for first in range(0, 0x30000, 0x4000):
        chars = [chr(c) for c in range(max(1, first), first + 0x4000) if not 0xD800 <= c <= 0xDFFF]
        texts = [t for c in chars for t in (f"a {c}b{c} x{c}\n y", f"a  {c}b \n{c} x ")]
        assert tokens.counts(texts, NAME, tokens.Lengths([], [])) == library(texts)


def test_frequent_pieces(spark):
    texts = spark.createDataFrame([("the cat the dog",)] * 30 + [("the " * 40 + f"rare{i}",) for i in range(30)], "t string").repartition(3)
    got = {r.piece: r.n for r in tokens.frequent_pieces(texts, 3).collect()}
    assert len(got) == 3 and got["the"] == 30 * 2 + 40 * 30


def test_bounded_summary_keeps_frequent(spark):
    """A task whose words outgrow its summary still hands on those above one in `width`."""
    texts = spark.createDataFrame([(f"often w{i} v{i} u{i}",) for i in range(4000)], "t string").coalesce(1)
    got = [r.piece for r in tokens.frequent_pieces(texts, 10, width=64).collect()]
    assert "often" in got


def test_empty_and_other_rules(spark):
    assert tokens.token_counts(plain.table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        tokens.token_counts(plain.table(spark, []), "word_bpe_49k.json")
