"""Cross-entropy difference: target and background n-gram models over one vocabulary.

All words and pairs of neighbours that stand twice are kept, whatever their number. Documents are dealt into
chunks. A chunk sends the counts of its distinct words and pairs once, each to the bucket of its hash; a bucket adds up
the chunks and sends back to each the sums alone, in the order of its keys; and the chunk scores its documents
with those. Nobody holds more of the models than a bucket or what a chunk asks for.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import FOLD, raw
from cuewise.llm.registry import query, table

#: Bytes of text, about, of a chunk; a bucket gets about as many keys as a chunk has.
CHUNK = 1 << 23
#: Buckets at least, so that small inputs spread too.
BUCKETS = 1 << 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text) -> list[bytes]:
    return raw(text).translate(FOLD).split()


class Keys:
    """Words and pairs of neighbours as 64-bit hashes: a word ends in the bits 10, a pair in 1; 0 is neither."""

    def __init__(self):
        self.known = {}

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the words of all texts, of the pairs (each at its second word; 0 at a first word), and words by text."""
        split = [tokens(t) for t in texts]
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
        flat = []
        for words in split:
            flat += words
        for w in set(flat).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w) & ~3 | 2
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        g = np.zeros(len(h), np.uint64)
        g[1:] = (h[:-1] * _MIX) ^ h[1:]
        g = (g ^ (g >> np.uint64(29))) * _MIX
        g = (g ^ (g >> np.uint64(32))) | np.uint64(1)
        g[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        return h, g, sizes


@cache
def _keys() -> Keys:
    return Keys()


class _Reader:
    def __init__(self, blob: bytes):
        self.blob, self.place = blob, 0

    def __call__(self, kind, n: int = 1) -> np.ndarray:
        out = np.frombuffer(self.blob, kind, n, self.place)
        self.place += out.nbytes
        return out


def _packed(values: np.ndarray) -> bytes:
    """Counts as two bytes each, low ones first, since most are small; those that don't fit are listed."""
    at = np.flatnonzero(values >= 65535)
    short = np.minimum(values, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T
    return np.uint32(len(at)).tobytes() + short.tobytes() + at.astype(np.uint32).tobytes() + values[at].astype(np.int64).tobytes()


def _values(read: _Reader, size: int) -> np.ndarray:
    big = int(read(np.uint32)[0])
    out = np.ascontiguousarray(read(np.uint8, 2 * size).reshape(2, -1).T).reshape(-1).view("<u2").astype(np.int64)
    at = read(np.uint32, big)
    out[at] = read(np.int64, big)
    return out


def pack(n: np.ndarray, m: np.ndarray, keys: np.ndarray | None = None) -> bytes:
    """Two counts each, and ascending keys if there are any: the steps between keys take six bytes, longer ones two more in a list."""
    out = np.uint32(len(n)).tobytes() + _packed(n) + _packed(m)
    if keys is None:
        return out
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    high = (steps >> np.uint64(48)).astype(np.uint16)
    at = np.flatnonzero(high)
    return out + np.uint32(len(at)).tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + at.astype(np.uint32).tobytes() + high[at].tobytes()


def unpack(blob: bytes, keyed: bool = False) -> tuple[np.ndarray, ...]:
    read = _Reader(blob)
    size = int(read(np.uint32)[0])
    counts = _values(read, size), _values(read, size)
    if not keyed:
        return counts
    far = int(read(np.uint32)[0])
    steps = np.zeros((size, 8), np.uint8)
    steps[:, :6] = read(np.uint8, 6 * size).reshape(-1, 6)
    steps = steps.reshape(-1).view("<u8").copy()
    at = read(np.uint32, far)
    steps[at] |= read(np.uint16, far).astype(np.uint64) << np.uint64(48)
    return *counts, np.cumsum(steps, dtype=np.uint64)


def _count(part: pd.DataFrame, good: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Per bucket, the distinct words and pairs of a chunk: how often all documents have them, and the target's. Key 0: every word."""
    read, target, held = _keys(), part["key"].isin(good["good"]).to_numpy(), ([], [])
    texts = part["_text"].to_numpy(object)
    for at in range(0, len(part), 200):
        for side in (0, 1):
            some = texts[at : at + 200][target[at : at + 200] == bool(side)]
            words, pairs, _ = read(some)
            if len(words):
                held[side].extend((words, pairs[pairs != 0], np.zeros(len(words), np.uint64)))
    if not held[0] and not held[1]:
        return pd.DataFrame({"bucket": [], "chunk": [], "blob": []})
    keys, n = np.unique(np.concatenate(held[0] + held[1]), return_counts=True)
    m = np.zeros(len(keys), np.int64)
    if held[1]:
        own, seen = np.unique(np.concatenate(held[1]), return_counts=True)
        m[np.searchsorted(keys, own)] = seen
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = [pack(*x) for x in zip(*(np.split(x, first[1:]) for x in (n, m, keys)))]
    return pd.DataFrame({"bucket": bucket[first], "chunk": part["chunk"].iloc[0], "blob": blobs})


def _add(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """For each chunk, the sums of its own keys of one bucket, in their order, 0 for keys that are not kept; and a row of sums, chunk -1."""
    parts = [unpack(b, True) for b in rows["blob"]]
    keys, back = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    n, m = (np.bincount(back, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (0, 1))
    every, word = keys == 0, (keys & np.uint64(3)) == 2
    kept = (n >= least) & ~every
    total = (int(n[every].sum()), int(m[every].sum()), int(n[kept & word].sum()), int(m[kept & word].sum()), int((kept & word).sum()))
    n, m = n * kept, m * kept
    ends = np.cumsum([len(p[2]) for p in parts])
    out = [(chunk, rows["bucket"].iloc[0], pack(n[own], m[own]), *[0] * 5) for chunk, own in zip(rows["chunk"], np.split(back, ends[:-1]))]
    return pd.DataFrame([*out, (-1, -1, None, *total)], columns=["chunk", "bucket", "blob", "n", "m", "known_n", "known_m", "words"])


def _score(part: pd.DataFrame, found: pd.DataFrame, mix: float, smooth: float) -> pd.DataFrame:
    """Losses of a chunk's documents by the sums that came back, which stand in the order of its keys."""
    read = [_keys()(part["_text"].iloc[lo : lo + 200]) for lo in range(0, len(part), 200)]
    # the pair at the first word of a text is 0, the key of every word
    key, place = np.unique(np.concatenate([x for words, pairs, _ in read for x in (words, pairs)]), return_inverse=True)
    answers = [unpack(b) for b in found.sort_values("bucket")["blob"]]
    n, m = (np.concatenate([a[i] for a in answers] + [np.zeros(0, np.int64)]) for i in (0, 1))
    if len(n) != len(key):
        raise ValueError(f"a chunk has {len(key)} keys and got the sums of {len(n)}")
    sums = found["sums"].iloc[0] if len(found) else {"n": 0, "m": 0, "known_n": 0, "known_m": 0, "words": 0}
    # a column more, for what is not there
    seen = np.concatenate([np.stack([m, n]).astype(float), np.zeros((2, 1))], axis=1)
    total, known = np.array([sums["m"], sums["n"]], float), np.array([sums["known_m"], sums["known_n"]], float)
    rest, over = np.maximum(0.0, total - known), total + smooth * (sums["words"] + 1)
    out, lo = [], 0
    for words, pairs, sizes in read:
        at, pair = place[lo : lo + len(words)], place[lo + len(words) : lo + 2 * len(words)]
        lo += 2 * len(words)
        pair = np.where(pairs == 0, len(key), pair)
        own = np.where(seen[1, at] > 0, seen[:, at], rest[:, None])
        p = (own + smooth) / over[:, None]
        # a context that a model hardly saw leans on the unigrams: absolute weight `smooth` a context
        after = np.minimum(1.0, seen[:, pair[1:]] / (own[:, :-1] + smooth))
        p *= 1 - mix
        p[:, 1:] += mix * after
        logs = np.concatenate([np.zeros((2, 1)), np.cumsum(-np.log(p), axis=1)], axis=1)
        ends = np.cumsum(sizes)
        out.append(((logs[:, ends] - logs[:, ends - sizes]) / np.maximum(1, sizes), sizes))
    loss, n = np.concatenate([x for x, _ in out], axis=1), np.concatenate([x for _, x in out])
    return pd.DataFrame({"_id": part["_id"], "n_tokens": n, "target_loss": loss[0], "background_loss": loss[1]})


def scored(docs: DataFrame, trusted: DataFrame, *, least: int = 2, mix: float = 0.7, smooth: float = 0.5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, `n_tokens`, mean loss per token of both models, and their `difference`.

    Background: every document. Target: every document whose id is in `trusted`. All words and pairs that stand
    `least` times in all documents have their own probabilities, in the target or not; a rarer word counts as the
    unknown word. Null and empty texts have no token and losses of 0. Rows that repeat an id, or have none,
    are documents of their own; a null id is never in the target. Equal texts get equal losses; no order
    matters, so there are no ties. Without any document there are no rows, without target ids its losses come from the
    smoothing alone. Only id and text are read, whatever other columns are called.
    """
    kind = docs.schema[doc].dataType
    chunks = 1 + int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]) // CHUNK
    bits = max(BUCKETS, chunks).bit_length()
    # ids travel as text: pandas would turn whole numbers beside a null into floats
    own = docs.select(F.col(doc).cast("string").alias("_id"), F.col(text).alias("_text"))
    own = own.withColumn("key", F.xxhash64("_id", "_text")).withColumn("chunk", F.pmod("key", F.lit(chunks)).cast("int"))
    target = trusted.select(F.col(doc).cast("string").alias("_id")).distinct()
    good = own.select("_id", "key", "chunk").join(target, "_id").select(F.col("chunk").alias("of"), F.col("key").alias("good")).distinct()
    # the documents by chunk are used twice below and shuffled once
    counted = own.groupBy("chunk").cogroup(good.groupBy("of")).applyInPandas(lambda part, some: _count(part, some, bits), "bucket long, chunk int, blob binary")
    added = counted.groupBy("bucket").applyInPandas(lambda rows: _add(rows, least), "chunk int, bucket long, blob binary, n long, m long, known_n long, known_m long, words long")
    sums = added.where("chunk = -1").agg(F.struct(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "m", "known_n", "known_m", "words")]).alias("sums"))
    answers = added.where("chunk >= 0").select("chunk", "bucket", "blob", sums.scalar().alias("sums"))
    out = own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda part, found: _score(part, found, mix, smooth) if len(part) else pd.DataFrame(columns=["_id", "n_tokens", "target_loss", "background_loss"]),
        "_id string, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss")).withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", doc)


@query("op10_lm_scoring")
def op10(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
