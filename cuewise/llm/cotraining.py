"""Quality classifier: two views, co-trained, calibrated and combined."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import FOLD, drawn, raw
from cuewise.llm.registry import query, table

#: Hash buckets of the text view and of the words in the metadata view.
TEXT_BITS, META_BITS = 15, 12
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _hashed(parts: list[bytes], bits: int) -> np.ndarray:
    """Distinct buckets of some byte strings; CRC-32 repeats between processes."""
    from zlib import crc32

    h = np.fromiter((crc32(p) for p in parts), np.uint64, len(parts))
    return np.unique((h * _SEED) >> np.uint64(64 - bits)).astype(np.int32)


def text_view(text) -> np.ndarray:
    """Buckets of the content: words, with punctuation as it stands and folded."""
    b = raw(text)
    return _hashed(list({*b.split(), *(b"~" + w for w in b.translate(FOLD).split())}), TEXT_BITS)


def meta_view(source, lang, text) -> np.ndarray:
    """Buckets of what the page says about itself: source, language, and its size and layout
    (binned), without any word of the content."""
    b = raw(text)
    n, words = len(b), len(b.split())
    lines = [x for x in b.split(b"\n") if x.strip()]
    marks = sum(b.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"!"))
    upper = n - len(b.translate(None, bytes(range(65, 91))))
    bins = {
        "size": int(np.log2(n + 1)), "words": int(np.log2(words + 1)), "lines": int(np.log2(len(lines) + 1)),
        "line": int(np.log2(n / max(1, len(lines)) + 1)), "marks": int(20 * min(1.0, marks / max(1, words))),
        "upper": int(10 * upper / max(1, n)), "stops": int(20 * min(1.0, (b.count(b".") + b.count(b",")) / max(1, words))),
        "same": int(10 * len(set(lines)) / max(1, len(lines))),
    }
    parts = [f"{k}={v}".encode() for k, v in bins.items()] + [b"source=" + raw(source), b"lang=" + raw(lang)]
    return _hashed(parts, META_BITS)


class Rows:
    """Sparse rows, flat; each row has length 1."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        sizes = np.array([len(a) for a in rows], np.int64)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.scale = 1.0 / np.sqrt(np.maximum(1, sizes))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n) * self.scale


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class View:
    """Logistic regression over hashed features, then a logistic calibration of its score."""

    bits: int
    w: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-4):
        w, bias, gw, gb = np.zeros(1 << self.bits), 0.0, np.full(1 << self.bits, 1e-8), 1e-8
        for _ in range(steps):
            err = (_sigmoid(rows.dot(w) + bias) - y) * weight / weight.sum()
            g = np.bincount(rows.at, (err * rows.scale)[rows.row], 1 << self.bits) + decay * w
            gw += g * g
            gb += err.sum() ** 2
            w -= rate * g / np.sqrt(gw)
            bias -= rate * err.sum() / np.sqrt(gb)
        self.w, self.bias = w, bias

    def calibrate(self, rows: Rows, y: np.ndarray, steps: int = 200):
        """Platt scaling on rows that the weights were not fitted on."""
        s = rows.dot(self.w) + self.bias
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            err = _sigmoid(a * s + b) - goal
            a, b = a - 0.5 * (err * s).mean() / max(1e-9, (s * s).mean()), b - 2.0 * err.mean()
        self.slope, self.shift = max(a, 1e-3), b

    def score(self, rows: Rows) -> np.ndarray:
        """Calibrated log odds."""
        return self.slope * (rows.dot(self.w) + self.bias) + self.shift


@dataclass
class Pair:
    text: View
    meta: View
    prior: float

    def probability(self, text_rows: Rows, meta_rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each view, and of both: log odds add up, less the prior that each of them holds."""
        a, b = self.text.score(text_rows), self.meta.score(meta_rows)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def cotrain(sample: pd.DataFrame, rounds: int = 4, share: float = 0.05, sure: float = 0.9) -> Pair | None:
    """Fitted on rows `(text, meta, label)`; label is null in the pool without labels.

    In each round each view, fitted and calibrated on what it has, hands its surest pool rows to the other
    view, at most `share` of the pool for each label and none below `sure`; the receiver learns them with
    half weight. A fourth of the labelled rows only calibrates. None if only one label is known.
    """
    known = sample["label"].notna().to_numpy()
    y = sample.loc[known, "label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    views = {k: View(bits) for k, bits in (("text", TEXT_BITS), ("meta", META_BITS))}
    cal = np.arange(len(y)) % 4 == 3
    if len(set(y[cal])) < 2 or len(set(y[~cal])) < 2:
        cal = np.zeros(len(y), bool)
    parts = {k: (sample.loc[known, k].tolist(), sample.loc[~known, k].tolist()) for k in views}
    pool = int((~known).sum())
    given = {k: {} for k in views}
    pools = {k: Rows(parts[k][1]) for k in views}
    held = {k: Rows([r for r, c in zip(parts[k][0], cal) if c or not cal.any()]) for k in views}
    goal = y[cal] if cal.any() else y
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y).mean())
    for turn in range(rounds + 1):
        for k, view in views.items():
            extra = list(given[k].items())
            rows = Rows([r for r, c in zip(parts[k][0], cal) if not c] + [parts[k][1][i] for i, _ in extra])
            labels = np.concatenate([y[~cal], [v for _, v in extra]])
            weight = np.concatenate([balance[~cal], np.full(len(extra), 0.5)])
            view.fit(rows, labels, weight)
            view.calibrate(held[k], goal)
        if turn == rounds or not pool:
            break
        for k, other in (("text", "meta"), ("meta", "text")):
            p = _sigmoid(views[k].score(pools[k]))
            most = max(1, int(share * pool))
            for label, order in ((1.0, np.argsort(-p, kind="stable")), (0.0, np.argsort(p, kind="stable"))):
                fresh = [i for i in order.tolist() if i not in given[other]][:most]
                given[other].update({i: label for i in fresh if (p[i] if label else 1 - p[i]) >= sure})
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return Pair(views["text"], views["meta"], float(np.log(rate / (1 - rate))))


def _views(text: pd.Series, source: pd.Series, lang: pd.Series):
    return [text_view(t) for t in text], [meta_view(s, g, t) for s, g, t in zip(source, lang, text)]


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = 4000, pool: int = 3000, label: str = "quality", **how) -> Pair | None:
    """Classifiers for `label` 0/1 (`labels` rows of `doc_id` and label), on about `labelled` labelled rows and
    a pool of about `pool` documents without label, both by hash; these bounds keep the driver's share fixed."""
    ids = drawn(labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("_y")), "doc_id", labelled)
    rate = pool / max(1, docs.count())
    keep = F.broadcast(ids.select(F.col("doc_id").alias("_id"), F.col("_y").cast("double")))
    rows = docs.select("doc_id", "text", "source", "lang").join(keep, F.col("doc_id") == F.col("_id"), "left")
    low = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rate))
    rows = rows.where(F.col("_y").isNotNull() | (F.col("doc_id").isNotNull() & low)).select("doc_id", "_y", "text", "source", "lang")

    def run(batches):
        for b in batches:
            t, m = _views(b["text"], b["source"], b["lang"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["_y"], "t": t, "m": m})

    got = rows.mapInPandas(run, "doc_id long, y double, t array<int>, m array<int>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return cotrain(pd.DataFrame({"text": got["t"], "meta": got["m"], "label": got["y"].to_numpy()}), **how)


def scored(docs: DataFrame, model: Pair | None, *, least: float = 0.3, **more: Column) -> DataFrame:
    """One row per row of `docs`: `more`, `text_score, meta_score, score` (0 to 1) and `kept` (score >= `least`).

    Every whole text is scored. Null or empty texts and null metadata are feature values like others; without
    a model (no labels of both kinds) all scores are 0.5 and everything is kept. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # ids and the like travel as text: pandas would turn whole numbers beside a null into floats
    kinds = docs.select(*[c.alias(k) for k, c in more.items()]).schema
    rows = docs.select(*[c.cast("string").alias(k) for k, c in more.items()], F.col("text").alias("_t"), F.col("source").alias("_s"), F.col("lang").alias("_l"))

    def run(batches):
        for b in batches:
            own = b.drop(columns=["_t", "_s", "_l"])
            if shared.value is None:
                yield own.assign(text_score=0.5, meta_score=0.5, score=0.5)
                continue
            for at in range(0, max(1, len(b)), 500):
                x = b.iloc[at : at + 500]
                t, m = _views(x["_t"], x["_s"], x["_l"])
                p, q, both = shared.value.probability(Rows(t), Rows(m))
                yield own.iloc[at : at + 500].assign(text_score=p, meta_score=q, score=both)

    schema = ", ".join(f"`{k}` string" for k in more)
    out = rows.mapInPandas(run, schema + ", text_score double, meta_score double, score double")
    return out.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in kinds}).withColumn("kept", F.col("score") >= least)


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")), doc_id=F.col("doc_id"))
