"""Language of a text: bit-sliced Bloom filter over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.registry import query, table

#: Characters that are worked on at a time, and n-grams that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 1 << 21
#: Whether a code point is a letter, for all of them.
_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def grams(text: str, n: int):
    """Hashes of the n-grams of the lower-cased letters, runs of anything else being one space; piece by piece."""
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[max(0, at - n + 1) : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTER[c]
        if not letter.any():
            continue
        c = np.where(letter, c, 32)
        c = c[letter | np.concatenate([[True], letter[:-1]])]
        # a space at both ends of the text, none between pieces
        c = np.concatenate([[32] * (n - 1 if len(c) < n else at == 0), c, [32] * (at + PIECE >= len(text))]).astype(np.uint64)
        h = np.zeros(len(c) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * _MIX[0]
            h ^= h >> np.uint64(29)
        yield h


def _slots(h: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    return [((h * _MIX[1] + np.uint64(i) * (h * _MIX[2] | np.uint64(1))) >> np.uint64(20)) & np.uint64(size - 1) for i in range(hashes)]


@dataclass
class LanguageFilter:
    """`bits[slot, word]` holds, sliced by bit, which languages have a gram at that slot. Its size is set by
    the share a gram must have in its language, so it doesn't grow with the documents."""

    langs: list[str]
    prior: str
    n: int
    hashes: int
    bits: np.ndarray

    def __post_init__(self):
        slices = [self._slice(self.bits, i).mean() for i in range(len(self.langs))]
        self.false = np.array(slices) ** self.hashes

    def _slice(self, masks: np.ndarray, i: int) -> np.ndarray:
        width = self.bits.dtype.itemsize * 8
        return (masks[:, i // width] >> self.bits.dtype.type(i % width)) & self.bits.dtype.type(1)

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """n-grams of a text, and by language how many the filter holds, less the expected false positives."""
        total, hits = 0, np.zeros(len(self.langs))
        for h in grams(text, self.n):
            masks = None
            for at in _slots(h, self.hashes, len(self.bits)):
                got = self.bits[at.astype(np.int64)]
                masks = got if masks is None else masks & got
            hits += [int(self._slice(masks, i).sum()) for i in range(len(self.langs))]
            total += len(h)
        return total, np.maximum(0.0, (hits - total * self.false) / np.maximum(1e-9, 1 - self.false))

    def decide(self, text) -> tuple[str, float, int]:
        """Language, share of the n-grams that speak for it, n-grams. Ties go to the first language by name."""
        if not isinstance(text, str) or not self.langs:
            return "und", 0.0, 0
        total, own = self.counts(text)
        if not total:
            return "und", 0.0, 0
        if not own.any():
            return self.prior, 0.0, total
        best = int(own.argmax())
        return self.langs[best], float(min(1.0, own[best] / total)), total


def gram_counts(docs: DataFrame, n: int) -> DataFrame:
    """`(lang, gram, n)` over rows `(lang, text)`: counted in the tasks, then summed by gram."""

    def count(batches):
        held, size = {}, 0

        def out():
            for lang, parts in held.items():
                g, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": c})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                for h in grams(text, n):
                    held.setdefault(lang, []).append(h)
                    size += len(h)
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return docs.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, *, n: int = 4, least: float = 2e-5, contrast: float = 0.25, hashes: int = 4, room: int = 16, lang: str = "lang", text: str = "text") -> LanguageFilter:
    """Learned from every row with a text and a language.

    A language holds an n-gram whose share of the language's n-grams reaches `least` (so at most 1 / `least`
    a language, which bounds what reaches the driver) and `contrast` times its largest share in any language
    (a few foreign words don't count). The filter has `room` slots for each n-gram held.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = gram_counts(rows, n).persist()
    sums = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # per gram, one row with its counts by language; the number of languages is small
    shares = counted.join(sums, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= least * contrast)
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    held = shares.where(F.col("share") >= least).join(top, "gram").where(F.col("share") >= contrast * F.col("top")).select("lang", "gram").toPandas()
    totals = sums.toPandas().sort_values(["total", "lang"], ascending=[False, True])
    counted.unpersist()
    langs = sorted(totals["lang"])
    size = 1 << max(10, int(np.ceil(np.log2(max(1, len(held)) * room))))
    kind = next(t for w, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (10**9, np.uint64)) if len(langs) <= w)
    width = np.dtype(kind).itemsize * 8
    bits = np.zeros((size, max(1, -(-len(langs) // width))), kind)
    for i, name in enumerate(langs):
        h = held.loc[held["lang"] == name, "gram"].to_numpy().view(np.uint64)
        for at in _slots(h, hashes, size):
            bits[at.astype(np.int64), i // width] |= kind(1 << (i % width))
    return LanguageFilter(langs, totals["lang"].iloc[0] if langs else "und", n, hashes, bits)


def identify(docs: DataFrame, model: LanguageFilter, *, doc: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row per row of `docs`: its id, `more`, `lang_pred, score, n_grams`.

    Null texts and texts without a letter are `und` with score 0; a text none of whose n-grams is known gets
    the most frequent language and score 0; without any learned language everything is `und`. Of equally likely
    languages the first by name is taken. Each row is decided for itself, repeated ids or not. Whole texts
    are read, in pieces. Only id and text are read, so extra columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc].dataType
    # ids travel as text: pandas would turn whole numbers beside a null into floats
    rows = docs.select(F.col(doc).cast("string").alias("_id"), F.col(text).alias("_text"), *[c.alias(k) for k, c in more.items()])
    kept = rows.drop("_text").schema

    def score(batches):
        for batch in batches:
            got = [shared.value.decide(t) for t in batch["_text"]]
            yield batch.drop(columns="_text").assign(lang_pred=[x[0] for x in got], score=[float(x[1]) for x in got], n_grams=[x[2] for x in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInPandas(score, schema + ", lang_pred string, score double, n_grams long").withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", doc)


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(docs, fit(docs.where(~held_out)), held_out=held_out).select("doc_id", "held_out", "lang_pred", "score", "n_grams")
