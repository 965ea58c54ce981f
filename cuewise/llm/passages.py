"""Substring dedup: paragraphs matched by MinHash banding, verified by exact Jaccard, removed by components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import components, raw, saved
from cuewise.llm.jaccard import BLOCK, candidates, clustered, verified
from cuewise.llm.registry import query, table

#: Words of a shingle; words of a window and grams that it is picked from. A shared run of
#: WINDOW + PICK - 1 = 51 words or more always holds a window that is picked in every copy of it.
SHINGLE, WINDOW, PICK = 5, 28, 24
#: Words that a line must have to be compared by itself; blocks of lines have SHINGLE words or more.
LEAST = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tuned(alike: float = 0.8, recall: float = 0.97, most: int = 20) -> tuple[int, int]:
    """`(bands, rows)`: the most selective banding of at most `most` hashes that finds pairs at `alike` with `recall`."""
    fits = []
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - alike**rows) - 1e-9)
        if bands * rows <= most:
            fits.append((rows, bands))
    rows, bands = max(fits)
    return bands, rows


def _slid(v: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over every `width` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        v = pick(v[:-step], v[step:])
        done += step
    return v


def picked(grams: np.ndarray) -> np.ndarray:
    """Places of the least gram of every PICK neighbours (all places where there are fewer: the least)."""
    if len(grams) <= PICK:
        return np.array([int(grams.argmin())])
    low = _slid(grams, PICK, np.minimum)
    edge = np.zeros(PICK - 1, np.uint64)
    return np.flatnonzero(_slid(np.concatenate([edge, low, edge]), PICK, np.maximum) == grams)


class Reader:
    """Words, shingles and units of texts, as hashes; many texts at a time."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(2024)
        self.mult = draw.integers(1, 1 << 62, bands * rows, dtype=np.uint64)[:, None] | np.uint64(1)
        self.add = draw.integers(1, 1 << 62, bands * rows, dtype=np.uint64)[:, None]
        self.power = np.cumprod(np.full(WINDOW, _MIX))

    def words(self, words: list[bytes]) -> np.ndarray:
        # hashing a short word anew costs less than looking it up
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def shingles(self, h: np.ndarray) -> np.ndarray:
        n = max(0, len(h) - SHINGLE + 1)
        g = np.zeros(n, np.uint64)
        for k in range(SHINGLE if n else 0):
            g = (g ^ h[k : n + k]) * _MIX
            g ^= g >> np.uint64(31)
        return g

    def prints(self, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the shingles between the even and the odd places of `at`: sums, so order doesn't matter; odd, so never 0."""
        mixed = (g ^ (g >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return np.add.reduceat(np.append(mixed ^ (mixed >> np.uint64(33)), np.uint64(0)), at)[::2] | np.uint64(1)

    def units(self, texts: list):
        """`(doc, keys, start, length, fp)` arrays, `doc` an index into `texts`: a row per picked window (fp 0),
        and one per band of each paragraph (fp: fingerprint of its shingles). Paragraphs are the blocks between
        blank lines of at least SHINGLE words, the lines of at least LEAST words, and a whole text of several
        blocks that is too short for a window."""
        flat: list[bytes] = []
        docs, starts, sizes, offsets, picks = [], [], [], [], []
        for d, text in enumerate(texts):
            offsets.append(len(flat))
            block, lines, blocks = len(flat), 0, 0
            for line in [*raw(text).lower().split(b"\n"), b""]:
                words = line.split()
                found = []
                if words:
                    lines += 1
                    if len(words) >= LEAST:
                        found = [(len(flat), len(words))]
                    flat += words
                elif lines:
                    size = len(flat) - block
                    if size >= SHINGLE and (lines > 1 or size < LEAST):
                        found = [(block, size)]
                    block, lines, blocks = len(flat), 0, blocks + 1
                for at, size in found:
                    docs.append(d)
                    starts.append(at)
                    sizes.append(size)
            if blocks > 1 and SHINGLE <= len(flat) - offsets[d] < WINDOW:
                docs.append(d)
                starts.append(offsets[d])
                sizes.append(len(flat) - offsets[d])
        offsets.append(len(flat))
        h = self.words(flat)
        g = self.shingles(h)
        owner = []
        for d in range(len(texts)):
            n = offsets[d + 1] - offsets[d] - WINDOW + 1
            if n > 0:
                at = picked(g[offsets[d] : offsets[d] + n]) + offsets[d]
                picks.append(at)
                owner.append(np.full(len(at), d))
        offset = np.array(offsets)
        out = []
        if picks:
            at, own = np.concatenate(picks), np.concatenate(owner)
            keys = np.zeros(len(at), np.uint64)
            for k in range(WINDOW):
                keys += h[at + k] * self.power[k]
            keys = (keys ^ (keys >> np.uint64(29))) * _MIX
            out.append((own, keys, at - offset[own], np.full(len(at), WINDOW), np.zeros(len(at), np.uint64)))
        if docs:
            doc, start, size = np.array(docs), np.array(starts), np.array(sizes)
            ends = np.stack([start, start + size - SHINGLE + 1], 1).ravel()
            low, mixed = [], np.zeros(len(g) + 1, np.uint64)
            for mult, add in zip(self.mult, self.add):
                # one hash at a time, in one array that stays in the cache
                np.multiply(g, mult, out=mixed[:-1])
                mixed[:-1] += add
                mixed[:-1] >>= np.uint64(7)
                low.append(np.minimum.reduceat(mixed, ends)[::2])
            low = np.stack(low).reshape(self.bands, self.rows, len(doc))
            key = np.repeat(np.arange(1, self.bands + 1, dtype=np.uint64)[:, None], len(doc), 1)
            for r in range(self.rows):
                key = (key ^ low[:, r]) * _MIX
                key ^= key >> np.uint64(31)
            again = lambda x: np.tile(x, self.bands)
            out.append((again(doc), key.ravel(), again(start - offset[doc]), again(size), again(self.prints(g, ends))))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else None


def _units(rows: DataFrame, bands: int, per: int, full: bool) -> DataFrame:
    """Units of rows `(doc, text)`: `(key, doc)`, and with `full` also `start, n, fp`."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        read = Reader(bands, per)
        for b in batches:
            ids, texts = b["doc"].to_numpy(), b["text"].tolist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and size < 250_000:
                    size += len(texts[hi])
                    hi += 1
                u = read.units(texts[lo:hi])
                if u is not None:
                    own, keys, start, n, fp = u
                    got = {"key": keys.view(np.int64), "doc": ids[lo:hi][own]}
                    yield pd.DataFrame(got | {"start": start, "n": n, "fp": fp.view(np.int64)} if full else got)
                lo = hi

    return rows.mapInPandas(run, f"key long, doc {kind}" + (", start int, n int, fp long" if full else ""))


def numbered(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with an id, `(doc, text)`, and rows without one, `(row, text)`, numbered and saved so that the numbers stay."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    return rows.where("doc IS NOT NULL"), saved(rows.where("doc IS NULL").select(F.monotonically_increasing_id().alias("row"), "text"))


def _all_units(rows: DataFrame, lone: DataFrame, bands: int, per: int, full: bool) -> DataFrame:
    """`_units` of rows with and without id, by `doc` and `row`, one of which is null."""
    a = _units(rows, bands, per, full).withColumn("row", F.lit(None).cast("long"))
    b = _units(lone.select(F.col("row").alias("doc"), "text"), bands, per, full).withColumnRenamed("doc", "row")
    return a.unionByName(b.withColumn("doc", F.lit(None).cast(rows.schema["doc"].dataType)))


def _several(units: DataFrame, *by: str, **more: Column) -> DataFrame:
    """Groups of `units` that stand in more than one document."""
    ends = [f(c).alias(f"_{k}_{c}") for c in ("doc", "row") for k, f in (("lo", F.min), ("hi", F.max))]
    two = "_lo_doc <> _hi_doc OR _lo_row <> _hi_row OR (_lo_doc IS NOT NULL AND _lo_row IS NOT NULL)"
    return units.groupBy(*by).agg(*ends, *[c.alias(k) for k, c in more.items()]).where(two).select(*by, *more)


def _sets(wanted: DataFrame, spots: DataFrame, rows: DataFrame, lone: DataFrame, bands: int, per: int) -> DataFrame:
    """`(fp, n, shingles)` of the paragraphs in `wanted (fp)`; `spots (fp, doc, row, start, n)` says where one of each stands."""
    at = saved(wanted.join(spots, "fp").groupBy("doc", "row").agg(F.collect_list(F.struct("fp", "start", "n")).alias("at")))
    of = lambda x, c: x.join(at.where(F.col(c).isNotNull()).select(F.col(c).alias("_d"), "at"), F.col(c) == F.col("_d")).select("text", "at")
    text = of(rows, "doc").union(of(lone, "row"))

    def read(batches):
        r = Reader(bands, per)
        for b in batches:
            out = []
            for t, at in zip(b["text"], b["at"]):
                h = r.words(raw(t).lower().split())
                for spot in at:
                    g = r.shingles(h[spot["start"] : spot["start"] + spot["n"]])
                    if r.prints(g, np.array([0, len(g)])).view(np.int64)[0] == spot["fp"]:
                        s = np.unique(g)
                        out.append((spot["fp"], len(s), s.tobytes()))
            yield pd.DataFrame(out, columns=["fp", "n", "shingles"])

    return saved(text.mapInPandas(read, "fp long, n long, shingles binary").dropDuplicates(["fp"]))


def repeats(docs: DataFrame, *, percent: int = 80, recall: float = 0.9999, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches `(doc, row, start, n, class, line, removed)` of words that stand in more than one document.

    Units are paragraphs (blocks between blank lines of SHINGLE words or more, lines of LEAST or more, short whole
    texts), alike from a Jaccard similarity of `percent` / 100 on five-word shingles, and, for passages inside
    longer paragraphs, equal windows of WINDOW words at picked places. Equal paragraphs count as one; different
    ones that collide in a band are compared as pairs where few collide, and block by block where many do. The
    bands let a pair just at the limit collide with a probability of `recall`, more similar ones with a higher
    one. Classes are connected components; the first occurrence of a class, by id (null ids last) and place,
    stays and the others are `removed`.
    Texts of fewer than SHINGLE words have no units. Rows that repeat an id are one document; each row without
    id is a document of its own, with a number in `row`. Repeats inside one document don't count. Extra columns
    are ignored.
    """
    return repeats_of(*numbered(docs, doc, text), percent=percent, recall=recall)


def repeats_of(rows: DataFrame, lone: DataFrame, *, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """`repeats` of what `numbered` gave."""
    bands, per = tuned(percent / 100, recall, 40)
    rows, lone = rows.where("text IS NOT NULL"), lone.where("text IS NOT NULL")
    keys = _several(_all_units(rows, lone, bands, per, False), "key")
    # saved, so that a key of very many units is a skewed join that the engine can split
    hit = saved(_all_units(rows, lone, bands, per, True).join(saved(keys), "key"))
    lines = hit.where("fp <> 0")
    found = saved(candidates(lines.select(F.col("key").alias("shingle"), "fp", F.lit(1).cast("long").alias("n")).distinct(), percent))
    pairs, stars = (saved(found.where(c).select("a", "b").distinct()) for c in ("na IS NOT NULL", "na IS NULL"))
    spots = lines.groupBy("fp").agg(F.min(F.struct("doc", "row", "start", "n")).alias("_s")).select("fp", "_s.doc", "_s.row", "_s.start", "_s.n")
    sets = _sets(pairs.union(stars).select(F.explode(F.array("a", "b")).alias("fp")).distinct(), spots, rows, lone, bands, per)
    labels = components(saved(verified(pairs, sets, percent).union(clustered(stars, sets, percent, BLOCK))))
    place = ["doc", "row", "start", "n"]
    own = lines.select(*place, "fp").distinct()
    own = own.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(*place, F.coalesce("label", "fp").alias("class"), F.lit(True).alias("line"))
    every = saved(own.union(hit.where("fp = 0").select(*place, F.col("key").alias("class"), F.lit(False).alias("line")).distinct()))
    # null ids last
    first = _several(every, "class", "line", _f=F.min(F.struct(F.col("doc").isNull().alias("late"), "doc", "row", "start")))
    out = every.join(first, ["class", "line"])
    stays = F.col("doc").eqNullSafe(F.col("_f.doc")) & F.col("row").eqNullSafe(F.col("_f.row")) & (F.col("start") == F.col("_f.start"))
    return out.select(*place, "class", "line", (~stays).alias("removed"))


def covered(spans: DataFrame, name: str) -> DataFrame:
    """`(doc, row, name)`: words under the spans `(doc, row, start, n)` of each document, each word once."""
    end = F.col("start") + F.col("n")
    one = spans.groupBy("doc", "row", "start").agg(F.max(end).alias("end"))
    past = F.coalesce(F.max("end").over(Window.partitionBy("doc", "row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return one.withColumn("_p", past).groupBy("doc", "row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_p"))).cast("long").alias(name))


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    return classified(table(spark, sf_dir, "documents"))


def classified(docs: DataFrame) -> DataFrame:
    """One row per document: the classes of its repeated stretches (none, and no places, where it has none) and the words under them."""
    rows, lone = numbered(docs)
    found = saved(repeats_of(rows, lone))
    sums = found.groupBy("doc", "row").agg(F.sort_array(F.collect_set("class")).alias("class_ids"), F.min("start").cast("long").alias("first_word"), F.max(F.col("start") + F.col("n")).cast("long").alias("end_word"))
    every = rows.select("doc", F.lit(None).cast("long").alias("row")).distinct().union(lone.select(F.lit(None).cast(rows.schema["doc"].dataType), "row"))
    # one key, never null, in place of two that may be
    key = F.concat(F.when(F.col("doc").isNull(), "row ").otherwise("id "), F.coalesce(F.col("doc").cast("string"), F.col("row").cast("string")))
    out = every.withColumn("_of", key)
    for side in (sums, covered(found, "repeated_words"), covered(found.where("removed"), "removed_words")):
        out = out.join(side.withColumn("_of", key).drop("doc", "row"), "_of", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    ids = F.coalesce("class_ids", F.array().cast("array<long>"))
    return out.select(F.col("doc").alias("doc_id"), F.size(ids).cast("long").alias("n_classes"), ids.alias("class_ids"), "first_word", "end_word", none("repeated_words"), none("removed_words"))
