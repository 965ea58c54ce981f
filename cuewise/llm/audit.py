"""Filter interaction audit: which filter removes what in which order, from one additive table of masks.

One pass over the texts gives each document its mask of failed text filters and a hash of its text. A counting
Bloom filter over these hashes, merged from the tasks' own sketches, clears the texts that stand once for
certain; only the others are shuffled as full texts, for the smallest id of each. The flags meet labels and
smallest ids by document id and are summed per part and mask; all orders are read off those sums.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import saved
from cuewise.llm.registry import query, table

FILTERS = "ABCDE"
SHORT, FEW, CAPITALS, MARKED, REPEATED = (1 << i for i in range(5))
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Counters of one segment of the sketch, counters per document, and probes of one hash.
SEGMENT, PER_DOC, PROBES = 1 << 16, 16, 3
#: Bits of the merged sketch that may be broadcast (64 MB); beyond, hashes are counted by a shuffle of their own.
MOST_BITS = 1 << 29
#: Hashes that a task holds before it hands its sketch on.
HELD = 1 << 20


def mask_of(text: bytes, points: int) -> int:
    """Text filters that a text of `points` code points fails."""
    words = text.split()
    n = len(words)
    out = SHORT if n < 50 else 0
    if 100 * len(set(words)) < 65 * n:
        out |= FEW
    if 100 * (len(text) - len(text.translate(None, UPPER))) > 5 * points:
        out |= CAPITALS
    return out | MARKED if len(text.translate(None, MARKS)) < len(text) else out


def flagged(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`doc, part, h, mask`: one row per row of `docs`; null texts and sources count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.xxhash64(t).alias("h"), t.alias("t"))

    def run(batches):
        for b in batches:
            t = b.column("t")
            masks = [mask_of(x, n) for x, n in zip(t.cast(pa.binary()).to_pylist(), pc.utf8_length(t).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("part"), b.column("h"), pa.array(masks, pa.int32())], ["doc", "part", "h", "mask"])

    return rows.mapInArrow(run, rows.drop("t").schema.add("mask", "integer"))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Counters of each hash, one row per probe; `bits` is a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])


def _sketch(h: np.ndarray, bits: int):
    """Per segment, the counters that the hashes raise; one raised twice or more is listed twice."""
    at, n = np.unique(_places(h, bits).ravel(), return_counts=True)
    at = np.repeat(at, np.minimum(n, 2))
    part = (at // np.uint64(SEGMENT)).astype(np.int32)
    for s, rows in zip(*_groups(part, (at % np.uint64(SEGMENT)).astype(np.uint16))):
        yield int(s), rows.tobytes()


def _groups(keys: np.ndarray, values: np.ndarray):
    """Values of each run of equal keys."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.split(values, first[1:]) if len(keys) else []


def counting_bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the counters that stand at two or more, merged from a sketch per task. `hashes (h)`.

    A task sends each counter twice at most, so the copies of a hot text don't add up. One segment is
    merged at a time, and `bits` / 8 bytes reach the driver.
    """

    def count(batches):
        held, n = [], 0
        for b in batches:
            held.append(b["h"].to_numpy().view(np.uint64))
            n += len(b)
            if n >= HELD:
                yield pd.DataFrame(_sketch(np.concatenate(held), bits), columns=["segment", "places"])
                held, n = [], 0
        if n:
            yield pd.DataFrame(_sketch(np.concatenate(held), bits), columns=["segment", "places"])

    def merge(key, rows):
        n = np.bincount(np.frombuffer(b"".join(rows["places"]), np.uint16), minlength=SEGMENT)
        return pd.DataFrame({"segment": [key[0]], "many": [np.packbits(n > 1, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    parts = hashes.mapInPandas(count, "segment int, places binary").groupBy("segment").applyInPandas(merge, "segment int, many binary")
    for r in parts.toLocalIterator():
        at = r["segment"] * SEGMENT // 8
        out[at : at + SEGMENT // 8] = np.frombuffer(r["many"], np.uint8)
    return out


def with_maybe(flags: DataFrame, most_bits: int = MOST_BITS):
    """A function that adds the column `maybe` to rows with a hash `h`: false where the text stands once for certain.

    The sketch has 16 to 32 counters a document, so about one unique text in 200 is not cleared. It is
    broadcast up to `most_bits`; above, equal hashes are counted after a shuffle, and the rows joined with those
    that stand twice. Neither way changes a result.
    """
    spark = flags.sparkSession
    bits = max(SEGMENT, 1 << (PER_DOC * flags.count() - 1).bit_length())
    if bits > most_bits:
        twice = saved(flags.groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("maybe")))
        return lambda df: df.join(twice, "h", "left").fillna(False, ["maybe"])
    many = spark.sparkContext.broadcast(counting_bloom(flags.select("h"), bits))

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        at = _places(h.to_numpy().view(np.uint64), bits)
        set_ = (many.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(set_.all(axis=0))

    return lambda df: df.withColumn("maybe", found("h"))


def first_ids(docs: DataFrame, maybe, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc, firsts)`: ids that are the smallest of their text, with the hashes of those texts.

    Only texts that may repeat are here; each task sends one copy of a text, whatever the size of its group.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = maybe(docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), t.alias("t"), F.xxhash64(t).alias("h"))).where("maybe")
    lows = rows.groupBy("t").agg(F.min("doc").alias("doc"))
    return lows.groupBy("doc").agg(F.collect_set(F.xxhash64("t")).alias("firsts"))


def mask_counts(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source", most_bits: int = MOST_BITS) -> DataFrame:
    """`part, mask, n, good, toxic`: documents of each part that fail exactly the filters in `mask` (bits of ABCDE).

    A document with several labels is good, or toxic, if any of them says so.
    """
    flags = saved(flagged(docs, doc, text, source))
    maybe = with_maybe(flags, most_bits)
    known = labels.select(F.col("doc_id").alias("doc"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = known.where("good = 1 OR toxic = 1").groupBy("doc").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    own = maybe(flags.where("doc IS NOT NULL")).join(known, "doc", "left").join(first_ids(docs, maybe, doc, text), "doc", "left")
    again = F.col("maybe") & ~F.coalesce(F.array_contains("firsts", F.col("h")), F.lit(False))
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = own.select("part", F.when(again, F.col("mask").bitwiseOR(F.lit(REPEATED))).otherwise(F.col("mask")).alias("mask"), value("good").alias("good"), value("toxic").alias("toxic"))
    rows = rows.union(flags.where("doc IS NULL").select("part", "mask", F.lit(0), F.lit(0)))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _steps(filters: str) -> Column:
    """Every step of every order: the order, the step, the bit of its filter and the bits before it."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = [(("".join(o)), k + 1, bit[f], sum(bit[x] for x in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]
    return F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","k":{k},"b":{b},"p":{p}}}' for o, k, b, p in rows) + "]"), "array<struct<o string, k int, b int, p int>>")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the sums per mask.

    A part has at most 2^5 masks, so a part of any size is 32 rows here. A filter's `shapley` is its number of
    removals over all orders: a document that fails k filters falls to each of them in 5!/k orders.
    """
    orders = len(list(permutations(filters)))
    rows = counts.select("part", "mask", "n", "good", "toxic", F.explode(_steps(filters)).alias("_s")).select("*", "_s.*").drop("_s")
    fails, before = F.col("mask").bitwiseAND(F.col("b")) != 0, F.col("mask").bitwiseAND(F.col("p")) != 0
    total = lambda cond, value="n": F.sum(F.when(cond, F.col(value)).otherwise(0)).cast("long")
    share = F.when(fails, (F.col("n") * F.expr(f"{orders} div bit_count(mask)"))).otherwise(0)
    return rows.groupBy("part", F.col("o").alias("filter_order"), F.col("k").alias("step")).agg(
        total(~before & ~fails).alias("kept"), total(~before & fails).alias("removed"), total(before & fails).alias("redundant"), total(F.col("mask") == F.col("b")).alias("unique_fails"),
        total(~before & fails, "good").alias("good_lost"), total(~before & fails, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))


def audited(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """Per part, each of the 120 orders of the filters A to E and each step: documents kept, removed, redundant and so on.

    A: under 50 words. B: under 65 distinct words of 100. C: over 5 capitals A-Z of 100 code points. D: holds one
    of `#$%&*|`. E: some smaller id has the same text. Null and empty texts are equal texts without words
    and fail A only, but for E. Each row is a document: rows that repeat an id have a flag each, and of equal
    rows none is smaller, so ties never fail E. A null id is smaller than none and larger than none, and has no
    label. Null and empty sources are the part ''. Labels without document don't count; without documents there
    are no rows. Extra columns are not read.
    """
    return audit(mask_counts(docs, labels, **names))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT *, contains(fails, c) AS hit, length(translate(before, fails, '')) < length(before) AS gone FROM g, s),
t AS (
  SELECT part, filter_order, step, any_value(c) AS c, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = c THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM t
"""


@query("op11_filter_audit", SQL)
def op11(spark, sf_dir):
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
