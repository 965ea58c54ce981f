"""Helpers shared by the operators: words, saved tables, bounded draws, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.session import shared_folder

#: White space of the word rule; the same six characters that `bytes.split()` splits at.
BLANK = r"[\x20\x09-\x0D]+"
#: What separates folded words: every ASCII character that is neither a digit nor a-z.
NOT_FOLDED = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For `bytes.translate`: A-Z to a-z, and everything in NOT_FOLDED to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: Column) -> Column:
    """Words as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII text takes the fast built-in, which then does the same."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)


def folded_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_FOLDED), "")


def raw(text) -> bytes:
    """UTF-8 of a text; none for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, gone: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` but those whose id and hash of the text are in `gone (_id, _key)`; null ids are ids."""
    return docs.join(gone, docs[doc].eqNullSafe(gone["_id"]) & F.xxhash64(docs[text]).eqNullSafe(gone["_key"]), "left_anti")


def within(docs: DataFrame, some: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `docs` whose id and hash of the text are in `some (_id, _key)`."""
    return docs.join(some, docs[doc].eqNullSafe(some["_id"]) & F.xxhash64(docs[text]).eqNullSafe(some["_key"]), "left_semi")


def drawn(rows: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """About `most` rows, by a hash of `key` that repeats; all where there are fewer. Rows without key are left out."""
    rows = rows.where(F.col(key).isNotNull())
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def components(edges: DataFrame) -> DataFrame:
    """`(node, label)`: the smallest node that each node of `(a, b)` long edges can reach.

    Smallest label of the neighbours, then a jump to the label's own label, until nothing changes.
    Only aggregates and equi-joins; a hub is a skewed join key and is split by the engine.
    """
    both = edges.select("a", "b").where("a <> b")
    both = saved(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("label")))
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_m"))
        low = now.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_m").alias("label"))
        step = saved(low)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        then = saved(step.join(up, "label", "left").select("node", "_old", F.least("label", "_up").alias("label")))
        if then.where("label <> _old").isEmpty():
            return then.select("node", "label")
        now = then.select("node", "label")
