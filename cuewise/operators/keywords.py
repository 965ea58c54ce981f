"""Keyword counts, topic lists and topic assignment."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Token patterns of the keyword rules.
WORDS4 = r"(?U)\b\w{4,}\b"
WORDS5 = r"(?U)\b\w{5,}\b"
HAN2_OR_WORD4 = r"[一-鿿]{2,}|(?U)\b[a-zA-Z0-9_]{4,}\b"


def words(text: Column, pattern: str = WORDS4) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def top_words(df: DataFrame, key: list[str], text: str, k: int, pattern: str = WORDS4, lower: bool = True) -> DataFrame:
    """Most frequent words per text, ties by first appearance: `(key…, rank, word, n)`.

    One text is one cell: where its key stands on no other row its words are counted there, and the texts alone
    are shuffled. The words of texts that share a key are counted together, by word.
    """
    source = F.lower(F.col("_text")) if lower else F.col("_text")
    one, more = single(df.select(*key, F.col(text).alias("_text")), key)
    first = _top_of_each(one.select(*key, words(source, pattern).alias("_words")), key, k)
    tokens = more.select(*key, F.posexplode(words(source, pattern)).alias("pos", "word"))
    counts = tokens.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "pos"))
    return first.unionByName(counts.withColumn("rank", rank).where(F.col("rank") <= k).select(*key, "rank", "word", "n", "pos"))


def top_lists(df: DataFrame, key: list[str], text: str, k: int) -> DataFrame:
    """The same words as one array a key, `(key.., top)`; texts without any word are left out."""
    one, more = single(df.select(*key, F.col(text).alias("_text")), key)

    @F.pandas_udf("array<string>")
    def top(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: [w for w, _ in Counter(ws).most_common(k)])

    found = one.select(*key, words(F.lower("_text")).alias("_words")).where(F.size("_words") > 0).select(*key, top("_words").alias("top"))
    return found.unionByName(top_words(more, key, "_text", k).groupBy(*key).agg(F.collect_list("word").alias("top")))


def single(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key stands on no other row, and the others."""
    rows = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return rows.where("_rows = 1").drop("_rows"), rows.where("_rows > 1").drop("_rows")


def _top_of_each(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """`top_words` of rows `(key.., _words)`, each by itself."""

    def run(batches):
        for b in batches:
            lists = b.column("_words").to_pylist()
            # words of equal counts keep the order in which they were found
            found = [Counter(ws or ()).most_common(k) for ws in lists]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in key] + [
                pa.array([r for f in found for r in range(1, len(f) + 1)], pa.int32()), pa.array([w for f in found for w, _ in f], pa.string()),
                pa.array([n for f in found for _, n in f], pa.int64()), pa.array([ws.index(w) for f, ws in zip(found, lists) for w, _ in f], pa.int32())], [*key, "rank", "word", "n", "pos"])

    return rows.mapInArrow(run, rows.select(*key).schema.add("rank", "integer").add("word", "string").add("n", "long").add("pos", "integer"))


def corpus_topics(texts: DataFrame, k: int) -> DataFrame:
    """One row with the k most frequent words of all texts and the first two as a phrase."""
    tokens = texts.select(F.explode(words(F.lower("text"), r"[\p{L}\p{N}_]{4,}")).alias("word"))
    top = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)
    # at most k rows are left, so one array cell holds them
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))), lambda x: x["word"])
    return top.agg(ordered.alias("t")).select(F.concat("t", F.array(F.concat_ws(" ", F.slice("t", 1, 2)))).alias("topics"))


def _hits(text: Column, word: Column) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word))


def assign_topics(blocks: DataFrame, topics: DataFrame) -> DataFrame:
    """Best topic per block by hits, partial hits, length and early mention; kept above a score of 15.

    `topics` is a single row with a short array, so joining it adds one bounded cell per block.
    The simple variant scores hits times length and keeps above 10. The earliest topic wins ties.
    """
    rows = blocks.select("doc_id", F.lower("text").alias("c")).join(F.broadcast(topics), how="cross")
    c = F.col("c")

    def score(topic: Column, pos: Column) -> Column:
        hits = _hits(c, topic)
        parts = F.split(topic, " ")
        partial = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, w: acc + _hits(c, w)) / F.size(parts)
        at = F.instr(c, topic)
        early = F.when(at > 0, F.lit(10.0) / at).otherwise(0.0)
        total = hits * 2.0 + partial + F.length(topic) * 0.1 + early
        return F.struct(total.alias("score"), (-pos).alias("neg"), topic.alias("topic"), (hits * F.length(topic)).alias("simple"))

    scored = rows.select("doc_id", F.transform("topics", lambda x, i: score(x, i)).alias("s"))
    best = F.array_max("s")
    simple = F.array_max(F.transform("s", lambda x: F.struct(x["simple"], x["neg"], x["topic"])))
    return scored.select("doc_id", best.alias("b"), simple.alias("m")).select(
        "doc_id", F.round("b.score", 9).alias("best_score"), F.when(F.col("b.score") > 15, F.col("b.topic")).alias("topic"),
        F.when(F.col("m.simple") > 10, F.col("m.topic")).alias("simple_topic"))
