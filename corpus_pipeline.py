"""Corpus pipeline: rules, near duplicates, benchmark passages, secrets, then a mix of the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm.common import saved, within, without
from cuewise.llm.decontamination import contaminated
from cuewise.llm.jaccard import linked_components
from cuewise.llm.mixing import taken
from cuewise.llm.quality_rules import scored, trusted_ids
from cuewise.llm.registry import table
from cuewise.llm.secrets import scan


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    own = {f"_doc_{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    rows = scored(docs, trusted_ids(table(spark, sf_dir, "labels")), **own).where("kept")
    return rows.select(*[F.col(k).alias(c) for k, c in zip(own, docs.columns)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles, similarity 0.8, the document with the smallest id; of rows equal in id and text one."""
    found = saved(linked_components(docs, size=5, percent=80).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "component_id"))
    gone = found.where(~F.col("component_id").eqNullSafe(F.col("_id"))).select("_id", "_key")
    again = found.groupBy("_id", "_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_id", "_key")
    again = saved(without_keys(again, gone))
    rest = without(docs, gone.union(again))
    return rest.union(within(docs, again).dropDuplicates(["doc_id", "text"]))


def without_keys(keys: DataFrame, gone: DataFrame) -> DataFrame:
    return keys.join(gone.toDF("_i", "_k").distinct(), F.col("_id").eqNullSafe(F.col("_i")) & F.col("_key").eqNullSafe(F.col("_k")), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark text."""
    return without(docs, saved(contaminated(docs, table(spark, sf_dir, "benchmark"))))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a confirmed secret."""
    found = scan(docs, _id=F.col("doc_id"), _key=F.xxhash64("text")).where("secret")
    return without(docs, saved(found.select("_id", "_key").distinct()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return taken(docs).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The forest of the secret scan has no SQL form; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
