"""Per-team manifest kept as rows keyed (team, video)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(manifest: DataFrame, updates: DataFrame, flags: DataFrame) -> DataFrame:
    """Latest record per key; re-processing resets both flags; flags turn true only for known keys.

    manifest: team_id, video_id, chars, has_chunks, has_embeddings. updates: the same keys,
    chars, version. Latest-wins is an aggregate, so a busy team is combined before the shuffle.
    """
    old = manifest.select("team_id", "video_id", F.lit(-1).cast("long").alias("version"), "chars", "has_chunks", "has_embeddings")
    new = updates.select("team_id", "video_id", F.col("version").cast("long").alias("version"), "chars", F.lit(False).alias("has_chunks"), F.lit(False).alias("has_embeddings"))
    rec = F.struct("version", "chars", "has_chunks", "has_embeddings")
    latest = old.unionByName(new).groupBy("team_id", "video_id").agg(F.max(rec).alias("r")).select("team_id", "video_id", "r.*")
    mark = flags.select("team_id", "video_id").distinct().withColumn("_f", F.lit(True))
    done = F.coalesce("_f", F.lit(False))
    return latest.join(mark, ["team_id", "video_id"], "left").select(
        "team_id", "video_id", "chars", (F.col("has_chunks") | done).alias("has_chunks"), (F.col("has_embeddings") | done).alias("has_embeddings"))


def first_existing(candidates: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Lines of the first candidate, in list order, that has a non-blank line for the key.

    Candidates are rows `(key, pos, line)`: a text stays one row per line, whatever its length. Only
    the rank of the chosen candidate is aggregated per key.
    """
    tagged = None
    for rank, (name, df) in enumerate(candidates):
        part = df.select(key, F.lit(rank).alias("_rank"), F.lit(name).alias("source"), "pos", "line")
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.where(F.trim("line") != "").groupBy(key).agg(F.min("_rank").alias("_rank"))
    return tagged.join(best, [key, "_rank"], "left_semi").drop("_rank")


def safe_double(c: Column) -> Column:
    """Number of a text, 0 when it is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))
