"""Chapter lines in model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.text import strip
from cuewise.functions.timefmt import normalize_stamp

# The accepted line grammars.
DASHED = r"^(\d{2}:\d{2}:\d{2})$"
LOOSE = r"(?U)^\s*(?:[\-\*•]\s*)?\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?\s*(?:[\-–—:]\s*)?(.+?)\s*$"
ANY = r"(\d{1,2}:\d{2}(?::\d{2})?)"
CLOCK = r"(\d{2}:[0-5]\d:[0-5]\d)\b"


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "raw")).withColumn("line", strip(F.col("raw"))).where("line <> ''")


def _one_per_stamp(rows: DataFrame, key: str, last: bool) -> DataFrame:
    """One title per stamp; its place is that of the first line with the stamp."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(key, "stamp").agg(F.min("pos").alias("pos"), pick("title", "pos").alias("title"))


def parse_chapters(df: DataFrame, key: str, text: str, variant: str = "current") -> DataFrame:
    """Chapter rows `(key, pos, stamp, title)` of a reply text.

    current: `HH:MM:SS - title` lines (last title of a stamp wins); only a text without
             any falls back to bullet / bracket lines (first wins).
    legacy:  bullet / bracket lines (first wins); only a text without any falls back to
             any stamp in a line.
    clock:   the first HH:MM:SS of a line, all stamps cut from the title (last wins).
    """
    lines = _lines(df, key, text)
    line = F.col("line")
    if variant == "clock":
        rows = lines.where(F.col("raw").rlike(CLOCK)).select(
            key, "pos", F.regexp_extract("raw", CLOCK, 1).alias("stamp"),
            strip(F.regexp_replace(strip(F.regexp_replace("raw", CLOCK, "")), r"^[ \-:]+", "")).alias("title"))
        return _one_per_stamp(rows.where("title <> ''"), key, last=True)

    head = strip(F.regexp_extract(line, r"^(.*?) - (.*)$", 1))
    dashed = line.contains(" - ") & head.rlike(DASHED)
    loose = line.rlike(LOOSE)
    stamp = normalize_stamp(F.regexp_extract(line, LOOSE, 1))
    title = strip(F.regexp_extract(line, LOOSE, 2))
    found = F.regexp_extract(line, ANY, 1)
    at = F.instr(line, found)
    behind = strip(F.regexp_replace(F.substring(line, at + F.length(found), F.length(line)), r"^[ \-–—:\t]+", ""))
    before = strip(F.substring(line, F.lit(1), at - 1))

    def candidates(rank: int, ok: Column, stamp: Column, title: Column) -> Column:
        return F.when(ok, F.struct(F.lit(rank).alias("rank"), stamp.alias("stamp"), title.alias("title")))

    if variant == "current":
        first = candidates(1, dashed, head, strip(F.regexp_extract(line, r"^(.*?) - (.*)$", 2)))
        second = candidates(2, loose & (title != ""), stamp, title)
    else:
        first = candidates(1, loose & (title != ""), stamp, title)
        second = candidates(2, (found != "") & (F.when(behind != "", behind).otherwise(before) != ""), normalize_stamp(found),
                            F.when(behind != "", behind).otherwise(before))
    rows = lines.select(key, "pos", F.explode(F.array_compact(F.array(first, second))).alias("c")).select(key, "pos", "c.*")
    # dealt by text once, for one row per stamp and rank and for the best rank of the text
    turned = F.lit(variant == "current") & (F.col("rank") == 1)
    place = F.when(turned, -F.col("pos")).otherwise(F.col("pos"))
    best = rows.where(F.col(key).isNotNull()).repartition(F.col(key)).groupBy(key, "rank", "stamp").agg(F.min("pos").alias("pos"), F.min_by("title", place).alias("title"))
    best = best.withColumn("_rank", F.min("rank").over(Window.partitionBy(key)))
    return best.where("rank = _rank").select(key, "stamp", "pos", "title")
