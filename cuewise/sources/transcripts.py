"""Transcript text to rows and back, one line per row so no transcript is held in one cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.functions.text import strip
from cuewise.functions.timefmt import sec_to_hms
from cuewise.operators.ordered import fixed_blocks, scan

# The two transcript line grammars.
BRACKET_LINE = r"^\[(\d+\.?\d*)\s*-\s*(\d+\.?\d*)\]\s*(.*)"
CLOCK_LINE = r"^(\d{2}):(\d{2}):(\d{2}):\s*(.*)"


def text_lines(df: DataFrame, text: str = "text", order: str = "part") -> DataFrame:
    """One row per line of a text column; `order` places the texts of a video after each other."""
    return df.select("video_id", order, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("_line", "line")).select(
        "video_id", F.col(order).cast("long").alias("part"), F.col("_line").cast("long").alias("line_no"), "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Bracket grammar first, then clock grammar; other lines are dropped. End is null-free: clock lines end at their start."""
    line = strip(F.col("line"))
    bracket = line.rlike(BRACKET_LINE)

    def clock(i):
        return F.regexp_extract(line, CLOCK_LINE, i).cast("double")

    start = F.when(bracket, F.regexp_extract(line, BRACKET_LINE, 1).cast("double")).otherwise(
        clock(1) * 3600 + clock(2) * 60 + clock(3))
    end = F.when(bracket, F.regexp_extract(line, BRACKET_LINE, 2).cast("double")).otherwise(start)
    text = strip(F.when(bracket, F.regexp_extract(line, BRACKET_LINE, 3)).otherwise(F.regexp_extract(line, CLOCK_LINE, 4)))
    return lines.where(bracket | line.rlike(CLOCK_LINE)).select(
        "video_id", "part", "line_no", start.alias("start_s"), end.alias("end_s"), text.alias("text"))


def infer_ends(segments: DataFrame, order: list[str], position: str, tail: float = 30.0) -> DataFrame:
    """Where end equals start: the next row's start, or `tail` seconds for the last row."""
    rows = scan(fixed_blocks(segments, position), ["video_id"], order, lead={"_next": "start_s"}).drop("_b")
    end = F.when(F.col("end_s") == F.col("start_s"), F.coalesce("_next", F.col("start_s") + tail)).otherwise(F.col("end_s"))
    return rows.withColumn("end_s", end).drop("_next")


def parse_transcript(df: DataFrame, text: str = "text", order: str = "part") -> DataFrame:
    """Timestamped transcript text to segments with inferred ends."""
    return infer_ends(parse_lines(text_lines(df, text, order)), ["part", "line_no"], "part")


def bracket_lines(segments: DataFrame) -> DataFrame:
    """`[start - end] text`, one row per line."""
    return segments.withColumn("line", F.format_string("[%.1f - %.1f] %s", "start_s", "end_s", "text"))


def compact_lines(segments: DataFrame) -> DataFrame:
    """`[HMS-HMS] text` for non-blank texts."""
    body = strip(F.col("text"))
    return segments.where(body != "").withColumn(
        "line", F.concat(F.lit("["), sec_to_hms(F.col("start_s")), F.lit("-"), sec_to_hms(F.col("end_s")), F.lit("] "), body))
