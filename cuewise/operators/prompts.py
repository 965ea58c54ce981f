"""Prompt and training texts assembled from segments, chapters and units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions.timefmt import sec_to_hms


def answers(chapters: DataFrame) -> DataFrame:
    """`HH:MM:SS - title` lines per video; chapters are distinct seconds, so the text is bounded."""
    line = F.concat(sec_to_hms(F.col("start_s")), F.lit(" - "), F.col("title"))
    rows = F.sort_array(F.collect_list(F.struct("start_s", line.alias("l"))))
    return chapters.groupBy("video_id", "duration").agg(F.concat_ws("\n", F.transform(rows, lambda r: r["l"])).alias("answer"))


def whole_transcript(segments: DataFrame) -> DataFrame:
    """Transcript lines as one text per video; the text is what the dialog is, so it is one cell."""
    line = F.concat(sec_to_hms(F.col("start_s")), F.lit(": "), tx.strip(F.col("text")))
    ordered = F.sort_array(F.collect_list(F.struct("seg_idx", line.alias("l"))))
    return segments.groupBy("video_id").agg(
        F.concat(F.concat_ws("\n", F.transform(ordered, lambda r: r["l"])), F.lit("\n")).alias("transcript"))


# Wording around the parts of a dialog.
DURATION_PROMPT, TRANSCRIPT_PROMPT = "Given the complete transcript of a video of duration ", "Here is the transcript to analyze:\n"


def dialog(answer: DataFrame, transcript: DataFrame, task: str) -> DataFrame:
    """Two-turn dialog: duration, task and transcript; then the answer."""
    prompt = F.concat(F.lit(DURATION_PROMPT), sec_to_hms(F.col("duration")), F.lit(", "), F.lit(task),
                      F.lit(TRANSCRIPT_PROMPT), "transcript")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return answer.join(transcript, "video_id").select("video_id", F.array(turn("user", prompt), turn("assistant", F.col("answer"))).alias("dialog"))


# Where a slide line is cut into sentences, and its bullets and headings.
SENTENCE_CUT = r"(?U)[。；;！？!?]\s*|\n+"
BULLET, BULLET_END, CAUGHT, CAUGHT_END = "    - 「", "」", "*   於 ", " 左右捕捉到:"


def slide_bullets(lines: DataFrame) -> DataFrame:
    """A time heading per slide line (pos -1) and one bullet per sentence."""
    body = tx.strip(F.col("text"))
    rows = lines.where(body != "")
    parts = F.filter(F.transform(F.split(body, SENTENCE_CUT), tx.strip), lambda x: x != "")
    n = F.col("line_no").cast("long").alias("line_no")
    bullets = rows.select("video_id", n, F.posexplode(parts).alias("pos", "s")).select("video_id", "line_no", F.col("pos").cast("long").alias("pos"), F.concat(F.lit(BULLET), "s", F.lit(BULLET_END)).alias("line"))
    heads = rows.select("video_id", n, F.lit(-1).cast("long").alias("pos"), F.concat(F.lit(CAUGHT), sec_to_hms(F.col("start_s")), F.lit(CAUGHT_END)).alias("line"))
    return bullets.unionByName(heads)


# Wording of the outline of units.
OUTLINE, OUTLINE_END, GOAL, GOAL_TO, GOAL_END = "## 預定教學單元結構 (", " 個單元)\n", "\n✅ 目標：創建 ", " 到 ", " 個章節"


def unit_context(units: DataFrame) -> DataFrame:
    """Outline of the course units and the wanted number of chapters."""
    rows = F.sort_array(F.collect_list(F.struct("unit_no", F.concat("unit_no", F.lit(". "), "title").alias("l"))))
    n = F.count(F.lit(1))
    return units.groupBy("video_id").agg(F.concat(
        F.lit(OUTLINE), n, F.lit(OUTLINE_END), F.concat_ws("\n", F.transform(rows, lambda r: r["l"])),
        F.lit(GOAL), n * 2, F.lit(GOAL_TO), n * 4, F.lit(GOAL_END)).alias("context"))
