"""Folds over one video's chapters or one frame's tokens.

Chapter stamps are distinct whole seconds, so a group has at most one row per second of a video;
a frame's tokens are bounded by the screen. Such groups run in one grouped pass.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.operators.chapters import policy, rank_in_buckets
from cuewise.operators.folds import grouped, runs
from cuewise.operators.ordered import fixed_blocks


def _reach(held: str, title: str, min_gap: int) -> float:
    """How near a chapter must follow the one held to be taken into it; farther within one tagged unit."""
    unit = UNIT_TAG.match(held)
    same = unit is not None and title.startswith(unit[0])
    return max(120, min_gap // 2, 0.7 * min_gap if same else 0)


def _renames(held: str, title: str) -> bool:
    """Whether a chapter that is taken in gives its title: tagged over untagged, or clearly longer."""
    return (UNIT_TAG.match(title) and not UNIT_TAG.match(held)) or len(title) > 1.3 * len(held)


# Fixed value: a unit tag in front of a title.
UNIT_TAG = re.compile(r"\[[^\]]+\]")


def merge_close(chapters: DataFrame, legacy: bool = False) -> DataFrame:
    """Minimum-gap merge `(video_id, start_s, title, duration, min_gap)`.

    The kept time is the first of a run; the title may come from a merged chapter (tagged over
    untagged, or over 1.3 times longer). Legacy: time and title move to the longer title.
    """

    def follow(held, row):
        (start, name, run), (s, title, min_gap) = held, row
        if s - start >= (min_gap if legacy else _reach(name, title, min_gap)):
            return s, title, run + 1
        if legacy:
            return (s, title, run) if len(title) > len(name) else held
        return start, title if _renames(name, title) else name, run

    def merge(rows: list[tuple]) -> list[tuple]:
        states = accumulate(((s, title, gap) for s, title, _, gap in rows[1:]), follow, initial=(rows[0][0], rows[0][1], 0))
        last = {run: (start, name) for start, name, run in states}
        return [(*kept, rows[0][2]) for kept in last.values()]

    rows = chapters.where((F.col("start_s") >= 0) & (F.col("start_s") <= F.col("duration"))).withColumn("title", tx.strip(F.col("title")))
    return grouped(rows, ["video_id"], ["start_s"], ["start_s", "title", "duration", "min_gap"], merge, "start_s long, title string, duration int")


def balance(chapters: DataFrame, legacy: bool = False) -> DataFrame:
    """Merge close chapters, then keep the count in the policy's range: bucket representatives
    above it, the first rows up to the cap below it."""
    p = policy(F.col("duration"), legacy)
    w = Window.partitionBy("video_id")
    rows = merge_close(chapters.withColumn("min_gap", p["min_gap"]), legacy)
    rows = rows.select("*", F.count(F.lit(1)).over(w).alias("n"), F.row_number().over(w.orderBy("start_s")).alias("_r"),
                       p["low"].alias("low"), p["high"].alias("high"), p["cap"].alias("cap"))
    ranked = rank_in_buckets(rows, F.col("high"), legacy)
    keep = F.when(F.col("n") > F.col("high"), F.col("_first")).when(F.col("n") < F.col("low"), F.col("_r") <= F.col("cap")).otherwise(True)
    return ranked.where(keep).select("video_id", "start_s", "title")


def merge_gaps(blocks: DataFrame, shortest: float = 60.0, gap: float = 15.0) -> DataFrame:
    """Drop short blocks (keep the longest when none is left) and join blocks at most `gap` apart."""
    w = Window.partitionBy("video_id")
    size = F.col("end_s") - F.col("start_s")
    rows = blocks.withColumn("_ok", size >= shortest).withColumn("_any", F.max("_ok").over(w)).withColumn(
        "_r", F.row_number().over(w.orderBy(F.desc(size), "start_s"))).where(F.col("_ok") | (~F.col("_any") & (F.col("_r") == 1)))
    o = w.orderBy("start_s")
    peak = F.max("end_s").over(o.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.when(peak.isNull() | (F.col("start_s") - peak > gap), 1).otherwise(0))
    grouped = flagged.withColumn("_g", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("video_id", "_g").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n")).drop("_g")


def place_stamps(suggestions: DataFrame, bump: int = 120) -> DataFrame:
    """Suggestions as chapters with distinct stamps: a taken second moves +1 … +bump, then −1 … −bump,
    inside [0, duration − 1]; else the row is dropped. Titles get their unit prefix."""

    def place(rows: list[tuple]) -> list[tuple]:
        last = rows[0][2] - 1
        used, out = set(), []
        for s, title, _ in rows:
            at = s
            if s in used:
                moves = [*range(1, bump + 1), *range(-1, -bump - 1, -1)]
                at = next((s + d for d in moves if 0 <= s + d <= last and s + d not in used), None)
            if at is not None:
                used.add(at)
                out.append((at, title))
        return out

    no = F.col("unit_no")
    named = F.when(no.isNotNull() & F.col("unit_title").isNotNull(), F.concat(F.lit("[單元"), no, F.lit("："), "unit_title", F.lit("] "))).when(
        no.isNotNull(), F.concat(F.lit("[單元"), no, F.lit("] "))).otherwise("")
    rows = suggestions.where("title <> ''").select("video_id", "idx", "start_s", "duration", F.concat(named, "title").alias("title"))
    return grouped(rows, ["video_id"], ["idx"], ["start_s", "title", "duration"], place, "start_s long, title string")


def same_title(threshold: float):
    """Rows `(words,)`, the word set of a title: joins while like the title that opened the run."""

    def rule(state, row):
        held, now = set(state or ()), set(row[0])
        joins = held and now and len(held & now) >= threshold * len(held | now)
        return (False, state) if joins else (True, sorted(now))

    return rule


def merge_titles(chapters: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Neighbours with nearly equal titles become one: end of the later, running mean of the confidence."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(tx.TITLE_WORDS), F.lit(0)))
    rows = fixed_blocks(chapters.withColumn("_w", found), "start_s")
    runs_ = runs(rows, ["video_id"], ["start_s"], "start_s", ["_w"], same_title(threshold), ["end_s", "title", "confidence"])
    trust = F.transform(F.sort_array(F.collect_list(F.struct("start_s", "confidence"))), lambda x: x["confidence"])
    mean = F.aggregate(F.slice(trust, F.lit(2), F.greatest(F.size(trust) - 1, F.lit(0))), trust[0], lambda a, c: F.round(0.5 * (a + c), 3))
    return runs_.groupBy("video_id", F.col("run").alias("start_s")).agg(F.max_by("end_s", "start_s").alias("end_s"), F.min_by("title", "start_s").alias("title"), mean.alias("confidence"))


def confidence(sim: Column, w_slide: Column, w_speech: Column, has_topic: Column) -> Column:
    value = 0.35 * sim + 0.25 * w_slide + 0.25 * w_speech + 0.15 * has_topic.cast("double")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3)


def baselines(boxes: list[tuple], y_ratio: float) -> list[int]:
    """Text row of each box `(cy, h, ..)` of a frame: it belongs to a row while its centre is near the row's running baseline."""
    out, level, n = [], boxes[0][0], 0
    for cy, h, *_ in boxes:
        near = abs(cy - level) <= max(1.0, h * y_ratio)
        n += not near
        level = (level + cy) / 2.0 if near else cy
        out.append(n)
    return out


def reading_lines(tokens: DataFrame, y_ratio: float = 0.015, x_ratio: float = 0.02) -> DataFrame:
    """Token boxes of a frame to lines: rows along a running baseline, cut where the gap to the box on the
    left is wide. Rows `(video_id, frame, x1, x2, y1, y2, w, h, text)`.

    Boxes are shuffled once; a frame is read whole and only its lines come out.
    """
    low = float("-inf")

    def lines_of(boxes: list[tuple]) -> list[tuple]:
        rows: dict[int, list[tuple]] = {}
        for n, (cy, _, x1, x2, text, w) in zip(baselines([(b[0], b[1]) for b in boxes], y_ratio), boxes):
            rows.setdefault(n, []).append((x1, cy, (x1 + x2) / 2.0, x2, text, w))
        out = []
        for row in rows.values():
            # places that are not known come first
            row.sort(key=lambda b: b[:5] if b[2] == b[2] else (*[x if x == x else low for x in b[:4]], b[4]))
            words, right = [], None
            for x1, _, _, x2, text, w in row:
                if right is not None and x1 - right > w * x_ratio:
                    out.append((len(out), " ".join(words)))
                    words = []
                words.append(text)
                right = x2
            out.append((len(out), " ".join(words)))
        return out

    mid = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    boxes = tokens.where(tx.strip(F.col("text")) != "").withColumn("cy", mid("y1", "y2")).withColumn("cx", mid("x1", "x2"))
    lines = grouped(boxes, ["video_id", "frame"], ["cy", "cx", "x1", "x2", "text"], ["cy", "h", "x1", "x2", "text", "w"], lines_of, "line_no long, text string")
    return lines.withColumn("text", tx.strip(F.col("text")))
