"""Time windows over segments, and running results along a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.operators.ordered import BLOCK, density_blocks, fixed_blocks, scan
from cuewise.operators.ranges import overlap_join


def joined_text(order: list[str], text: str, sep: str) -> Column:
    """Texts of a group in order. Use only where the group is bounded by its time span."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return F.concat_ws(sep, F.transform(rows, lambda r: r["_t"]))


def text_in_windows(segments: DataFrame, windows: DataFrame, width: float = 60.0) -> DataFrame:
    """Text of the segments that overlap each window `[w_start, w_end)`; empty windows are dropped."""
    s = segments.where(F.trim("text") != "").select("video_id", "seg_idx", "start_s", "end_s", F.trim("text").alias("text"))
    hit = overlap_join(windows, s, ["video_id"], "w_start", "w_end", "start_s", "end_s",
                       (F.col("end_s") > F.col("w_start")) & (F.col("start_s") < F.col("w_end")), width)
    return hit.groupBy("video_id", "w_start", "w_end").agg(joined_text(["start_s", "seg_idx"], "text", " ").alias("text"))


def tumbling_text(segments: DataFrame, width: float) -> DataFrame:
    """Windows of `width` from the first start; a segment enters every window it overlaps.

    The window numbers of a segment follow from its own bounds, so no join is needed.
    """
    span = segments.groupBy("video_id").agg(F.min("start_s").alias("_lo"), F.max("end_s").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    first = F.floor((F.col("start_s") - lo) / width)
    last = F.ceil((F.col("end_s") - lo) / width) - 1
    rows = segments.join(span, "video_id").where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    out = rows.groupBy("video_id", "k", "_lo", "_hi").agg(joined_text(["start_s", "seg_idx"], "text", " ").alias("text"))
    return out.select("video_id", (lo + F.col("k") * width).alias("w_start"), F.least(lo + (F.col("k") + 1) * width, hi).alias("w_end"),
                      F.trim("text").alias("text")).where("text <> ''")


def sliding_members(rows: DataFrame, totals: DataFrame, win: float, overlap: float) -> DataFrame:
    """Rows with every sliding window `[k·step, k·step + win]` they touch, both ends closed."""
    step = max(1.0, win - overlap)
    lo = F.greatest(F.lit(0), F.ceil((F.col("start_s") - win) / step))
    hi = F.floor(F.col("end_s") / step)
    joined = rows.join(totals, "video_id").where(hi >= lo).withColumn("k", F.explode(F.sequence(lo, hi)))
    t0 = F.col("k") * F.lit(step)
    return joined.where((t0 < F.col("total")) & (F.col("start_s") <= F.least(t0 + win, F.col("total")))).select(
        *rows.columns, t0.alias("t0"), F.least(t0 + win, F.col("total")).alias("t1"))


def every_nth(segments: DataFrame, n: int) -> DataFrame:
    """Every n-th row in order, from the first."""
    rows = scan(fixed_blocks(segments, "seg_idx"), ["video_id"], ["seg_idx"], number="_n").drop(BLOCK)
    return rows.where((F.col("_n") - 1) % max(1, n) == 0).drop("_n")


def interval_union(intervals: DataFrame, total: Column | None = None, slack: float = 0.05) -> DataFrame:
    """Merged intervals per video. With a total: clamp to [0, total] first; empty ones are dropped."""
    rows = intervals
    if total is not None:
        rows = rows.withColumn("start_s", F.greatest(F.lit(0.0), F.least("start_s", total))).withColumn(
            "end_s", F.greatest(F.lit(0.0), F.least("end_s", total)))
    rows = rows.where("end_s > start_s").select("video_id", "start_s", "end_s", "event_id")
    return merge_touching(rows, slack).drop("n")


def merge_touching(rows: DataFrame, gap: float) -> DataFrame:
    """Islands of intervals whose start is at most `gap` after all earlier ends."""
    order = ["start_s", "end_s", "event_id"]
    peaks = scan(density_blocks(rows, ["video_id"], "start_s", tie="end_s"), ["video_id"], order, peak_before={"_p": "end_s"})
    flagged = peaks.withColumn("_new", F.when(F.col("_p").isNull() | (F.col("start_s") > F.col("_p") + gap), 1).otherwise(0))
    groups = scan(flagged, ["video_id"], order, total={"_g": "_new"})
    return groups.groupBy("video_id", F.col("_g").alias("grp")).agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, gap: float, cap: int | None = None) -> DataFrame:
    """Session number per row: a new one when the step from the previous start is over `gap`.

    With a cap, the closest neighbours are merged until `cap` sessions are left. Gaps between
    other sessions never change, so that keeps the cap-1 widest splits (the later one on ties).
    """
    order = ["start_s", "event_id"]
    steps = scan(density_blocks(rows, ["video_id"], "start_s", tie="event_id"), ["video_id"], order, lag={"_prev": "start_s"})
    steps = steps.withColumn("_gap", F.col("start_s") - F.col("_prev")).withColumn("_split", F.coalesce(F.col("_gap") > gap, F.lit(False)))
    if cap is not None:
        splits = steps.where("_split").select("video_id", "start_s", "event_id", "_gap")
        keep = top_rows(splits, ["video_id"], [F.desc("_gap"), F.desc("start_s"), F.desc("event_id")], cap - 1)
        mark = keep.select("video_id", "start_s", "event_id", F.lit(True).alias("_keep"))
        steps = steps.join(mark, ["video_id", "start_s", "event_id"], "left").withColumn("_split", F.coalesce("_keep", F.lit(False))).drop("_keep")
    return scan(steps.withColumn("_s", F.col("_split").cast("int")), ["video_id"], order, total={"session": "_s"}).drop(
        BLOCK, "_prev", "_gap", "_split", "_s")


def dropped_after(touches: DataFrame, keep: dict[str, float], now: Column) -> DataFrame:
    """Drops `(user_id, kind, last_us, dropped_us)`: things `(user_id, kind, event_id, us)` that lay untouched for over
    `keep[kind]` hours, by `now` (microseconds). Other kinds are kept for good."""
    hours = F.create_map(*[F.lit(x) for pair in keep.items() for x in pair])
    rows = touches.where(F.col("kind").isin(list(keep))).withColumn("_live", F.round(hours[F.col("kind")] * 3600e6).cast("long"))
    steps = scan(density_blocks(rows, ["user_id", "kind"], "us", tie="event_id"), ["user_id", "kind"], ["us", "event_id"], lead={"_next": "us"})
    end = F.col("us") + F.col("_live")
    gone = F.when(F.col("_next").isNull(), end <= now).otherwise(F.col("_next") > end)
    return steps.where(gone).select("user_id", "kind", F.col("us").alias("last_us"), end.alias("dropped_us"))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """First k rows per group: k per salted part of a group first, then k of those, so that
    one task never sees more than a part of a long group or salts·k rows."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= k).drop("_rn")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return few.withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= k).drop("_rn", "_salt")


def budget_window(lines: DataFrame, tokens: Column, stamp: Column, start: int | Column, budget: int) -> DataFrame:
    """Lines from `start` seconds on (a number, or a column of `lines`) while the running token sum stays within the budget.

    `lines` has `video_id, seg_idx, line`. A text that fits as a whole is kept whole and
    unshifted. Adds `whole`, `reached_end` and keeps untimed lines only in whole texts.
    """
    rows = lines.withColumn("_tok", tokens).withColumn("stamp_s", stamp)
    size = rows.groupBy("video_id").agg(F.sum("_tok").alias("_all"), F.max("seg_idx").alias("_last"))
    ok = F.col("stamp_s").isNotNull() & (F.col("stamp_s") >= start)
    rows = scan(fixed_blocks(rows, "seg_idx"), ["video_id"], ["seg_idx"], total={"_run": F.when(ok, F.col("_tok")).otherwise(0)}).drop(BLOCK)
    rows = rows.join(size, "video_id").withColumn("whole", F.col("_all") <= budget)
    over = rows.where(ok & ~F.col("whole") & (F.col("_run") > budget)).groupBy("video_id").agg(F.min("seg_idx").alias("_stop"))
    kept = rows.join(over, "video_id", "left").where(F.col("whole") | (ok & (F.col("_run") <= budget)))
    reached = F.col("whole") | F.col("_stop").isNull() | (F.col("_stop") == F.col("_last"))
    return kept.withColumn("reached_end", reached).drop("_tok", "_all", "_last", "_run", "_stop")


def anchors(stamps: DataFrame, k: int) -> DataFrame:
    """k evenly spaced rows per video, first and last included (half to even).

    Stamps are distinct whole seconds, so a plain window is bounded by the video length.
    """
    n = stamps.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = stamps.withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy("stamp_s")) - 1).join(n, "video_id")
    want = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(k - 1)).cast("int"))
    return rows.where((F.col("_n") <= k) | F.array_contains(want, F.col("_r"))).drop("_n", "_r")
