"""Chapter rows: maps, boundary segments, containment, policies and schedules.

Chapter stamps are distinct whole seconds, so a video has at most one chapter
row per second of its length; per-video windows and arrays over chapters are
bounded by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.timefmt import sec_to_hms
from cuewise.operators.ranges import overlap_join, point_join
from cuewise.operators.thinning import thin_gaps
from cuewise.operators.windows import budget_window


def chapter_map(chapters: DataFrame) -> DataFrame:
    """One `{"HH:MM:SS": title}` map per video."""
    pairs = F.sort_array(F.collect_list(F.struct("start_s", sec_to_hms(F.col("start_s")).alias("k"), F.col("title").alias("v"))))
    return chapters.groupBy("video_id").agg(
        F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"]))).alias("chapters"))


def add_zero(boundaries: DataFrame) -> DataFrame:
    """A boundary at 0 for videos whose first one is later."""
    first = boundaries.groupBy("video_id", "duration").agg(F.min("start_s").alias("_m")).where("_m <> 0")
    return boundaries.select("video_id", "start_s", "duration").unionByName(
        first.select("video_id", F.lit(0).cast("long").alias("start_s"), "duration"))


def segments(boundaries: DataFrame, zero: str = "add") -> DataFrame:
    """Boundaries (`video_id, start_s, duration`) to segments `(i, s, e)` up to the duration.

    zero: add a boundary at 0, remove it, or leave as is. No empty last segment. The added first
    segment comes from the first row itself, so the boundaries are read once.
    """
    rows = boundaries.where(F.col("start_s") != 0) if zero == "remove" else boundaries
    w = Window.partitionBy("video_id").orderBy("start_s")
    first = F.first("start_s").over(w)
    shift = F.when(first != 0, 1).otherwise(0) if zero == "add" else F.lit(0)
    rows = rows.select("video_id", "duration", "start_s", F.lead("start_s").over(w).alias("_next"), (F.row_number().over(w) - 1).alias("_r"), shift.alias("_shift"))
    s = F.col("start_s").cast("double")
    own = F.struct((F.col("_r") + F.col("_shift")).cast("long").alias("i"), s.alias("s"), F.coalesce("_next", "duration").cast("double").alias("e"), F.col("_next").isNull().alias("last"))
    lead_in = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s"), s.alias("e"), F.lit(False).alias("last"))
    both = F.when((F.col("_r") == 0) & (F.col("_shift") == 1), F.array(lead_in, own)).otherwise(F.array(own))
    return rows.select("video_id", "duration", F.inline(both)).where(~F.col("last") | (F.col("s") != F.col("e"))).drop("last")


def contain(segs: DataFrame, chapters: DataFrame, slack: float = 1.0, width: float = 300.0) -> DataFrame:
    """Segments assigned to chapters by start, with slack before the chapter start.

    A segment inside the slack lands in two chapters; one before the first chapter in none.
    """
    right = chapters.select("video_id", F.col("idx").alias("chapter_idx"), F.col("start_s").alias("ch_start"),
                            F.col("end_s").alias("ch_end"), "title")
    return point_join(segs, right, ["video_id"], "start_s", F.col("ch_start") - slack, F.col("ch_end").cast("double"),
                      (F.col("start_s") >= F.col("ch_start") - slack) & (F.col("start_s") < F.col("ch_end")), width)


# Fixed values: (duration below, minimum gap, lowest count, highest count, cap).
POLICY = [(1800, 120, 5, 10, 30), (3600, 180, 6, 12, 40), (7200, 240, 8, 16, 50), (10800, 300, 10, 20, 60), (None, 360, 12, 24, 80)]
LEGACY_POLICY = [(1800, 90, 6, 12, 30), (3600, 180, 8, 16, 40), (7200, 300, 10, 20, 50), (10800, 540, 12, 24, 60), (None, 600, 14, 28, 80)]


def policy(duration: Column, legacy: bool = False) -> dict[str, Column]:
    """Gap and count limits by duration band."""
    out = {}
    for pos, name in enumerate(("min_gap", "low", "high", "cap"), 1):
        expr = None
        for row in LEGACY_POLICY if legacy else POLICY:
            value = F.lit(row[pos])
            if row[0] is None:
                out[name] = expr.otherwise(value)
            else:
                expr = F.when(duration < row[0], value) if expr is None else expr.when(duration < row[0], value)
    return out


def equal_points(duration: Column, n: int) -> Column:
    """`n` inner points at equal distance; one point is the middle."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i * (duration / F.lit(n + 1)))


def interval_points(duration: Column, every: float) -> Column:
    """Points `every` seconds apart, centred; none when the interval does not fit."""
    n = F.floor(duration / F.lit(every))
    offset = (duration - n * F.lit(every)) / 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: offset + i * F.lit(every))).otherwise(F.array().cast("array<double>"))


def midpoints(length: Column, n: int) -> Column:
    """Middle index of each of `n` equal index ranges (fewer when the length is shorter)."""
    parts = F.least(length.cast("long"), F.lit(n).cast("long"))
    edge = lambda i: F.floor(i * length / parts)
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: F.floor((edge(i) + edge(i + 1) - 1) / 2))


def fallback_points(duration: Column, every: int = 300) -> Column:
    """0, every, 2·every … below the duration."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.ceil(duration), F.lit(every).cast("long")), lambda x: x < F.floor(duration))


def frame_numbers(points: Column, fps: float, duration: Column) -> Column:
    """Distinct frame numbers of time points, below the frame count."""
    frames = F.transform(points, lambda p: F.floor(p * F.lit(fps)))
    return F.array_sort(F.array_distinct(F.filter(frames, lambda f: f < F.floor(duration * F.lit(fps)))))


def filter_list(maps: DataFrame, limit: Column | None = None) -> DataFrame:
    """Chapter list filter over `(video_id, stamp, title, pos)`.

    With a limit: sorted and cut after it. Without: the whole list is dropped when the
    stamps fall. Blank titles go; a lone 00:00:00 leaves nothing.
    """
    w = Window.partitionBy("video_id")
    if limit is not None:
        rows = maps.where(F.col("stamp") <= limit)
    else:
        falls = F.coalesce(F.col("stamp") < F.lag("stamp").over(w.orderBy("pos")), F.lit(False))
        rows = maps.withColumn("_f", falls).withColumn("_f", F.max("_f").over(w)).where("NOT _f").drop("_f")
    rows = rows.where("title <> ''").withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.where(~((F.col("_n") == 1) & (F.col("stamp") == "00:00:00"))).drop("_n")


def nearest_frame(stamps: DataFrame, frames: DataFrame, max_gap: float) -> DataFrame:
    """Closest frame `x` of each stamp by position ratio, the earlier one on ties; null beyond `max_gap` seconds.

    One pass over the tagged union: only the neighbour on each side can be the closest.
    """
    rows = stamps.select("video_id", F.col("start_s").alias("x"), "idx", "duration", F.lit(None).cast("long").alias("f")).unionByName(
        frames.select("video_id", "x", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("int").alias("duration"), F.col("x").alias("f")))
    # both run from their end of the order; a frame up to the far end would start anew at every row
    upto = lambda order: Window.partitionBy("video_id").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    near = rows.select("*", F.max("f").over(upto(F.asc("x"))).alias("before"), F.min("f").over(upto(F.desc("x"))).alias("after")).where("idx IS NOT NULL")
    d = F.col("duration").cast("double")

    def off(c):
        return F.abs(F.col(c) / d - F.col("x") / d)

    best = F.when(F.col("after").isNull() | (off("before") <= off("after")), F.col("before")).otherwise(F.col("after"))
    return near.withColumn("frame", best).withColumn("frame", F.when(F.abs(F.col("frame") / d * d - F.col("x")) <= max_gap, F.col("frame")))


def selected_frames(hits: DataFrame, most: int = 100) -> DataFrame:
    """Frames `(video_id, frame)` that the stamps of a video hit, each once; of more than `most`, the ends of the smallest gaps go."""
    once_ = hits.where("frame IS NOT NULL").select("video_id", "frame").distinct()
    return thin_gaps(once_.select("video_id", F.col("frame").alias("t")), most).select("video_id", F.col("t").cast("long").alias("frame"))


def topic_times(topics: DataFrame, chapters: DataFrame) -> DataFrame:
    """Time of the first chapter whose title holds one of the topic's first three words
    (longer than one character); else the start of the topic's time range; else empty."""
    lists = chapters.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("idx", "stamp", F.col("title").alias("ct")))).alias("_c"))
    words = F.slice(F.filter(F.split("title", " "), lambda w: F.length(w) > 1), 1, 3)
    joined = topics.join(lists, "video_id", "left").withColumn("_w", words)
    hit = F.filter("_c", lambda c: F.exists("_w", lambda w: F.contains(c["ct"], w)))
    start = F.when(F.contains("time_range", F.lit("-")), F.trim(F.split("time_range", "-")[0])).otherwise(F.col("time_range"))
    title = F.when(F.length("title") > 50, F.concat(F.substring("title", 1, 47), F.lit("..."))).otherwise(F.col("title"))
    return joined.select("video_id", "idx", title.alias("title"), F.coalesce(F.get(hit, F.lit(0))["stamp"], start, F.lit("")).alias("time"))


def caption_pairs(refs: DataFrame, preds: DataFrame, pairs: DataFrame, thresholds=(0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Predictions per threshold with every reference reaching it, else one row with a null reference."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    passing = pairs.select("video_id", "i", "j", "iou", t.alias("tiou")).where("iou >= tiou").drop("iou").join(
        refs.select("video_id", F.col("idx").cast("long").alias("i"), F.col("title").alias("ref_title")), ["video_id", "i"])
    all_preds = preds.select("video_id", F.col("idx").cast("long").alias("j"), F.col("title").alias("pred_title"), t.alias("tiou"))
    return all_preds.join(passing, ["video_id", "j", "tiou"], "left").select("tiou", "video_id", "j", "i", "pred_title", "ref_title")


def block_titles(bounds: DataFrame, titles: DataFrame, segs: DataFrame) -> DataFrame:
    """Distinct forward bounds with the title of the same rounded bounds and the number of segments they touch."""
    blocks = bounds.where("e > s").distinct()
    key = [F.round("s", 3).alias("rs"), F.round("e", 3).alias("re")]
    named = blocks.select("video_id", "s", "e", *key).join(titles.select("video_id", *key, "title"), ["video_id", "rs", "re"], "left")
    hit = overlap_join(blocks, segs.select("video_id", "seg_idx", "start_s", "end_s"), ["video_id"], "s", "e", "start_s", "end_s",
                       (F.col("end_s") >= F.col("s")) & (F.col("start_s") <= F.col("e")), 600.0)
    n = hit.groupBy("video_id", "s", "e").agg(F.count(F.lit(1)).alias("n"))
    return named.join(n, ["video_id", "s", "e"], "left").select(
        "video_id", F.col("s").alias("start_s"), F.col("e").alias("end_s"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("n", F.lit(0)).alias("segments"))


# Event titles that open and close the shared part of a recording.
SHARE_START = r"sharing\s*started|start\s*sharing|開始共享|開始分享"
SHARE_STOP = r"sharing\s*stopp?ed|stop\s*sharing|停止共享|停止分享"


def trim_range(events: DataFrame, margin: float = 2.0) -> DataFrame:
    """Last share start to last share stop with a margin; without either, first start to last end."""
    at = F.struct("start_s", "event_id")
    title = F.lower(F.trim("title"))
    agg = events.groupBy("video_id").agg(
        F.coalesce(F.max_by("start_s", F.when(title.rlike(SHARE_START), at)), F.lit(0.0)).alias("_s"), F.max_by("end_s", F.when(title.rlike(SHARE_STOP), at)).alias("_e"),
        F.min_by("start_s", at).alias("_first"), F.max_by("end_s", at).alias("_last"))
    none = (F.col("_s") == 0) & F.col("_e").isNull()
    start = F.when(none, F.greatest(F.lit(0.0), "_first")).otherwise(F.col("_s"))
    end = F.when(none, F.greatest(F.lit(0.0), "_first", "_last")).otherwise(F.col("_e"))
    cut = agg.select("video_id", start.alias("s"), end.alias("e"))
    low = F.when((F.col("s") != 0) | F.col("e").isNotNull(), F.greatest(F.lit(0.0), F.col("s") - margin)).otherwise(F.col("s"))
    return cut.select("video_id", low.alias("trim_start"), F.when(F.col("e").isNotNull(), F.greatest(low, F.col("e") + margin)).alias("trim_end"))


def rank_in_buckets(chapters: DataFrame, k: Column, legacy: bool = False) -> DataFrame:
    """Chapters with their bucket of the k-th part of the video and `_first`, true for its representative."""
    d, s = F.col("duration"), F.col("start_s")
    if legacy:
        rows = chapters.withColumn("bucket", F.floor(s / F.floor(d / k)))
        order, inside = [F.col("start_s")], F.col("bucket") < k
    else:
        size = F.greatest(F.lit(1).cast("long"), F.floor(d / k))
        rows = chapters.withColumn("bucket", F.least(F.floor(s / size), (k - 1).cast("long")))
        b = F.col("bucket")
        end = F.when(b < k - 1, (b + 1) * size).otherwise(d + 1)
        order, inside = [F.abs(s - F.floor((b * size + end) / 2)), F.col("start_s")], F.lit(True)
    rn = F.row_number().over(Window.partitionBy("video_id", "bucket").orderBy(*order))
    return rows.withColumn("_first", (rn == 1) & inside)


def bucket_representatives(chapters: DataFrame, k: Column, legacy: bool = False) -> DataFrame:
    """One chapter per k-th of the video: nearest to the middle of its bucket, the last bucket open.

    Legacy: the earliest of each bucket, and chapters behind the k-th bucket are lost.
    """
    return rank_in_buckets(chapters, k, legacy).where("_first").drop("_first")


def first_units(chapters: DataFrame, n: int) -> DataFrame:
    """First n chapters as units: tags off, titles over 50 characters cut to 47 and three dots."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("start_s"))
    title = F.regexp_replace(F.regexp_replace("title", r"(?U)^\[單元\d+[：:][^\]]+\]\s*", ""), r"(?U)^\[.*?\]\s*", "")
    title = F.trim(title)
    rows = chapters.withColumn("_r", rank).where(F.col("_r") <= n)
    return rows.select("video_id", F.col("_r").cast("long").alias("unit_no"), F.when(F.length(title) > 50, F.concat(F.substring(title, 1, 47), F.lit("..."))).otherwise(title).alias("title"),
                       sec_to_hms(F.col("start_s")).alias("time"))


def slide_filter(slides: DataFrame) -> DataFrame:
    """Slides whose text is no stop phrase, and that are long enough or carry a caption or topics."""
    t = F.trim("text")
    return slides.where(~t.rlike("^(新竹小幫手|老師|助教)$") & ~((F.length(t) < 30) & (F.trim("caption") == "") & (F.size("topics") == 0)))


def needs_several_passes(duration: Column, length: Column) -> Column:
    """Long content of half an hour up to four hours."""
    return (duration >= 1800) & (duration <= 14400) & (length >= 5000)


def weighted_start(boundaries: DataFrame, seed: int) -> DataFrame:
    """One boundary `(video_id, place, w0)` per video, earlier ones likelier by 0.8 a step: the largest
    u^(1/w) with u hashed from video, place and seed."""
    w = Window.partitionBy("video_id").orderBy("start_s")
    rows = boundaries.withColumn("place", F.row_number().over(w) - 1)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "video_id", "place", F.lit(seed))), 1, 13), 16, 10).cast("double")
    key = F.log((drawn + 1) / float((1 << 52) + 1)) / F.pow(F.lit(0.8), F.col("place"))
    return rows.groupBy("video_id").agg(F.max_by(F.struct("place", F.col("start_s").alias("w0")), key).alias("c")).select("video_id", "c.*")


def training_window(lines: DataFrame, tokens: Column, boundaries: DataFrame, chapters: DataFrame, seed: int, budget: int) -> DataFrame:
    """Answer lines `(video_id, w0, whole, answer)` of the window that each video is trained on.

    `lines`: video_id, seg_idx, line, stamp_s. A transcript within the budget is taken whole, with all its
    chapters. Otherwise lines are taken from a weighted start until the budget is used up, and the chapters
    from the start to the stamp of the last line taken, shifted.
    """
    start = weighted_start(boundaries, seed)
    placed = lines.join(start.select("video_id", "w0"), "video_id")
    rows = budget_window(placed, tokens, F.col("stamp_s"), F.col("w0"), budget)
    taken = rows.groupBy("video_id").agg(F.max("whole").alias("_whole"), F.max_by("stamp_s", "seg_idx").alias("_end"))
    has = lines.select("video_id").distinct().withColumn("_has", F.lit(True))
    of = start.join(has, "video_id", "left").join(taken, "video_id", "left")
    # no line at all fits any budget
    of = of.withColumn("whole", F.coalesce("_whole", F.col("_has").isNull()))
    of = of.select("video_id", F.when(F.col("whole"), 0).otherwise(F.col("w0")).cast("long").alias("w0"), "whole", "_end")
    inside = F.col("whole") | ((F.col("start_s") >= F.col("w0")) & (F.col("start_s") <= F.col("_end")))
    return chapters.join(of, "video_id").where(inside).select("video_id", "w0", "whole", F.concat(sec_to_hms(F.col("start_s") - F.col("w0")), F.lit(" - "), "title").alias("answer"))


def overlapped_chunks(durations: DataFrame, size: float, overlap: float) -> DataFrame:
    """Chunks of `size` seconds, `overlap` shared with the next, the short tail kept."""
    step = size - overlap
    last = F.ceil(F.col("duration") / step) - 1
    rows = durations.where("duration > 0").select("video_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    start = F.col("chunk_no") * F.lit(step)
    return rows.select("video_id", "chunk_no", start.alias("chunk_start"), F.least(start + size, F.col("duration").cast("double")).alias("chunk_end"))


def rebase(rows: DataFrame, size: float, overlap: float, start: float = 0.0, end: float | None = None) -> DataFrame:
    """The part of each row `(start_s, end_s, duration)` in every chunk that it reaches into: adds `chunk_no` and
    `offset_s`, `offset_end_s`, seconds from the chunk's start.

    The chunk numbers follow from the times. A part is kept if its time on the signal reaches into
    `start` to `end`; chunks wholly outside are not looked at. A row without length belongs where it starts.
    """
    step = size - overlap
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start_s") - size) / step) + 1)
    last = F.greatest(F.floor(F.col("start_s") / step), F.ceil(F.col("end_s") / step) - 1)
    out = rows.where("start_s < duration").withColumn("chunk_no", F.explode(F.sequence(first, last)))
    low = F.col("chunk_no") * F.lit(step)
    high = F.least(low + size, F.col("duration").cast("double"))
    out = out.withColumns({"_low": low, "_high": high}).withColumns({"offset_s": F.greatest(F.col("start_s"), "_low") - F.col("_low"), "offset_end_s": F.least("end_s", "_high") - F.col("_low")})
    inside = (F.col("_low") < F.col("_high")) & (F.col("_high") > start) & (F.col("_low") + F.col("offset_end_s") > start)
    if end is not None:
        inside = inside & (F.col("_low") < end) & (F.col("_low") + F.col("offset_s") < end)
    return out.where(inside).drop("_low", "_high")


def absolute(parts: DataFrame, size: float, overlap: float) -> DataFrame:
    """Parts `(chunk_no, offset_s, offset_end_s)` back on the time of their signal: `start_s`, `end_s`."""
    low = F.col("chunk_no") * F.lit(size - overlap)
    return parts.withColumns({"start_s": low + F.col("offset_s"), "end_s": low + F.col("offset_end_s")})
