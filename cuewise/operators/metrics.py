"""Scores of predicted chapters against reference chapters.

Both sides tile a video, so a video has at most n_ref + n_pred overlapping
pairs; pairs come from a bucketed overlap join, never from all combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.operators.ranges import overlap_join

# The ten overlap thresholds, and the boundary distances in seconds.
THRESHOLDS = [0.5 + 0.05 * i for i in range(10)]
DISTANCES = [1, 3, 5, 10, 30, 60]


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals; the union is never more than the sum of lengths."""
    inter = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    union = F.least(F.greatest(e1, e2) - F.least(s1, s2), e1 - s1 + e2 - s2)
    return inter / (union + F.lit(1e-8))


def iou_pairs(refs: DataFrame, preds: DataFrame, width: float = 600.0) -> DataFrame:
    """`(video_id, i, j, iou)` for every overlapping pair of segments `(i, s, e)`."""
    r = refs.select("video_id", F.col("i"), F.col("s").alias("rs"), F.col("e").alias("re"))
    p = preds.select("video_id", F.col("i").alias("j"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    score = iou(F.col("rs"), F.col("re"), F.col("ps"), F.col("pe"))
    pairs = overlap_join(r, p, ["video_id"], "rs", "re", "ps", "pe", (F.col("re") > F.col("ps")) & (F.col("pe") > F.col("rs")), width)
    return pairs.withColumn("iou", score).where("iou > 0")


def _best(pairs: DataFrame) -> DataFrame:
    """Best overlap per reference and per prediction, as (video_id, side, k, best)."""
    sides = F.explode(F.array(F.struct(F.lit("r").alias("side"), F.col("i").alias("k")), F.struct(F.lit("p").alias("side"), F.col("j").alias("k"))))
    return pairs.select("video_id", sides.alias("x"), "iou").groupBy("video_id", "x.side", "x.k").agg(F.max("iou").alias("best"))


def side_counts(refs: DataFrame, preds: DataFrame) -> DataFrame:
    """Segments per video and side."""
    both = refs.select("video_id", F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(
        preds.select("video_id", F.lit(0).alias("r"), F.lit(1).alias("p")))
    return both.groupBy("video_id").agg(F.sum("r").alias("n_ref"), F.sum("p").alias("n_pred"))


def counts(refs: DataFrame, preds: DataFrame) -> DataFrame:
    """Segments per video and side. Videos without predictions are left out."""
    return side_counts(refs, preds).where("n_ref > 0 AND n_pred > 0")


def count_error(refs: DataFrame, preds: DataFrame) -> DataFrame:
    """Mean absolute error of the segment count, shares of under, equal and over, and reference videos without prediction."""
    both = F.when((F.col("n_ref") > 0) & (F.col("n_pred") > 0), F.col("n_ref") - F.col("n_pred"))

    def pct(c: Column) -> Column:
        return F.bround(F.count_if(c) * 100.0 / F.count("d"), 2)

    d = F.col("d")
    return side_counts(refs, preds).withColumn("d", both).agg(
        F.round(F.avg(F.abs(d)), 6).alias("mae"), pct(d > 0).alias("under_pct"), pct(d == 0).alias("equal_pct"), pct(d < 0).alias("over_pct"),
        F.count_if((F.col("n_ref") > 0) & (F.col("n_pred") == 0)).alias("missing"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(0.0)


def overlap_by_video(refs: DataFrame, preds: DataFrame, thresholds=THRESHOLDS, strict: bool = False) -> DataFrame:
    """Precision and recall per video and threshold. A segment counts when its best overlap
    passes, so pairs are reduced to one number per segment before any threshold is applied."""
    best = _best(iou_pairs(refs, preds))

    def passes(t):
        return F.col("best") > t if strict else F.col("best") >= t

    hits = best.groupBy("video_id").agg(*[
        F.count_if((F.col("side") == side) & passes(t)).alias(f"{side}{n}") for n, t in enumerate(thresholds) for side in "pr"])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("t_no"), F.lit(t).alias("threshold"), F.col(f"p{n}").alias("hp"), F.col(f"r{n}").alias("hr"))
                               for n, t in enumerate(thresholds)]))
    p, r = F.coalesce(F.col("x.hp"), F.lit(0)) / F.greatest("n_pred", F.lit(1)), F.coalesce(F.col("x.hr"), F.lit(0)) / F.col("n_ref")
    return (counts(refs, preds).join(hits, "video_id", "left").select("video_id", rows.alias("x"), "n_pred", "n_ref")
            .select("video_id", "x.t_no", "x.threshold", p.alias("p"), r.alias("r"), f1(p, r).alias("f1")))


def nearest_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """For every boundary of both sides the distance to the nearest boundary of the other side.

    One sorted pass over the tagged union; boundaries are distinct seconds, so groups are bounded.
    """
    rows = a.select("video_id", F.col("start_s").alias("x"), F.lit("r").alias("side")).unionByName(
        b.select("video_id", F.col("start_s").alias("x"), F.lit("p").alias("side")))
    w = Window.partitionBy("video_id").orderBy("x")
    back, ahead = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    other = {s: F.when(F.col("side") != s, F.col("x")) for s in "rp"}
    near = {s: F.least(F.col("x") - F.max(other[s]).over(back), F.min(other[s]).over(ahead) - F.col("x")) for s in "rp"}
    return rows.withColumn("dist", F.when(F.col("side") == "r", near["r"]).otherwise(near["p"]))


def distance_by_video(refs: DataFrame, preds: DataFrame, distances=DISTANCES) -> DataFrame:
    """Precision and recall of boundaries within a distance (strict), boundary 0 left out.

    Recall is null for a video whose only reference boundary is 0; predictions may be empty.
    """
    videos = refs.select("video_id").distinct().join(preds.select("video_id").distinct(), "video_id", "left_semi")
    near = nearest_distance(refs.where("start_s <> 0"), preds.where("start_s <> 0"))
    hits = near.groupBy("video_id").agg(
        F.count_if(F.expr("side = 'p'")).alias("n_pred"), F.count_if(F.expr("side = 'r'")).alias("n_ref"),
        *[F.count_if((F.col("side") == s) & (F.col("dist") < d)).alias(f"{s}{d}") for d in distances for s in "pr"])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"p{d}").alias("hp"), F.col(f"r{d}").alias("hr")) for d in distances]))
    p = F.coalesce(F.col("x.hp"), F.lit(0)) / F.greatest("n_pred", F.lit(1))
    r = F.when(F.col("n_ref") > 0, F.col("x.hr") / F.col("n_ref"))
    return (videos.join(hits, "video_id", "left").select("video_id", rows.alias("x"), "n_pred", "n_ref")
            .select("video_id", F.col("x.d").alias("distance"), p.alias("p"), r.alias("r")))


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs taken by falling overlap, ties by (i, j).

    A group is one video's overlapping pairs: at most n_ref + n_pred rows, sorted into one array and taken from
    the top; what is carried is the taken pairs.
    """
    order = F.struct((-F.col("iou")).alias("_rank"), "i", "j", "iou")
    ranked = pairs.groupBy("video_id").agg(F.array_sort(F.collect_list(order)).alias("_pairs"))
    none = F.slice("_pairs", 1, 0)
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["i"] == x["i"]) | (k["j"] == x["j"]))
    kept = F.aggregate("_pairs", none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return ranked.select("video_id", F.explode(kept).alias("_k")).select("video_id", F.col("_k.i").cast("long").alias("i"), F.col("_k.j").cast("long").alias("j"), "_k.iou")


def paired_by_rank(refs: DataFrame, preds: DataFrame) -> DataFrame:
    """Videos with equal segment counts, segments paired by position."""
    equal = counts(refs, preds).where("n_ref = n_pred").select("video_id", "n_ref")
    p = preds.select("video_id", "i", F.col("s").alias("ps"), F.col("e").alias("pe"))
    return refs.select("video_id", "i", F.col("s").alias("rs"), F.col("e").alias("re")).join(equal, "video_id").join(p, ["video_id", "i"])
