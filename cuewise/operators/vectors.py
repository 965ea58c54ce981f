"""Vectors along a video: pooling, neighbours, profiles, groups, top-k labels."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.operators.folds import fold
from cuewise.operators.ordered import BLOCK, fixed_blocks, scan
from cuewise.operators.similarity import cosine, dot, unit
from cuewise.operators.windows import merge_touching


def neighbours(vecs: DataFrame) -> DataFrame:
    """Similarity with the vector before (`sim`, null for the first), by position."""
    rows = scan(fixed_blocks(vecs, "pos"), ["video_id"], ["pos"], lag={"_pv": "vec", "_pp": "pos"}).drop(BLOCK)
    return rows.withColumn("sim", F.when(F.col("_pp").isNotNull(), cosine(F.col("_pv"), F.col("vec")))).drop("_pv", "_pp")


# Histogram bins, low end in and high end out.
BINS = [(-1.0, -0.5), (-0.5, 0.0), (0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0)]


def profile(sims: DataFrame, threshold: float) -> DataFrame:
    """Mean, population deviation, share below a threshold, counts and histogram of `sim` per video.
    A value of exactly 1 falls in no bin."""
    s = F.col("sim")
    share = F.when(F.count(s) > 0, F.count_if(s < threshold) * 100.0 / F.count(s))
    return sims.groupBy("video_id").agg(
        F.round(F.coalesce(F.avg(s), F.lit(0.0)), 3).alias("mu"), F.round(F.coalesce(F.stddev_pop(s), F.lit(0.0)), 3).alias("sigma"), F.round(share, 1).alias("percent_below"),
        F.count(F.lit(1)).alias("pairs_total"), F.count(s).alias("pairs_with_values"), F.count_if(s.isNull()).alias("pairs_missing"),
        *[F.count_if((s >= lo) & (s < hi)).alias(f"h{i}") for i, (lo, hi) in enumerate(BINS)])


def mean_pool(vecs: DataFrame) -> DataFrame:
    """Mean vector per video; null when dimensions differ. A task sends one running mean per video and dimension."""
    ok = vecs.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).select("video_id", F.col("vec").cast("array<double>").alias("vec"))
    means = ok.groupBy("video_id", F.size("vec").alias("_n")).agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("vec"))
    return means.groupBy("video_id").agg(F.when(F.count("*") == 1, F.any_value("vec")).alias("vec"))


def top_labels(vecs: DataFrame, labels: DataFrame, k: int, per_group: int = 256) -> DataFrame:
    """k most similar labels per vector, by cosine of unit vectors, ties by label.

    Labels `(label, vec)` are packed into groups of `per_group`; each vector meets each group once,
    keeps k of it, and the group winners are ranked. No group is larger than `per_group` vectors,
    so the shuffled or broadcast side is bounded per row whatever the number of labels.
    """
    numbered = labels.select("label", unit(F.col("vec")).alias("u")).where("u IS NOT NULL")
    n_groups = numbered.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(per_group))).cast("int").alias("n")).scalar()
    packed = numbered.groupBy(F.pmod(F.xxhash64("label"), n_groups).cast("int").alias("_g")).agg(F.collect_list(F.struct("label", "u")).alias("_labels"))
    rows = vecs.select("video_id", "vec_id", unit(F.col("vec")).alias("v")).withColumn("_g", F.explode(F.sequence(F.lit(0), n_groups - 1)))
    scored = rows.join(packed, "_g").select("video_id", "vec_id", F.slice(F.array_sort(F.transform("_labels", lambda t: F.struct((-dot(F.col("v"), t["u"])).alias("neg"), t["label"].alias("label")))), 1, k).alias("best"))
    flat = scored.select("video_id", "vec_id", F.explode("best").alias("b"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("b.neg", "b.label"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("video_id", "vec_id", "rank", "b.label", (-F.col("b.neg")).alias("score"))


def groups(sims: DataFrame, joins: Column) -> DataFrame:
    """Group number per row: a new group where `joins` is false; the first row opens group 0."""
    rows = sims.withColumn("_new", F.when(F.col("sim").isNull() | joins, 0).otherwise(1))
    return scan(fixed_blocks(rows, "pos"), ["video_id"], ["pos"], total={"grp": "_new"}).drop(BLOCK, "_new")


def spike_groups(sims: DataFrame, spike: float = 0.35, extra: float = 0.08, likeness: float = 0.55) -> DataFrame:
    """Split on a drop of `spike` confirmed by a header look of the row's text or by a larger drop.
    A video without a confirmed drop splits on a low similarity (mean − 2 deviations in [0.55, 0.92])."""
    delta = 1.0 - F.col("sim")
    header = F.col("text").startswith("[OCR_HEADER]") | (tx.title_likeness(F.substring("text", 1, 120)) >= likeness)
    rows = sims.withColumn("_ok", F.coalesce((delta >= spike) & (header | (delta >= spike + extra)), F.lit(False)))
    per = rows.groupBy("video_id").agg(F.max("_ok").alias("_any"), F.greatest(F.lit(0.55), F.least(F.lit(0.92), F.avg("sim") - 2.0 * F.stddev_pop("sim"))).alias("_t"))
    rows = rows.join(per, "video_id")
    split = F.when(F.col("_any"), F.col("_ok")).otherwise(F.coalesce(F.col("sim") < F.col("_t"), F.lit(False)))
    return groups(rows.withColumn("_split", split), ~F.col("_split")).drop("_ok", "_any", "_t", "_split")


def hysteresis_blocks(bins: DataFrame, threshold: float = 0.78, margin: float = 0.03, shortest: float = 60.0, gap: float = 12.0) -> DataFrame:
    """Bins `(video_id, pos, sim, start_s, end_s, title)` to blocks. A row joins at threshold + margin;
    a generic title needs 0.05 more. Short blocks go, blocks at most `gap` apart are joined. The
    title is the shortest of the first block, earliest on ties."""
    sim = F.when(tx.is_generic_title(F.col("title")) & (F.col("sim") < threshold + 0.05), 0.0).otherwise(F.col("sim"))
    rows = groups(bins.withColumn("sim", sim), sim >= threshold + margin)
    named = F.when(F.length("title") > 0, F.struct(F.length("title").alias("n"), "pos"))
    blocks = rows.groupBy("video_id", "grp").agg(F.min("start_s").alias("start_s"), F.max_by("end_s", "pos").alias("end_s"), F.min_by("title", named).alias("title"), F.min("pos").alias("event_id"))
    kept = blocks.where(F.col("end_s") - F.col("start_s") >= shortest)
    merged = merge_touching(kept.select("video_id", "start_s", "end_s", "event_id"), gap)
    first = kept.select("video_id", "start_s", "title")
    return merged.join(first, ["video_id", "start_s"]).select("video_id", "start_s", "end_s", "n", "title")


def module_step(threshold: float = 0.83, gap: float = 10.0):
    """Rows `(pos, start, end, last_bin, vec)`: `(pos, module)`. Joins the module before when similar to the sum of its
    vectors or close in time to its last bin's end. The state is the module's opener, last bin, its end and the vector sum."""

    def step(state, rows, last):
        out = []
        for pos, start, end, top, vec in rows:
            v = np.asarray([] if vec is None else vec, float)
            if state is not None:
                opener, held, until, total = state
                total = np.asarray(total, float)
                known = len(v) > 0 and len(v) == len(total)
                norm = np.sqrt(total @ total) * np.sqrt(v @ v) if known else 0.0
                if (total @ v / norm if norm else 0.0) >= threshold or start - until <= gap:
                    total = total + v if known else total if len(total) else v
                    state = [opener, max(held, top), end if top >= held else until, total]
                    out.append((pos, opener))
                    continue
            state = [pos, top, end, v]
            out.append((pos, pos))
        if last or not rows:
            state = state and [*state[:3], np.asarray(state[3]).tolist()]
        return out, state

    return step


# Title of a module without one, and what stands between joined summaries.
NO_TITLE, BETWEEN = "模組", "；"


def merge_modules(modules: DataFrame, threshold: float = 0.83, gap: float = 10.0) -> DataFrame:
    """Neighbouring modules `(video_id, pos, start_s, end_s, vec, title, summary, bins)` joined by similarity or
    nearness in time: `video_id, module, start_s, end_s, n, title, summary, bins`.

    Only the labels need the order of the rows: the running state holds one vector sum. Everything else is an
    aggregate per module. The title is the shortest, the earliest of equally short ones; where the first row has none it
    counts as `模組`. A summary is added unless the text so far holds it. Bins are united.
    """
    rows = modules.withColumn("last_bin", F.array_max("bins"))
    labels = fold(fixed_blocks(rows, "pos"), ["video_id"], ["pos"], ["pos", "start_s", "end_s", "last_bin", "vec"], module_step(threshold, gap), "pos long, module long")
    own = rows.drop("vec").join(labels, ["video_id", "pos"])
    text = lambda c: tx.strip(F.coalesce(c, F.lit("")))
    title = F.when(text(F.col("title")) != "", text(F.col("title"))).when(F.col("pos") == F.col("module"), F.lit(NO_TITLE))
    own = own.withColumn("title", title)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", text(F.col("summary")).alias("s")))), lambda x: x["s"])
    both = own.groupBy("video_id", "module").agg(
        F.min_by("start_s", "pos").alias("start_s"), F.max_by("end_s", F.struct("last_bin", "pos")).alias("end_s"), F.count("*").alias("n"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.struct(F.length("title").alias("k"), "pos"))).alias("title"),
        parts.alias("_parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bins")))).alias("bins"))
    joined = F.aggregate(F.slice("_parts", F.lit(2), F.size("_parts")), F.col("_parts")[0],
                         lambda all_, s: F.when((s != "") & ~F.contains(all_, s), F.btrim(F.concat(all_, F.lit(BETWEEN), s), F.lit(BETWEEN))).otherwise(all_))
    return both.select("video_id", "module", "start_s", "end_s", "n", "title", joined.alias("summary"), "bins")


def select_tokens(matrix: Column, strategy: str) -> Column:
    """Frame token matrices `array<array<array>>`: class token, all but it, or everything."""
    if strategy == "cls":
        return F.transform(matrix, lambda f: f[0])
    if strategy == "no_cls":
        return F.transform(matrix, lambda f: F.slice(f, F.lit(2), F.size(f)))
    if strategy == "full":
        return matrix
    raise ValueError(strategy)


def linspace_keep(pos: Column, count: Column, most: int) -> Column:
    """Whether a position is one of `most` evenly spaced ones (truncated); all when there are fewer."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (count - 1) / F.lit(max(1, most - 1))).cast("long"))
    return (count <= most) | F.array_contains(picks, pos.cast("long"))
