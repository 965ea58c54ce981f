"""Chunking, gap lines and similarity of neighbouring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions.timefmt import sec_to_hms
from cuewise.operators import folds as fo
from cuewise.operators.ordered import BLOCK, density_blocks, fixed_blocks, scan
from cuewise.operators.textrows import per_text, weighted
from cuewise.operators.windows import joined_text
from cuewise.session import checkpointed


def chunk_chapters(hits: DataFrame, most: int = 600, carry: int = 50) -> DataFrame:
    """Token-bounded chunks inside chapters.

    `hits`: video_id, chapter_idx, title, line_no, start_s, end_s, text. A chapter that fits is
    one chunk. Otherwise a chunk is flushed before it would exceed `most`, carrying whole texts
    of at most `carry` tokens into the next one; its start stays the flushing row's start, and
    its estimate is taken again on the joined text.
    """
    key = ["video_id", "chapter_idx"]
    filled = F.col("text") != ""
    # the join behind them is made once
    hits = checkpointed(hits)
    total = hits.groupBy(*key).agg(
        F.sum(F.when(filled, tx.count_of(F.col("text"), tx.HAN_WIDE)).otherwise(0)).alias("han"),
        (F.sum(F.when(filled, F.length("text") + 1).otherwise(0)) - 1).alias("len"),
        F.min("start_s").alias("first_s"), F.max_by("end_s", F.struct("start_s", "line_no")).alias("last_e"))
    total = total.select(*key, tx.chunk_tokens_of(F.col("han"), F.greatest(F.col("len"), F.lit(0))).alias("tok"), "first_s", "last_e")
    # read by both branches, and by each step that cuts long chapters into blocks
    rows = checkpointed(hits.join(total, key))

    small = rows.where(F.col("tok") <= most).groupBy(*key, "first_s", "last_e").agg(
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.when(filled, F.struct("start_s", "line_no", "text")))), lambda r: r["text"])).alias("text"))
    small = small.select(*key, F.lit(0).cast("long").alias("chunk_index"), F.col("first_s").alias("start_s"), F.col("last_e").alias("end_s"), "text")

    big = rows.where(F.col("tok") > most).withColumn("text", tx.strip(F.col("text"))).where("text <> ''").withColumn("k", tx.chunk_tokens(F.col("text")))
    cols = ["line_no", "k", "start_s", "text", "first_s", "last_e"]
    parts = fo.fold(density_blocks(big, key, "start_s", tie="line_no"), key, ["start_s", "line_no"], cols, fo.chunk_step(most, carry),
                    "line_no long, chunk_index long, carried boolean, start_s double, text string, first_s double, last_e double")
    chunks = parts.groupBy(*key, "chunk_index", "first_s", "last_e").agg(
        joined_text(["start_s", "line_no"], "text", " ").alias("text"), F.min(F.when(~F.col("carried"), F.col("start_s"))).alias("own"))
    w = Window.partitionBy(*key).orderBy("chunk_index")
    large = chunks.select(*key, "chunk_index", F.when(F.col("chunk_index") == 0, F.col("first_s")).otherwise(F.col("own")).alias("start_s"),
                          F.coalesce(F.lead("own").over(w), "last_e").alias("end_s"), "text")
    out = small.unionByName(large)
    return out.select("*", F.concat(F.lit("ch"), "chapter_idx", F.lit("_"), "chunk_index").alias("chunk_id"), sec_to_hms(F.col("start_s")).alias("start_hms"),
                      sec_to_hms(F.col("end_s")).alias("end_hms"), tx.chunk_tokens(F.col("text")).alias("token_estimate"))


def gap_lines(segments: DataFrame, max_gap: float = 10.0, shortest: float = 60.0) -> DataFrame:
    """Segments joined while the step to the next start is at most `max_gap`; short groups go, but the
    last one stays when nothing else does.

    One row per segment with its group, the group's `[HMS-HMS]` head and its text: an unbroken
    transcript is one group, so its text is not put into one cell.
    """
    rows = scan(fixed_blocks(segments, "seg_idx"), ["video_id"], ["seg_idx"], lag={"_prev": "start_s"})
    rows = rows.withColumn("_new", F.when(F.col("start_s") - F.col("_prev") > max_gap, 1).otherwise(0)).drop("_prev")
    rows = scan(rows, ["video_id"], ["seg_idx"], total={"grp": "_new"}).drop(BLOCK)
    groups = rows.groupBy("video_id", "grp").agg(F.min("start_s").alias("s"), F.max("start_s").alias("e"))
    long = F.col("e") - F.col("s") >= shortest
    per = groups.groupBy("video_id").agg(F.max("grp").alias("_last"), F.count_if(long).alias("_n"))
    head = F.concat(F.lit("["), sec_to_hms(F.col("s")), F.lit("-"), sec_to_hms(F.col("e")), F.lit("]"))
    kept = groups.join(per, "video_id").where(long | ((F.col("grp") == F.col("_last")) & (F.col("_n") == 0))).select("video_id", "grp", head.alias("head"))
    return rows.join(kept, ["video_id", "grp"]).select("video_id", "grp", "seg_idx", "head", tx.strip(F.col("text")).alias("text"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either is missing or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNotNull() & b.isNotNull() & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def unit(v: Column) -> Column:
    """Vector of length one; null for a zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def line_similarity(lines: DataFrame) -> DataFrame:
    """Cosine of the keyword vectors of each line and the line before; null when one has no words."""

    def sims(rows: list[tuple]) -> list[tuple]:
        w = weighted(rows)
        out = []
        for no, _ in rows:
            if no > 0:
                a, b = w.get(no), w.get(no - 1)
                out.append((no, None if a is None or b is None else sum(x * b.get(word, 0.0) for word, x in a.items())))
        return out

    known = per_text(lines, sims, "line_no long, sim double").select("video_id", "line_no", F.round("sim", 9).alias("sim"))
    rest = lines.where("video_id IS NULL AND line_no > 0").select("video_id", F.col("line_no").cast("long").alias("line_no"), F.lit(None).cast("double").alias("sim"))
    return known.unionByName(rest)


def cosine_blocks(lines: DataFrame, sims: DataFrame, low: float = 0.55, high: float = 0.92, sigmas: float = 2.0, step: float = 0.05,
                  tries: int = 6, floor: float = 0.55, wanted: int = 3) -> DataFrame:
    """Block number per line. Threshold = mean − sigmas·deviation, clamped; then the back-off sweep.
    A missing similarity never splits. Videos without any similarity are left to keyword segmentation."""
    base = sims.groupBy("video_id").agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"), F.count("sim").alias("c")).where("c > 0")
    t0 = base.select("video_id", F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.col("m") - sigmas * F.col("s"))), 9).alias("t0"))
    ts = [F.round(F.greatest(F.lit(floor), F.col("t0") - step * a), 9) for a in range(tries + 1)]
    counted = sims.join(t0, "video_id").groupBy("video_id", "t0").agg(*[(1 + F.count_if(F.col("sim") < t)).alias(f"b{a}") for a, t in enumerate(ts)])
    chosen = ts[tries]
    for a in range(tries - 1, -1, -1):
        chosen = F.when((F.col(f"b{a}") >= wanted) | (ts[a] <= floor), ts[a]).otherwise(chosen)
    use = counted.select("video_id", chosen.alias("t"))
    keep = lines.select("video_id", F.col("line_no").cast("long").alias("line_no")).join(t0.select("video_id"), "video_id", "left_semi")
    rows = keep.join(sims, ["video_id", "line_no"], "left").join(use, "video_id", "left").withColumn("_sp", F.when(F.col("sim") < F.col("t"), 1).otherwise(0))
    return scan(fixed_blocks(rows.select("video_id", "line_no", "_sp"), "line_no"), ["video_id"], ["line_no"], total={"block_no": "_sp"}).drop(BLOCK, "_sp")
