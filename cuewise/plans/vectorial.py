"""Vector operators on the embedding table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewise.functions import timefmt as tf
from cuewise.operators import folds as fo
from cuewise.operators import vectors as ve
from cuewise.operators.ordered import BLOCK, fixed_blocks
from cuewise.plans.registry import query
from cuewise.plans.texts import likeness_sql
from cuewise.plans.timebase import HMS_SQL

SIM_SQL = """
s AS (SELECT video_id, vec_id, pos, vec, CASE WHEN pv IS NOT NULL THEN list_inner_product(pv::DOUBLE[], vec::DOUBLE[]) / (sqrt(list_inner_product(pv::DOUBLE[], pv::DOUBLE[])) * sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[]))) END AS sim
  FROM (SELECT *, lag(vec) OVER (PARTITION BY video_id ORDER BY pos) AS pv FROM vec))
"""


@query("w5_adjacent_cosine", "vec", f"WITH {SIM_SQL} SELECT video_id, pos, round(sim, 6) AS sim FROM s WHERE sim IS NOT NULL")
def w5(t):
    return ve.neighbours(t.vec).where("sim IS NOT NULL").select("video_id", "pos", F.round("sim", 6).alias("sim"))


@query("a16_similarity_profile", "vec", f"""WITH {SIM_SQL}
SELECT video_id, round(avg(sim), 3) AS mu, round(stddev_pop(sim), 3) AS sigma, round(count(*) FILTER (WHERE sim < 0.5) * 100.0::DOUBLE / count(sim), 1) AS percent_below, count(*) AS pairs_total, count(sim) AS pairs_with_values, count(*) - count(sim) AS pairs_missing,
 count(*) FILTER (WHERE sim >= -1 AND sim < -0.5) AS h0, count(*) FILTER (WHERE sim >= -0.5 AND sim < 0) AS h1, count(*) FILTER (WHERE sim >= 0 AND sim < 0.2) AS h2, count(*) FILTER (WHERE sim >= 0.2 AND sim < 0.4) AS h3,
 count(*) FILTER (WHERE sim >= 0.4 AND sim < 0.6) AS h4, count(*) FILTER (WHERE sim >= 0.6 AND sim < 0.8) AS h5, count(*) FILTER (WHERE sim >= 0.8 AND sim < 1.0) AS h6 FROM s GROUP BY 1""")
def a16(t):
    return ve.profile(ve.neighbours(t.vec), 0.5)


@query("a18_mean_pool", "vec", """
SELECT video_id, i - 1 AS i, round(avg(x), 6) AS mean FROM (SELECT video_id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec)::DOUBLE AS x FROM vec) GROUP BY 1, 2""")
def a18(t):
    return ve.mean_pool(t.vec).select("video_id", F.posexplode("vec").alias("i", "m")).select("video_id", F.col("i").cast("long").alias("i"), F.round("m", 6).alias("mean"))


@query("j17_vector_top_k", "vec", """
WITH c AS (SELECT video_id AS label, list(m ORDER BY i) AS c FROM (SELECT video_id, i, avg(x) AS m FROM (SELECT video_id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec)::DOUBLE AS x FROM vec) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT v.video_id, vec_id, label, list_inner_product(vec::DOUBLE[], c) / (sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[])) * sqrt(list_inner_product(c, c))) AS sc FROM vec v, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sc DESC, label) AS rank FROM p) SELECT vec_id, rank, label, round(sc, 6) AS score FROM r WHERE rank <= 3""")
def j17(t):
    labels = ve.mean_pool(t.vec).withColumnRenamed("video_id", "label")
    return ve.top_labels(t.vec, labels, 3).select("vec_id", F.col("rank").cast("long").alias("rank"), "label", F.round("score", 6).alias("score"))


def doc_text(t):
    return t.documents.select(F.col("doc_id").alias("vec_id"), "text")


@query("f14_spike_segmentation", "vec", f"""WITH {SIM_SQL},
d AS (SELECT s.*, coalesce(text, '') AS tx FROM s LEFT JOIN documents ON doc_id = vec_id),
k AS (SELECT *, coalesce(1 - sim >= 0.9::DOUBLE AND (({likeness_sql("trim(left(tx, 120))")}) >= 0.55::DOUBLE OR 1 - sim >= 0.9::DOUBLE + 0.08::DOUBLE), false) AS ok FROM d),
p AS (SELECT *, bool_or(ok) OVER (PARTITION BY video_id) AS anyok, greatest(0.55, least(0.92, avg(sim) OVER (PARTITION BY video_id) - 2 * stddev_pop(sim) OVER (PARTITION BY video_id))) AS t FROM k),
g AS (SELECT video_id, pos, sum(CASE WHEN sim IS NULL THEN 0 WHEN anyok THEN ok::INT ELSE (sim < t)::INT END) OVER (PARTITION BY video_id ORDER BY pos) AS g FROM p)
SELECT video_id, CAST(g AS BIGINT) AS grp, min(pos) AS first_pos, count(*) AS n FROM g GROUP BY 1, 2""")
def f14(t):
    rows = ve.neighbours(t.vec).join(doc_text(t), "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return ve.spike_groups(rows, spike=0.9).groupBy("video_id", "grp").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))


@query("f15_similarity_groups", "vec", f"""WITH {SIM_SQL}, g AS (SELECT video_id, pos, sum(CASE WHEN sim < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY pos) AS g FROM s)
SELECT video_id, CAST(g AS BIGINT) AS grp, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM g GROUP BY 1, 2""")
def f15(t):
    rows = ve.groups(ve.neighbours(t.vec), F.col("sim") >= 0.05)
    return rows.groupBy("video_id", "grp").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


BINS_SQL = "bn AS (SELECT *, pos * 40.0::DOUBLE AS start_s, pos * 40.0::DOUBLE + 30 + pos % 2 * 5 AS end_s, CASE pos % 5 WHEN 0 THEN '說明' WHEN 1 THEN '' ELSE 'title ' || repeat('x', CAST(pos % 7 AS INT)) END AS title FROM s)"


def bins(t):
    p = F.col("pos")
    title = F.when(p % 5 == 0, "說明").when(p % 5 == 1, "").otherwise(F.concat(F.lit("title "), F.repeat(F.lit("x"), (p % 7).cast("int"))))
    return ve.neighbours(t.vec).select("*", (p * 40.0).alias("start_s"), (p * 40.0 + 30 + p % 2 * 5).alias("end_s"), title.alias("title"))


@query("f16_hysteresis_groups", "vec", f"""WITH {SIM_SQL}, {BINS_SQL},
k AS (SELECT *, CASE WHEN (trim(title) = '' OR title = '說明') AND sim < 0.02 + 0.05 THEN 0 ELSE sim END AS z FROM bn),
g AS (SELECT *, sum(CASE WHEN z IS NULL OR z >= 0.02::DOUBLE + 0.03::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY pos) AS g FROM k),
b AS (SELECT video_id, g, min(start_s) AS s, arg_max(end_s, pos) AS e, arg_min(title, length(title) * 100000 + pos) FILTER (WHERE title <> '') AS title FROM g GROUP BY 1, 2),
q AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM b WHERE e - s >= 60),
m AS (SELECT *, sum(CASE WHEN pk IS NULL OR s > pk + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s) AS m FROM q)
SELECT video_id, min(s) AS start_s, max(e) AS end_s, count(*) AS n, arg_min(title, s) AS title FROM m GROUP BY video_id, m""")
def f16(t):
    return ve.hysteresis_blocks(bins(t).drop("vec"), threshold=0.02, margin=0.03, gap=8.0)


@query("f17_adjacent_module_merge", "vec", f"""WITH RECURSIVE {SIM_SQL}, {BINS_SQL},
md AS (SELECT video_id, pos, vec::DOUBLE[] AS vec, start_s + pos % 3 * 8 AS start_s, end_s, title, CASE pos % 4 WHEN 0 THEN '' ELSE 'part ' || pos % 6 END AS summary, [2 * pos, 2 * pos + 1, 2 * pos + 2] AS bins FROM bn),
f AS (SELECT video_id, pos, pos AS module, end_s AS until, vec AS total FROM md WHERE pos = 0 UNION ALL
 SELECT video_id, pos, CASE WHEN j THEN module ELSE pos END, end_s, CASE WHEN j THEN list_transform(list_zip(total, vec), lambda z: z[1] + z[2]) ELSE vec END FROM
 (SELECT md.*, f.module, f.total, list_inner_product(f.total, md.vec) / (sqrt(list_inner_product(f.total, f.total)) * sqrt(list_inner_product(md.vec, md.vec))) >= 0.2::DOUBLE OR md.start_s - f.until <= 4 AS j
  FROM f JOIN md ON md.video_id = f.video_id AND md.pos = f.pos + 1)),
o AS (SELECT md.*, module, CASE WHEN trim(title) <> '' THEN trim(title) WHEN md.pos = module THEN '模組' END AS t FROM md JOIN f USING (video_id, pos)),
g AS (SELECT video_id, module, arg_min(start_s, pos) AS start_s, arg_max(end_s, pos) AS end_s, count(*) AS n, arg_min(t, (length(t), pos)) FILTER (WHERE t IS NOT NULL) AS title,
  list(summary ORDER BY pos) AS parts, list_sort(list_distinct(flatten(list(bins)))) AS bins FROM o GROUP BY 1, 2)
SELECT video_id, module, start_s, end_s, n, title, list_reduce(parts, lambda a, s: CASE WHEN s <> '' AND NOT contains(a, s) THEN trim(a || '；' || s, '；') ELSE a END) AS summary, array_to_string(bins, ',') AS bins FROM g""")
def f17(t):
    """Re-embedding of a merged module is replaced by the sum of its vectors."""
    p = F.col("pos")
    rows = bins(t).withColumns({"start_s": F.col("start_s") + p % 3 * 8, "summary": F.when(p % 4 == 0, "").otherwise(F.concat(F.lit("part "), p % 6)), "bins": F.array(2 * p, 2 * p + 1, 2 * p + 2)})
    return ve.merge_modules(rows, threshold=0.2, gap=4.0).withColumn("bins", F.array_join("bins", ","))


@query("f23_gated_selection", "vec", """WITH RECURSIVE
m AS (SELECT video_id, pos, vec::DOUBLE[] AS v, list_reduce(vec::DOUBLE[], lambda a, x: a + x) / len(vec) AS mean FROM vec),
o AS (SELECT video_id, pos, pos * 2.0::DOUBLE AS t, pos % 7 <> 3 AS ok, v, list_transform(v, lambda x: x > mean) AS h FROM m),
f AS (SELECT video_id, pos, ok AS picked, CASE WHEN ok THEN t END AS t0, CASE WHEN ok THEN h END AS h0, CASE WHEN ok THEN v END AS v0 FROM o WHERE pos = 0 UNION ALL
 SELECT video_id, pos, picked, CASE WHEN picked THEN t ELSE t0 END, CASE WHEN picked THEN h ELSE h0 END, CASE WHEN picked THEN v ELSE v0 END FROM (SELECT o.*, f.t0, f.h0, f.v0, o.ok AND (f.t0 IS NULL OR (
   o.t - f.t0 >= 3 AND len(list_filter(list_zip(o.h, f.h0), lambda z: z[1] <> z[2])) >= 5
   AND (o.t - f.t0 >= 20 OR list_inner_product(o.v, f.v0) / sqrt(list_inner_product(o.v, o.v) * list_inner_product(f.v0, f.v0)) < 0.2::DOUBLE))) AS picked
  FROM f JOIN o ON o.video_id = f.video_id AND o.pos = f.pos + 1))
SELECT video_id, pos FROM f WHERE picked""")
def f23(t):
    """Hash = sign bits of the vector against its mean; quality flag from the position."""
    mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("vec")
    bits = F.array_join(F.transform("vec", lambda x: F.when(x.cast("double") > F.col("mean"), "1").otherwise("0")), "")
    rows = t.vec.withColumn("mean", mean).select("video_id", "pos", (F.col("pos") * 2.0).alias("t"), (F.col("pos") % 7 != 3).alias("ok"), bits.alias("hash"), "vec")
    return fo.fold(fixed_blocks(rows, "pos"), ["video_id"], ["pos"], ["pos", "t", "ok", "hash", "vec"], fo.gate_step(3.0, 20.0, same=0.2), "pos long")


@query("x13_vector_functions", "vec", """
SELECT vec_id, round(sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[])), 6) AS norm, round(vec[1]::DOUBLE / sqrt(list_inner_product(vec::DOUBLE[], vec::DOUBLE[])), 6) AS first_unit,
 round(list_inner_product(vec::DOUBLE[], list_reverse(vec)::DOUBLE[]) / list_inner_product(vec::DOUBLE[], vec::DOUBLE[]), 6) AS self_reverse FROM vec""")
def x13_vectors(t):
    v = F.col("vec")
    return t.vec.select("vec_id", F.round(F.sqrt(ve.dot(v, v)), 6).alias("norm"), F.round(ve.unit(v)[0], 6).alias("first_unit"), F.round(ve.cosine(v, F.reverse(v)), 6).alias("self_reverse"))


@query("x25_first_prediction_at_one_second", "pred", """
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY x) - 1 AS i, x FROM (SELECT video_id, CASE WHEN idx = 0 AND start_s = 0 THEN 1 ELSE start_s END AS x FROM pred UNION ALL SELECT video_id, 1 FROM pred WHERE idx = 0 AND start_s <> 0)""")
def x25(t):
    """The black first frame is skipped: stamp 0 becomes 1, else 1 is put in front. One array per video, bounded by its seconds."""
    arr = F.sort_array(F.collect_list("start_s"))
    one = F.array(F.lit(1).cast("long"))
    ts = t.pred.groupBy("video_id").agg(arr.alias("a")).select("video_id", F.when(F.col("a")[0] == 0, F.concat(one, F.slice("a", F.lit(2), F.size("a")))).otherwise(F.concat(one, "a")).alias("a"))
    rows = ts.select("video_id", F.posexplode("a").alias("i", "x"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("x", "i")) - 1
    return rows.select("video_id", place.cast("long").alias("i"), "x")


@query("x26_frame_tokens", "vec", f"""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM vec)
SELECT v.vec_id, round(vec[1]::DOUBLE, 6) AS cls_first, 3 AS rest_tokens, round(vec[17]::DOUBLE, 6) AS rest_first,
 {HMS_SQL.format('round_even(pos * 600 / n::DOUBLE, 0)')} || ': ' || CASE WHEN n <= 20 OR list_contains([CAST(floor(i * (n - 1) / 19.0::DOUBLE) AS BIGINT) FOR i IN range(20)], pos) THEN '<frame>' ELSE 'image' END AS line FROM n v""")
def x26(t):
    """Each vector seen as four tokens of 16; evenly thinned frames keep their placeholder, others read "image"."""
    n = t.vec.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    frame = F.array(F.array(*[F.slice("vec", 16 * i + 1, 16) for i in range(4)]))
    rows = t.vec.join(n, "video_id").withColumn("m", frame)
    cls, rest = ve.select_tokens(F.col("m"), "cls"), ve.select_tokens(F.col("m"), "no_cls")
    keep = ve.linspace_keep(F.col("pos"), F.col("n"), 20)
    stamp = tf.sec_to_hms(F.bround(F.col("pos") * 600 / F.col("n")))
    return rows.select("vec_id", F.round(cls[0][0].cast("double"), 6).alias("cls_first"), F.size(rest[0]).alias("rest_tokens"), F.round(rest[0][0][0].cast("double"), 6).alias("rest_first"),
                       F.concat(stamp, F.lit(": "), F.when(keep, "<frame>").otherwise("image")).alias("line"))
