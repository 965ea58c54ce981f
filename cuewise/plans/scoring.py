"""Predicted chapters against reference chapters, and checks on chapter lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewise.functions import timefmt as tf
from cuewise.functions.chapterlines import parse_chapters
from cuewise.operators import chapters as ch
from cuewise.operators import metrics as me
from cuewise.operators.barrier import once
from cuewise.plans.registry import query


def sides(t, zero="add"):
    return tuple(ch.segments(x.select("video_id", "start_s", "duration"), zero) for x in (t.ref, t.pred))


SEGS_SQL = """
b AS (SELECT 'r' AS side, video_id, start_s AS s, duration FROM ref UNION SELECT 'r', video_id, 0, duration FROM ref
      UNION SELECT 'p', video_id, start_s, duration FROM pred UNION SELECT 'p', video_id, 0, duration FROM pred),
sg AS (SELECT side, video_id, row_number() OVER w - 1 AS i, CAST(s AS DOUBLE) AS s, CAST(coalesce(lead(s) OVER w, duration) AS DOUBLE) AS e
       FROM b WINDOW w AS (PARTITION BY side, video_id ORDER BY s)),
pairs AS (SELECT *, greatest(0, least(re, pe) - greatest(rs, ps)) / (least(greatest(re, pe) - least(rs, ps), re - rs + pe - ps) + 1e-8::DOUBLE) AS iou FROM
  (SELECT r.video_id, r.i, p.i AS j, r.s AS rs, r.e AS re, p.s AS ps, p.e AS pe FROM sg r JOIN sg p ON r.video_id = p.video_id AND r.side = 'r' AND p.side = 'p' AND r.e > p.s AND p.e > r.s)),
cnt AS (SELECT video_id, count(*) FILTER (WHERE side = 'r') AS n_ref, count(*) FILTER (WHERE side = 'p') AS n_pred FROM sg GROUP BY 1)
"""


@query("j5_temporal_iou_join", "ref pred", f"WITH {SEGS_SQL} SELECT video_id, i, j, round(iou, 9) AS iou FROM pairs WHERE iou > 0")
def j5(t):
    return me.iou_pairs(*sides(t)).select("video_id", F.col("i"), F.col("j"), F.round("iou", 9).alias("iou"))


NEAR_SQL = """
r AS (SELECT video_id, start_s AS x FROM ref WHERE start_s <> 0), p AS (SELECT video_id, start_s AS x FROM pred WHERE start_s <> 0),
near AS (SELECT 'r' AS side, r.video_id, r.x, min(abs(r.x - p.x)) AS dist FROM r LEFT JOIN p USING (video_id) GROUP BY ALL
  UNION ALL SELECT 'p', p.video_id, p.x, min(abs(r.x - p.x)) FROM p LEFT JOIN r USING (video_id) GROUP BY ALL)
"""


@query("j6_boundary_distance_join", "ref pred", f"""WITH {NEAR_SQL}
SELECT video_id, count(*) FILTER (WHERE side = 'r' AND dist < 30) AS refs_covered, count(*) FILTER (WHERE side = 'p' AND dist < 30) AS preds_covered FROM near GROUP BY 1""")
def j6(t):
    near = me.nearest_distance(t.ref.where("start_s <> 0"), t.pred.where("start_s <> 0"))
    return near.groupBy("video_id").agg(F.count_if(F.expr("side = 'r' AND dist < 30")).alias("refs_covered"), F.count_if(F.expr("side = 'p' AND dist < 30")).alias("preds_covered"))


@query("a3_chapter_count_error", "ref pred", f"""WITH {SEGS_SQL}
SELECT round(avg(abs(n_ref - n_pred)), 6) AS mae, round_even(100.0::DOUBLE * count(*) FILTER (WHERE n_ref > n_pred) / count(*), 2) AS under_pct,
  round_even(100.0::DOUBLE * count(*) FILTER (WHERE n_ref = n_pred) / count(*), 2) AS equal_pct, round_even(100.0::DOUBLE * count(*) FILTER (WHERE n_ref < n_pred) / count(*), 2) AS over_pct,
  CAST(0 AS BIGINT) AS missing FROM cnt WHERE n_ref > 0 AND n_pred > 0""")
def a3(t):
    return me.count_error(*sides(t))


PRF_SQL = f"""{SEGS_SQL},
thr AS (SELECT i AS t_no, 0.5::DOUBLE + 0.05::DOUBLE * i AS t FROM range(10) AS r(i)),
hit AS (SELECT video_id, t_no, count(DISTINCT i) FILTER (WHERE iou >= t) AS hr, count(DISTINCT j) FILTER (WHERE iou >= t) AS hp FROM pairs, thr GROUP BY ALL),
pr AS (SELECT c.video_id, t_no, coalesce(hp, 0) / greatest(n_pred, 1) AS p, coalesce(hr, 0) / n_ref AS r FROM cnt c CROSS JOIN thr LEFT JOIN hit USING (video_id, t_no) WHERE n_ref > 0 AND n_pred > 0),
prf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * (p * r) / (p + r) ELSE 0 END AS f FROM pr)
"""


@query("a4_overlap_prf", "ref pred", f"""WITH {PRF_SQL},
m AS (SELECT t_no, avg(p) * 100 AS p, avg(r) * 100 AS r, avg(f) * 100 AS f FROM prf GROUP BY 1)
SELECT t_no, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM m
UNION ALL SELECT -1, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM m""")
def a4(t):
    """Per threshold, and threshold number -1 for the mean over thresholds."""
    by = me.overlap_by_video(*sides(t)).groupBy("t_no").agg(*[(F.avg(c) * 100).alias(c) for c in ("p", "r", "f1")])
    # at most one row per threshold from here on
    mean = by.agg(*[F.avg(c).alias(c) for c in ("p", "r", "f1")]).select(F.lit(-1).alias("t_no"), "p", "r", "f1")
    return by.unionByName(mean).select(F.col("t_no").cast("long").alias("t_no"), F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round("f1", 6).alias("f1"))


@query("a5_older_overlap_prf", "ref pred", f"""WITH {SEGS_SQL},
thr AS (SELECT i AS t_no, 0.5::DOUBLE + 0.1::DOUBLE * i AS t FROM range(5) AS r(i)),
hit AS (SELECT video_id, t_no, count(DISTINCT i) FILTER (WHERE iou > t) AS hr, count(DISTINCT j) FILTER (WHERE iou > t) AS hp FROM pairs, thr GROUP BY ALL),
pr AS (SELECT c.video_id, t_no, coalesce(hp, 0) / greatest(n_pred, 1) AS p, coalesce(hr, 0) / n_ref AS r FROM cnt c CROSS JOIN thr LEFT JOIN hit USING (video_id, t_no) WHERE n_ref > 0 AND n_pred > 0),
m AS (SELECT t_no, round_even(sum(p) * 100 / count(*), 2) AS p, round_even(sum(r) * 100 / count(*), 2) AS r FROM pr GROUP BY 1),
mf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * r * p / (r + p) ELSE 0 END AS f FROM m)
SELECT t_no, p AS precision, r AS recall, round(f, 6) AS f1 FROM mf UNION ALL
SELECT -1, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM mf WHERE t_no < 4""")
def a5(t):
    """Strict thresholds; F1 from rounded means; row -1 is the mean of the first four."""
    thresholds = [0.5 + 0.1 * i for i in range(5)]
    by = me.overlap_by_video(*sides(t), thresholds, strict=True).groupBy("t_no").agg(
        F.bround(F.sum("p") * 100 / F.count("p"), 2).alias("p"), F.bround(F.sum("r") * 100 / F.count("r"), 2).alias("r"))
    by = by.withColumn("f1", me.f1(F.col("p"), F.col("r")))
    mean = by.where("t_no < 4").agg(*[F.avg(c).alias(c) for c in ("p", "r", "f1")]).select(F.lit(-1).alias("t_no"), *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])
    return by.unionByName(mean).select(F.col("t_no").cast("long").alias("t_no"), F.col("p").alias("precision"), F.col("r").alias("recall"), F.round("f1", 6).alias("f1"))


@query("a6_boundary_prf", "ref pred", f"""WITH {NEAR_SQL},
n AS (SELECT video_id, count(*) FILTER (WHERE side = 'r') AS n_ref, count(*) FILTER (WHERE side = 'p') AS n_pred FROM near GROUP BY 1),
dist AS (SELECT unnest([1, 3, 5, 10, 30, 60]) AS d),
pr AS (SELECT n.video_id, d, count(*) FILTER (WHERE side = 'p' AND dist < d) / greatest(n_pred, 1) AS p, CASE WHEN n_ref > 0 THEN count(*) FILTER (WHERE side = 'r' AND dist < d) / n_ref END AS r
  FROM n JOIN near USING (video_id) CROSS JOIN dist GROUP BY n.video_id, d, n_ref, n_pred),
m AS (SELECT d, round_even(sum(p) * 100 / count(p), 2) AS p, round_even(sum(r) * 100 / count(r), 2) AS r FROM pr GROUP BY 1),
mf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * r * p / (r + p) ELSE 0 END AS f FROM m)
SELECT d AS distance, p AS precision, r AS recall, round(f, 6) AS f1 FROM mf UNION ALL SELECT -1, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM mf""")
def a6(t):
    by = me.distance_by_video(t.ref, t.pred).groupBy("distance").agg(
        F.bround(F.sum("p") * 100 / F.count("p"), 2).alias("p"), F.bround(F.sum("r") * 100 / F.count("r"), 2).alias("r"))
    by = by.withColumn("f1", me.f1(F.col("p"), F.col("r")))
    mean = by.agg(*[F.avg(c).alias(c) for c in ("p", "r", "f1")]).select(F.lit(-1).alias("distance"), *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])
    return by.unionByName(mean).select("distance", F.col("p").alias("precision"), F.col("r").alias("recall"), F.round("f1", 6).alias("f1"))


@query("a7_equal_count_videos", "ref pred", f"""WITH {SEGS_SQL},
eq AS (SELECT r.video_id, r.s AS rs, r.e AS re, p.s AS ps, p.e AS pe, n_ref FROM sg r JOIN sg p ON r.video_id = p.video_id AND r.i = p.i AND r.side = 'r' AND p.side = 'p' JOIN cnt c ON c.video_id = r.video_id WHERE n_ref = n_pred),
o AS (SELECT video_id, round(sum(100 * greatest(0, least(re, pe) - greatest(rs, ps)) / (least(greatest(re, pe) - least(rs, ps), re - rs + pe - ps) + 1e-8::DOUBLE)) / min(n_ref), 6) AS mean_iou,
   round(sum(greatest(0, least(re, pe) - greatest(rs, ps))) * 100 / max(re), 6) AS over_frames FROM eq GROUP BY 1),
r AS (SELECT video_id, start_s AS x, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS k, count(*) OVER (PARTITION BY video_id) AS n FROM ref WHERE start_s <> 0),
p AS (SELECT video_id, start_s AS x, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS k, count(*) OVER (PARTITION BY video_id) AS n FROM pred WHERE start_s <> 0),
d AS (SELECT r.video_id, round(avg(abs(r.x - p.x)), 6) AS mean_distance FROM r JOIN p ON r.video_id = p.video_id AND r.k = p.k AND r.n = p.n GROUP BY 1)
SELECT video_id, mean_iou, over_frames, mean_distance FROM o FULL JOIN d USING (video_id)""")
def a7(t):
    score = me.iou(F.col("ps"), F.col("pe"), F.col("rs"), F.col("re"))
    shared = F.greatest(F.lit(0.0), F.least("re", "pe") - F.greatest("rs", "ps"))
    o = me.paired_by_rank(*sides(t)).groupBy("video_id").agg(
        F.round(F.sum(score * 100) / F.min("n_ref"), 6).alias("mean_iou"), F.round(F.sum(shared) * 100 / F.max("re"), 6).alias("over_frames"))
    d = me.paired_by_rank(*sides(t, "remove")).groupBy("video_id").agg(F.round(F.avg(F.abs(F.col("rs") - F.col("ps"))), 6).alias("mean_distance"))
    return o.join(d, "video_id", "full")


GREEDY_SQL = f"""WITH RECURSIVE {SEGS_SQL},
k AS (SELECT video_id, i, j, iou, row_number() OVER (PARTITION BY video_id ORDER BY iou DESC, i, j) AS n FROM pairs WHERE iou > 0),
g AS (SELECT video_id, n, i, j, iou, true AS taken, [i] AS ui, [j] AS uj FROM k WHERE n = 1
  UNION ALL SELECT k.video_id, k.n, k.i, k.j, k.iou, NOT (list_contains(ui, k.i) OR list_contains(uj, k.j)),
    CASE WHEN list_contains(ui, k.i) OR list_contains(uj, k.j) THEN ui ELSE list_append(ui, k.i) END,
    CASE WHEN list_contains(ui, k.i) OR list_contains(uj, k.j) THEN uj ELSE list_append(uj, k.j) END
  FROM g JOIN k ON k.video_id = g.video_id AND k.n = g.n + 1)
"""


@query("f21_greedy_assignment", "ref pred", GREEDY_SQL + " SELECT video_id, i, j, round(iou, 9) AS iou FROM g WHERE taken")
def f21(t):
    return me.greedy_matching(me.iou_pairs(*sides(t))).select("video_id", "i", "j", F.round("iou", 9).alias("iou"))


@query("a8_mean_best_iou", "ref pred", GREEDY_SQL + " SELECT round(avg(m) * 100, 6) AS avg_tiou, count(*) AS videos FROM (SELECT video_id, avg(iou) AS m FROM g WHERE taken GROUP BY 1)")
def a8(t):
    per_video = me.greedy_matching(me.iou_pairs(*sides(t))).groupBy("video_id").agg(F.avg("iou").alias("m"))
    return per_video.agg(F.round(F.avg("m") * 100, 6).alias("avg_tiou"), F.count(F.lit(1)).alias("videos"))


@query("d3_mergeable_metric_state", "ref pred", f"""WITH {PRF_SQL}
SELECT round(sum(p), 6) AS sum_p, round(sum(r), 6) AS sum_r, round(sum(f), 6) AS sum_f1, count(*) AS n,
  round(sum(p) * 100 / count(*), 6) AS precision, round(sum(r) * 100 / count(*), 6) AS recall, round(sum(f) * 100 / count(*), 6) AS f1 FROM prf WHERE t_no = 0""")
def d3(t):
    """Partial states per group of videos, merged by adding; kept in double."""
    state = [F.sum("p").alias("sum_p"), F.sum("r").alias("sum_r"), F.sum("f1").alias("sum_f1"), F.count(F.lit(1)).alias("n")]
    partial = me.overlap_by_video(*sides(t), [0.5]).groupBy(F.pmod(F.xxhash64("video_id"), F.lit(16))).agg(*state)
    s = partial.agg(*[F.sum(c).alias(c) for c in ("sum_p", "sum_r", "sum_f1", "n")])
    return s.select(*[F.round(c, 6).alias(c) for c in ("sum_p", "sum_r", "sum_f1")], "n",
                    *[F.round(F.col(c) * 100 / F.col("n"), 6).alias(n) for c, n in (("sum_p", "precision"), ("sum_r", "recall"), ("sum_f1", "f1"))])


@query("a14_coverage_ratio", "ref seg", """
WITH l AS (SELECT video_id, max(start_s) AS last_chapter FROM ref GROUP BY 1), a AS (SELECT video_id, max(start_s) AS last_asr FROM seg GROUP BY 1)
SELECT video_id, round(CASE WHEN coalesce(last_asr, 0) <= 0 THEN 1.0 ELSE last_chapter / last_asr END::DOUBLE, 9) AS ratio,
  coalesce(last_asr, 0) >= 3600 AND last_chapter / last_asr < 0.6::DOUBLE AS retry FROM l LEFT JOIN a USING (video_id)""")
def a14(t):
    last = t.ref.groupBy("video_id").agg(F.max("start_s").alias("c")).join(t.seg.groupBy("video_id").agg(F.max("start_s").alias("a")), "video_id", "left")
    asr = F.coalesce("a", F.lit(0.0))
    ratio = F.when(asr <= 0, F.lit(1.0)).otherwise(F.col("c") / asr)
    return last.select("video_id", F.round(ratio, 9).alias("ratio"), ((asr >= 3600) & (ratio < 0.6)).alias("retry"))


# Words that mark an instructive title.
QUALITY_WORDS = ["講解", "原理", "範例", "練習", "實作", "應用", "總結", "重點", "概念", "方法", "技巧", "步驟", "案例", "分析"]


@query("a15_title_quality", "ref", """
WITH w AS (SELECT unnest(['講解', '原理', '範例', '練習', '實作', '應用', '總結', '重點', '概念', '方法', '技巧', '步驟', '案例', '分析']) AS word),
r AS (SELECT video_id, title || CASE start_s % 7 WHEN 0 THEN '重點' WHEN 1 THEN ' 範例與練習' ELSE '' END AS title FROM ref),
n AS (SELECT video_id, count(*) AS titles, string_agg(title, ' ') AS tt FROM r GROUP BY 1)
SELECT video_id, round(least(1.0, (SELECT count(*) FROM w WHERE contains(tt, word)) / greatest(1, titles * 0.7::DOUBLE)), 9) AS quality FROM n""")
def a15(t):
    """Whether a word occurs in any title is a per-word flag, so titles need not be joined."""
    s = F.col("start_s") % 7
    titles = t.ref.withColumn("title", F.concat("title", F.when(s == 0, "重點").when(s == 1, " 範例與練習").otherwise("")))
    flags = titles.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.col("title").contains(w).cast("int")).alias(f"w{i}") for i, w in enumerate(QUALITY_WORDS)])
    hits = sum((F.col(f"w{i}") for i in range(len(QUALITY_WORDS))), F.lit(0))
    return flags.select("video_id", F.round(F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), F.col("n") * 0.7)), 9).alias("quality"))


STAMPED_SQL = r"""
st AS (SELECT video_id, idx, title, duration, start_s, CASE idx % 5 WHEN 0 THEN printf('%d:%02d', start_s // 60 % 60, start_s % 60) WHEN 1 THEN printf('%02d:%02d:%02d', start_s // 3600 + 3, start_s % 3600 // 60, start_s % 60)
   WHEN 2 THEN printf('%02d:%02d:%02d', start_s // 3600, start_s % 120, start_s % 60) ELSE printf('%02d:%02d:%02d', start_s // 3600, start_s % 3600 // 60, start_s % 60) END AS stamp FROM ref)
"""


def stamped(t):
    """REF with stamps of mixed quality: short, past the end, out of range, good."""
    s, k = F.col("start_s"), F.col("idx") % 5
    stamp = (F.when(k == 0, F.format_string("%d:%02d", F.floor(s / 60) % 60, s % 60))
             .when(k == 1, F.format_string("%02d:%02d:%02d", F.floor(s / 3600) + 3, F.floor(s % 3600 / 60), s % 60))
             .when(k == 2, F.format_string("%02d:%02d:%02d", F.floor(s / 3600), s % 120, s % 60)).otherwise(tf.sec_to_hms(s)))
    return once(t.ref, stamp=stamp)


@query("p10_timestamp_validation", "ref", f"""WITH {STAMPED_SQL},
n AS (SELECT *, CASE WHEN len(string_split(stamp, ':')) = 2 THEN '00:' || lpad(stamp, 5, '0') ELSE stamp END AS norm FROM st),
a AS (SELECT *, [CAST(x AS BIGINT) FOR x IN string_split(norm, ':')] AS a FROM n),
v AS (SELECT *, CASE WHEN a[2] < 60 THEN a[1] * 3600 + a[2] * 60 + a[3] ELSE -1 END AS sec FROM a),
k AS (SELECT * FROM v WHERE sec BETWEEN 0 AND duration)
SELECT video_id, count(DISTINCT norm) AS kept, (max(sec) - min(sec)) AS span_s, round((max(sec) - min(sec)) * 100 / min(duration), 6) AS span_pct,
  count(*) FILTER (WHERE sec < 60) AS first_minute, (max(sec) - min(sec)) * 100 / min(duration) < 10 AND min(duration) > 600 AS clustered,
  count(*) FILTER (WHERE sec < 60) > count(*) * 0.5 AS crowded_start FROM k GROUP BY 1""")
def p10(t):
    rows = once(once(stamped(t), norm=tf.normalize_stamp(F.col("stamp"))), sec=tf.hms_to_sec(F.col("norm"), "two_part"))
    kept = rows.where((F.col("sec") >= 0) & (F.col("sec") <= F.col("duration")))
    span = F.max("sec") - F.min("sec")
    pct = F.when(F.min("duration") > 0, span * 100 / F.min("duration")).otherwise(0.0)
    early = F.count_if(F.col("sec") < 60)
    return kept.groupBy("video_id").agg(
        F.count_distinct("norm").alias("kept"), span.alias("span_s"), F.round(pct, 6).alias("span_pct"), early.alias("first_minute"),
        ((pct < 10) & (F.min("duration") > 600)).alias("clustered"), (early > F.count(F.lit(1)) * 0.5).alias("crowded_start"))


@query("p11_chapter_list_filter", "ref", f"""WITH {STAMPED_SQL},
c AS (SELECT video_id, idx, CASE WHEN idx % 4 = 3 THEN '' ELSE title END AS title, stamp, duration - 600 AS lim FROM st WHERE length(stamp) = 8),
u AS (SELECT video_id, stamp, arg_max(title, idx) AS title, min(idx) AS pos, min(lim) AS lim FROM c GROUP BY 1, 2),
w AS (SELECT 'cut' AS kind, video_id, stamp, title FROM u WHERE stamp <= printf('%02d:%02d:%02d', lim // 3600, lim % 3600 // 60, lim % 60) AND title <> ''
 UNION ALL SELECT 'as_given', video_id, stamp, title FROM (SELECT *, bool_or(bad) OVER (PARTITION BY video_id) AS anybad FROM (SELECT *, coalesce(stamp < lag(stamp) OVER (PARTITION BY video_id ORDER BY pos), false) AS bad FROM u)) WHERE NOT anybad AND title <> '')
SELECT kind, video_id, stamp, title FROM (SELECT *, count(*) OVER (PARTITION BY kind, video_id) AS n FROM w) WHERE NOT (n = 1 AND stamp = '00:00:00')""")
def p11(t):
    rows = stamped(t).where(F.length("stamp") == 8).withColumn("title", F.when(F.col("idx") % 4 == 3, "").otherwise(F.col("title")))
    maps = rows.groupBy("video_id", "stamp").agg(F.max_by("title", "idx").alias("title"), F.min("idx").alias("pos"), F.min("duration").alias("duration"))
    cut = ch.filter_list(maps, limit=tf.sec_to_hms(F.col("duration") - 600)).select(F.lit("cut").alias("kind"), "video_id", "stamp", "title")
    return cut.unionByName(ch.filter_list(maps).select(F.lit("as_given").alias("kind"), "video_id", "stamp", "title"))


@query("t1_chapter_order", "ref", f"""WITH {STAMPED_SQL},
a AS (SELECT *, [CAST(x AS BIGINT) FOR x IN string_split(stamp, ':')] AS a FROM st),
s AS (SELECT *, CASE len(a) WHEN 2 THEN a[1] * 60 + a[2] ELSE a[1] * 3600 + a[2] * 60 + a[3] END AS sec, idx % 6 = 5 AS broken FROM a)
SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN broken THEN NULL ELSE sec END NULLS LAST, idx) AS place FROM s""")
def t1(t):
    sec = F.when(F.col("idx") % 6 == 5, F.lit(None)).otherwise(tf.hms_to_sec(F.col("stamp"), "null"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(sec.asc_nulls_last(), "idx"))
    return stamped(t).select("video_id", "idx", place.cast("long").alias("place"))


@query("x5_chapter_line_parsing", "", r"""
WITH l AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
q AS (SELECT doc_id, i, trim(regexp_replace(w, '[:\[\]\-*•–—0-9]+', ' ', 'g')) AS w, printf('%02d:%02d:%02d', i // 240 % 24, i // 4 % 60, i % 4 * 15) AS st FROM l),
r AS (SELECT doc_id, i, st, regexp_replace(w, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS w FROM q),
cur AS (SELECT 'current' AS variant, doc_id, st AS stamp, arg_max(w, i) AS title, min(i) AS pos FROM r WHERE doc_id % 2 = 0 AND w <> '' GROUP BY doc_id, st
  UNION ALL SELECT 'current', doc_id, st, arg_min(w, i), min(i) FROM r WHERE doc_id % 2 = 1 AND w <> '' GROUP BY doc_id, st),
leg AS (SELECT 'legacy' AS variant, doc_id, st AS stamp, arg_min(CASE WHEN doc_id % 2 = 0 THEN w ELSE w END, i) AS title, min(i) AS pos FROM r WHERE w <> '' GROUP BY doc_id, st),
clk AS (SELECT 'clock' AS variant, doc_id, st AS stamp, arg_max(CASE WHEN doc_id % 2 = 0 THEN w ELSE '* [] ' || w END, i) AS title, min(i) AS pos FROM r WHERE w <> '' OR doc_id % 2 = 1 GROUP BY doc_id, st)
SELECT * FROM cur UNION ALL SELECT * FROM leg UNION ALL SELECT variant, doc_id, stamp, CASE WHEN title = '* [] ' THEN '* []' ELSE title END, pos FROM clk""")
def x5(t):
    """Document lines rendered as replies: dashed lines in even documents, bracket bullets in odd ones."""
    lines = F.transform(F.split("text", "\n"), lambda w, i: F.struct(
        F.format_string("%02d:%02d:%02d", F.floor(i / 240) % 24, F.floor(i / 4) % 60, i % 4 * 15).alias("st"),
        F.trim(F.regexp_replace(w, r"[:\[\]\-*•–—0-9]+", " ")).alias("w")))
    reply = F.transform(lines, lambda x: F.when(F.col("doc_id") % 2 == 0, F.concat(x["st"], F.lit(" - "), x["w"])).otherwise(F.concat(F.lit("* ["), x["st"], F.lit("] "), x["w"])))
    replies = t.documents.select("doc_id", F.concat_ws("\n", reply).alias("reply"))
    out = None
    for v in ("current", "legacy", "clock"):
        rows = parse_chapters(replies, "doc_id", "reply", v).select(F.lit(v).alias("variant"), "doc_id", "stamp", "title", F.col("pos").cast("long").alias("pos"))
        out = rows if out is None else out.unionByName(rows)
    return out
