"""Range joins, nearest matches, merges by key and running windows on timed rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions import timefmt as tf
from cuewise.operators import chapters as ch
from cuewise.operators import metrics as me
from cuewise.operators import windows as wi
from cuewise.operators.ordered import BLOCK, density_blocks, fixed_blocks, scan
from cuewise.operators.ranges import overlap_join
from cuewise.plans.registry import query
from cuewise.plans.timebase import HMS_SQL, TOK_SQL, TRIM_SQL, thin_sql

MICRO_SQL = """
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS rn FROM seg),
win AS (SELECT video_id, greatest(0, start_s - 5) AS w_start, start_s + 15 AS w_end FROM n WHERE (rn - 1) % 3 = 0)
"""


def micro(t, n=3):
    return wi.every_nth(t.seg, n).select("video_id", F.greatest(F.lit(0.0), F.col("start_s") - 5).alias("w_start"), (F.col("start_s") + 15).alias("w_end"))


@query("j1_interval_overlap_join", "seg", f"""WITH {MICRO_SQL}
SELECT w.video_id, w_start, w_end, string_agg(trim(text), ' ' ORDER BY start_s, seg_idx) AS text FROM win w JOIN seg s
ON w.video_id = s.video_id AND s.end_s > w_start AND s.start_s < w_end AND trim(text) <> '' GROUP BY ALL""")
def j1(t):
    return wi.text_in_windows(t.seg, micro(t)).select("video_id", "w_start", "w_end", "text")


@query("j2_tumbling_windows", "seg", """
WITH sp AS (SELECT video_id, min(start_s) AS lo, max(end_s) AS hi FROM seg GROUP BY 1),
w AS (SELECT video_id, lo + k * 50.0::DOUBLE AS w_start, least(lo + (k + 1) * 50.0::DOUBLE, hi) AS w_end FROM sp, range(2000) AS r(k) WHERE lo + k * 50.0::DOUBLE < hi)
SELECT video_id, w_start, w_end, text FROM (SELECT w.video_id, w_start, w_end, trim(string_agg(text, ' ' ORDER BY start_s, seg_idx)) AS text
  FROM w JOIN seg s ON w.video_id = s.video_id AND s.end_s > w_start AND s.start_s < w_end GROUP BY ALL) WHERE text <> ''""")
def j2(t):
    return wi.tumbling_text(t.seg, 50.0)


def slide_sql(x):
    return TRIM_SQL.format(
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + x + r", '\b\d{{2}}:\d{{2}}:\d{{2}}\b', ' ', 'g'), '\b(?:\d{{4}}/\d{{1,2}}/\d{{1,2}}|202\d-\d{{1,2}}-\d{{1,2}})\b', ' ', 'g'), '[℃°]\s*\S*', ' ', 'g'), '[\s\p{{Z}}]{{2,}}', ' ', 'g')".replace("{{", "{").replace("}}", "}"))


def speech_sql(x):
    return TRIM_SQL.format(r"regexp_replace(regexp_replace(" + x + r", '(字幕由\s*Amara\.org\s*社群提供\s*){2,}', ' ', 'g'), '[\s\p{Z}]{2,}', ' ', 'g')")


@query("j3_sliding_window_fusion", "seg lin", f"""
WITH tot AS (SELECT video_id, max(e) AS total FROM (SELECT video_id, end_s AS e FROM seg UNION ALL SELECT video_id, start_s FROM lin) GROUP BY 1),
w AS (SELECT video_id, k * 195.0::DOUBLE AS t0, least(k * 195.0::DOUBLE + 240, total) AS t1 FROM tot, range(2000) AS r(k) WHERE k * 195.0::DOUBLE < total),
a AS (SELECT w.video_id, t0, {speech_sql(f"string_agg({TRIM_SQL.format('text')}, chr(10) ORDER BY start_s, seg_idx)")} AS a FROM w JOIN seg s ON w.video_id = s.video_id AND s.end_s >= t0 AND s.start_s <= t1 GROUP BY ALL),
o AS (SELECT w.video_id, t0, {slide_sql(f"string_agg({TRIM_SQL.format('text')}, chr(10) ORDER BY start_s, line_no)")} AS o FROM w JOIN lin s ON w.video_id = s.video_id AND s.start_s >= t0 AND s.start_s <= t1 GROUP BY ALL),
f AS (SELECT video_id, t0, t1, coalesce(a, '') || CASE WHEN coalesce(o, '') <> '' THEN chr(10) || '[SLIDE]' || chr(10) || o ELSE '' END AS fused FROM w LEFT JOIN a USING (video_id, t0) LEFT JOIN o USING (video_id, t0))
SELECT video_id, t0, t1, fused FROM f WHERE {TRIM_SQL.format('fused')} <> ''""")
def j3(t):
    speech = t.seg.select("video_id", F.lit(0).alias("src"), "start_s", "end_s", F.col("seg_idx").cast("long").alias("pos"), "text")
    slides = t.lin.select("video_id", F.lit(1).alias("src"), "start_s", F.col("start_s").alias("end_s"), F.col("line_no").cast("long").alias("pos"), "text")
    both = speech.unionByName(slides).withColumn("text", tx.strip(F.col("text")))
    totals = both.groupBy("video_id").agg(F.max("end_s").alias("total"))
    rows = wi.sliding_members(both, totals, 240.0, 45.0)
    per = rows.groupBy("video_id", "t0", "t1", "src").agg(wi.joined_text(["start_s", "pos"], "text", "\n").alias("text"))
    sides = per.groupBy("video_id", "t0", "t1").agg(F.max(F.when(F.col("src") == 0, tx.clean_speech_text(F.col("text")))).alias("a"),
                                                    F.max(F.when(F.col("src") == 1, tx.clean_slide_text(F.col("text")))).alias("o"))
    fused = F.concat(F.coalesce("a", F.lit("")), F.when(F.coalesce("o", F.lit("")) != "", F.concat(F.lit("\n[SLIDE]\n"), "o")).otherwise(""))
    return sides.select("video_id", "t0", "t1", fused.alias("fused")).where(tx.strip(F.col("fused")) != "")


NEAREST_SQL = """
fr AS (SELECT DISTINCT video_id, CAST(floor(start_s) AS BIGINT) AS f FROM evs WHERE text <> 'signup'),
c AS (SELECT r.video_id, r.idx, r.start_s, r.duration, f, row_number() OVER (PARTITION BY r.video_id, r.idx ORDER BY abs(f / r.duration::DOUBLE - r.start_s / r.duration::DOUBLE), f) AS rn FROM ref r LEFT JOIN fr USING (video_id)),
nf AS (SELECT video_id, idx, CASE WHEN abs(f / duration::DOUBLE * duration - start_s) <= {gap} THEN f END AS frame FROM c WHERE rn = 1)
"""


def nearest(t, max_gap):
    frames = t.evs.where("text <> 'signup'").select("video_id", F.floor("start_s").alias("x")).distinct()
    return ch.nearest_frame(t.ref.select("video_id", "idx", "start_s", "duration"), frames, max_gap=max_gap).select("video_id", "idx", "frame")


@query("j7_nearest_frame", "ref", f"WITH {NEAREST_SQL.format(gap=3)} SELECT * FROM nf")
def j7(t):
    """Closest frame by position ratio; none when it is further than 3 s. Frames and chapters are distinct seconds."""
    return nearest(t, 3.0)


@query("j7_selected_frames", "ref", f"""WITH RECURSIVE {NEAREST_SQL.format(gap=40)},
ls AS (SELECT video_id, list(DISTINCT frame ORDER BY frame) AS l FROM nf WHERE frame IS NOT NULL GROUP BY 1),
{thin_sql("ls", 6)}
SELECT video_id, unnest(l) AS frame FROM tn WHERE len(l) <= 6""")
def j7_selected(t):
    """The frames that a caption map keeps; at most 6 per video here, 100 by default, so that the rule has work."""
    return ch.selected_frames(nearest(t, 40.0), most=6)


@query("j8_tolerance_anti_join", "ref pred", """
SELECT video_id, start_s FROM ref r WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.video_id = r.video_id AND abs(p.start_s - r.start_s) < 2.0)""")
def j8(t):
    return missing(t).select("video_id", "start_s")


def missing(t, tolerance=2.0):
    near = me.nearest_distance(t.ref, t.pred).where("side = 'r'")
    return near.where(F.col("dist").isNull() | (F.col("dist") >= tolerance)).select("video_id", F.col("x").alias("start_s"))


@query("a10_missing_item_statistics", "ref pred", """
WITH m AS (SELECT video_id, count(*) AS n FROM ref r WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.video_id = r.video_id AND abs(p.start_s - r.start_s) < 2.0) GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, max(n) AS most, min(n) AS least, count(*) AS videos,
  round((SELECT count(*) FROM dur d WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE CAST(c.conv_id AS VARCHAR) = d.video_id)) * 100.0 / (SELECT count(*) FROM dur), 6)::DOUBLE AS absent_pct FROM m""")
def a10(t):
    stats = missing(t).groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"), F.count(F.lit(1)).alias("videos"))
    known = t.seg.select("video_id").distinct().withColumn("known", F.lit(1))
    absent = t.dur.join(known, "video_id", "left").agg(F.round(F.count_if(F.col("known").isNull()) * 100.0 / F.count(F.lit(1)), 6).alias("absent_pct"))
    # two single rows side by side
    both = stats.unionByName(absent, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("j11_subset_membership", "", """
SELECT 'kept' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents SEMI JOIN labels USING (doc_id)
UNION ALL SELECT 'absent', CAST(doc_id AS VARCHAR) FROM documents ANTI JOIN labels USING (doc_id)""")
def j11(t):
    d, l = t.documents.select("doc_id"), t.read("labels").select("doc_id")
    return d.join(l, "doc_id", "left_semi").select(F.lit("kept").alias("kind"), F.col("doc_id").cast("string").alias("id")).unionByName(
        d.join(l, "doc_id", "left_anti").select(F.lit("absent").alias("kind"), F.col("doc_id").cast("string").alias("id")))


@query("j11_coverage_by_source", "", """
SELECT source, count(*) AS ids, count(l.doc_id) AS covered, round(count(l.doc_id) * 100.0::DOUBLE / count(*), 6) AS coverage_pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def j11_coverage(t):
    d = t.documents.select("doc_id", "source").join(t.read("labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("ids"), F.count("hit").alias("covered"),
                                   F.round(F.count("hit") * 100.0 / F.count(F.lit(1)), 6).alias("coverage_pct"))


@query("j12_incremental_batch", "man", """
SELECT team_id, CASE WHEN has_chunks THEN 'skipped' WHEN p.page_id IS NULL THEN 'error' ELSE 'processed' END AS status, count(*) AS n
FROM man LEFT JOIN pages p ON CAST(p.page_id AS VARCHAR) = video_id GROUP BY ALL""")
def j12(t):
    """Work set = manifest rows not yet done; a row whose input is missing counts as an error."""
    inputs = t.read("pages").select(F.col("page_id").cast("string").alias("video_id"), F.lit(1).alias("found"))
    work = t.man.where("NOT has_chunks").join(inputs, "video_id", "left").withColumn("status", F.when(F.col("found").isNull(), "error").otherwise("processed"))
    done = t.man.where("has_chunks").withColumn("status", F.lit("skipped"))
    return work.select("team_id", "status").unionByName(done.select("team_id", "status")).groupBy("team_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("j13_topic_to_chapter", "ref pred", """
WITH tp AS (SELECT video_id, idx, title AS topic, [w FOR w IN string_split(title, ' ') IF length(w) > 1][1:3] AS kws, start_s,
  CASE WHEN idx % 5 = 4 THEN NULL WHEN idx % 2 = 0 THEN start_s || '-' || end_s ELSE CAST(start_s AS VARCHAR) END AS rng FROM pred WHERE idx < 5),
m AS (SELECT tp.video_id, tp.idx, arg_min(r.start_s, r.idx) AS hit FROM tp JOIN ref r ON tp.video_id = r.video_id AND len([k FOR k IN kws IF contains(r.title, k)]) > 0 GROUP BY 1, 2)
SELECT video_id, idx + 1 AS unit_no, topic AS title, coalesce(CAST(hit AS VARCHAR), CASE WHEN contains(rng, '-') THEN trim(string_split(rng, '-')[1]) ELSE rng END, '') AS time FROM tp LEFT JOIN m USING (video_id, idx)""")
def j13(t):
    rng = F.when(F.col("idx") % 5 == 4, F.lit(None).cast("string")).when(F.col("idx") % 2 == 0, F.concat_ws("-", "start_s", "end_s")).otherwise(F.col("start_s").cast("string"))
    topics = t.pred.where("idx < 5").select("video_id", "idx", "title", rng.alias("time_range"))
    chapters = t.ref.select("video_id", "idx", F.col("start_s").cast("string").alias("stamp"), "title")
    return ch.topic_times(topics, chapters).select("video_id", (F.col("idx") + 1).cast("long").alias("unit_no"), "title", "time")


@query("j15_overlap_weighted_mean", "ref pred", """
WITH b AS (SELECT video_id, start_s AS b0, CASE WHEN idx % 3 = 1 THEN start_s ELSE end_s END AS b1, (event_id % 10) / 10.0::DOUBLE AS w, (event_id % 7) / 7.0::DOUBLE AS sim FROM pred)
SELECT video_id, idx, round(coalesce(sum(o * w) / sum(o), 0.5), 6)::DOUBLE AS w_slide, round(coalesce(sum(o * (1 - w)) / sum(o), 0.5), 6)::DOUBLE AS w_speech, round(coalesce(sum(o * sim) / sum(o), 0.0), 6)::DOUBLE AS sim
FROM (SELECT r.video_id, r.idx, w, b.sim, greatest(0, least(end_s, b1) - greatest(start_s, b0)) AS o FROM ref r LEFT JOIN b ON r.video_id = b.video_id AND least(end_s, b1) > greatest(start_s, b0)) GROUP BY ALL""")
def j15(t):
    bins = t.pred.select("video_id", F.col("start_s").alias("b0"), F.when(F.col("idx") % 3 == 1, F.col("start_s")).otherwise(F.col("end_s")).alias("b1"),
                                              ((F.col("event_id") % 10) / 10.0).alias("w"), ((F.col("event_id") % 7) / 7.0).alias("sim"))
    blocks = t.ref.select("video_id", "idx", "start_s", "end_s")
    hit = overlap_join(blocks, bins, ["video_id"], "start_s", "end_s", "b0", "b1", F.least("end_s", "b1") > F.greatest("start_s", "b0"), 600.0)
    o = F.least("end_s", "b1") - F.greatest("start_s", "b0")
    means = hit.groupBy("video_id", "idx").agg((F.sum(o * F.col("w")) / F.sum(o)).alias("a"), (F.sum(o * (1 - F.col("w"))) / F.sum(o)).alias("b"), (F.sum(o * F.col("sim")) / F.sum(o)).alias("c"))
    return blocks.join(means, ["video_id", "idx"], "left").select("video_id", "idx", *[
        F.round(F.coalesce(c, F.lit(d)), 6).alias(n) for c, d, n in (("a", 0.5, "w_slide"), ("b", 0.5, "w_speech"), ("c", 0.0, "sim"))])


MAPS_SQL = """
m AS (SELECT video_id, CAST(floor(start_s) AS BIGINT) AS k, arg_min(text, start_s) AS v, min(event_id) AS e FROM evs GROUP BY 1, 2),
dst AS (SELECT CASE WHEN CAST(video_id AS BIGINT) % 5 = 0 THEN 'd' || video_id ELSE video_id END AS video_id, CASE WHEN k % 2 = 0 THEN k ELSE -k END AS k, v FROM m),
src AS (SELECT CASE WHEN CAST(video_id AS BIGINT) % 4 = 0 THEN 's' || video_id ELSE video_id END AS video_id, CASE WHEN k % 3 = 0 THEN k ELSE k + 1000000 END AS k, CASE WHEN k % 4 = 0 THEN v ELSE v || '!' END AS v FROM m)
"""


def maps(t):
    m = t.evs.groupBy("video_id", F.floor("start_s").alias("k")).agg(F.min_by("text", "start_s").alias("v"))
    vid = F.col("video_id").cast("long")
    named = lambda n, mark: F.when(vid % n == 0, F.concat(F.lit(mark), "video_id")).otherwise(F.col("video_id")).alias("video_id")
    k = F.col("k")
    dst = m.select(named(5, "d"), F.when(k % 2 == 0, k).otherwise(-k).alias("k"), "v")
    src = m.select(named(4, "s"), F.when(k % 3 == 0, k).otherwise(k + 1000000).alias("k"), F.when(k % 4 == 0, F.col("v")).otherwise(F.concat("v", F.lit("!"))).alias("v"))
    return src, dst


@query("j16_map_merge", "evs", f"WITH {MAPS_SQL} SELECT video_id, k, coalesce(s.v, d.v) AS v FROM src s FULL JOIN dst d USING (video_id, k)")
def j16(t):
    """Entries stay rows, so a map of any size merges without being held in one cell; the source side wins."""
    src, dst = maps(t)
    both = dst.join(src.withColumnRenamed("v", "sv"), ["video_id", "k"], "full")
    return both.select("video_id", "k", F.coalesce("sv", "v").alias("v"))


@query("j16_map_merge_classes", "evs", f"""WITH {MAPS_SQL},
c AS (SELECT coalesce(s.video_id, d.video_id) AS video_id, count(s.v) AS ns, count(d.v) AS nd, count(*) FILTER (WHERE s.v = d.v) AS eq FROM src s FULL JOIN dst d ON s.video_id = d.video_id AND s.k = d.k GROUP BY 1)
SELECT CASE WHEN nd = 0 THEN 'copy' WHEN ns = nd AND ns = eq THEN 'same' ELSE 'merge' END AS type, count(*) AS n FROM c WHERE ns > 0 GROUP BY 1""")
def j16_classes(t):
    src, dst = maps(t)
    c = dst.withColumnRenamed("v", "dv").join(src.withColumnRenamed("v", "sv"), ["video_id", "k"], "full").groupBy("video_id").agg(
        F.count("sv").alias("ns"), F.count("dv").alias("nd"), F.count_if(F.col("sv") == F.col("dv")).alias("eq")).where("ns > 0")
    kind = F.when(F.col("nd") == 0, "copy").when((F.col("ns") == F.col("nd")) & (F.col("ns") == F.col("eq")), "same").otherwise("merge")
    return c.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def raw_sides(t):
    return tuple(x.select("video_id", F.col("idx").cast("long").alias("i"), F.col("start_s").cast("double").alias("s"), F.col("end_s").cast("double").alias("e")) for x in (t.ref, t.pred))


IOU_SQL = "greatest(0, least(r.end_s, p.end_s) - greatest(r.start_s, p.start_s)) / (least(greatest(r.end_s, p.end_s) - least(r.start_s, p.start_s), r.end_s - r.start_s + p.end_s - p.start_s) + 1e-8::DOUBLE)"


@query("j18_caption_pairing", "ref pred", f"""
WITH thr AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS t)
SELECT t AS tiou, p.video_id, p.idx AS j, r.idx AS i, p.title AS pred_title, r.title AS ref_title
FROM pred p CROSS JOIN thr LEFT JOIN ref r ON r.video_id = p.video_id AND {IOU_SQL} >= t""")
def j18(t):
    """Every prediction per threshold with each reference that reaches it; without one it stays with a null reference."""
    return ch.caption_pairs(t.ref, t.pred, me.iou_pairs(*raw_sides(t)))


@query("j19_block_titles", "ref seg", """
WITH bnd AS (SELECT DISTINCT video_id, s, e FROM (
   SELECT video_id, start_s + 0.0004::DOUBLE AS s, end_s::DOUBLE AS e FROM ref UNION ALL SELECT video_id, start_s + 0.0004::DOUBLE, end_s::DOUBLE FROM ref WHERE idx % 3 = 0 UNION ALL SELECT video_id, end_s::DOUBLE, start_s::DOUBLE FROM ref) WHERE e > s),
ti AS (SELECT video_id, round(start_s, 3) AS s, round(end_s, 3) AS e, title FROM ref WHERE idx % 4 <> 2)
SELECT b.video_id, b.s AS start_s, b.e AS end_s, coalesce(any_value(ti.title), '') AS title, count(sg.seg_idx) AS segments
FROM bnd b LEFT JOIN ti ON ti.video_id = b.video_id AND round(b.s, 3) = ti.s AND round(b.e, 3) = ti.e
LEFT JOIN seg sg ON sg.video_id = b.video_id AND sg.end_s >= b.s AND sg.start_s <= b.e GROUP BY ALL""")
def j19(t):
    s = (F.col("start_s") + 0.0004).alias("s")
    e = F.col("end_s").cast("double").alias("e")
    bounds = t.ref.select("video_id", s, e).unionByName(t.ref.where("idx % 3 = 0").select("video_id", s, e)).unionByName(
        t.ref.select("video_id", F.col("end_s").cast("double").alias("s"), F.col("start_s").cast("double").alias("e")))
    titles = t.ref.where("idx % 4 <> 2").select("video_id", F.col("start_s").cast("double").alias("s"), F.col("end_s").cast("double").alias("e"), "title")
    return ch.block_titles(bounds, titles, t.seg)


@query("w4_drop_consecutive_repeats", "evs", """
SELECT video_id, event_id, text FROM (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS p FROM evs) WHERE p IS DISTINCT FROM text""")
def w4(t):
    rows = scan(density_blocks(t.evs.select("video_id", "event_id", "start_s", "text"), ["video_id"], "start_s", tie="event_id"), ["video_id"], ["start_s", "event_id"], lag={"prev": "text"})
    return rows.where(~F.col("prev").eqNullSafe(F.col("text"))).select("video_id", "event_id", "text")


W6_LINE = HMS_SQL.format("start_s") + " || ': ' || text"


@query("w6_token_budget_window", "seg", f"""
WITH l AS (SELECT video_id, seg_idx, CASE WHEN seg_idx % 4 = 3 THEN text ELSE {W6_LINE} END AS line FROM seg),
k AS (SELECT *, {TOK_SQL.format('line')} AS tok, regexp_extract(line, '(\\d{{2}}:[0-5]\\d:[0-5]\\d)\\b', 1) AS st FROM l),
v AS (SELECT *, CASE WHEN st <> '' THEN CAST(st[1:2] AS BIGINT) * 3600 + CAST(st[4:5] AS BIGINT) * 60 + CAST(st[7:8] AS BIGINT) END AS sec FROM k),
r AS (SELECT *, sum(CASE WHEN sec >= 20 THEN tok ELSE 0 END) OVER (PARTITION BY video_id ORDER BY seg_idx) AS run, sum(tok) OVER (PARTITION BY video_id) <= 150 AS whole, max(seg_idx) OVER (PARTITION BY video_id) AS last_idx FROM v),
o AS (SELECT *, min(CASE WHEN NOT whole AND sec >= 20 AND run > 150 THEN seg_idx END) OVER (PARTITION BY video_id) AS stop FROM r)
SELECT video_id, seg_idx, CASE WHEN whole THEN line ELSE regexp_replace(line, '\\d{{2}}:[0-5]\\d:[0-5]\\d\\b', printf('%02d:%02d:%02d', (sec - 20) // 3600, (sec - 20) % 3600 // 60, (sec - 20) % 60), 'g') END AS line,
  whole OR stop IS NULL OR stop = last_idx AS reached_end FROM o WHERE whole OR (sec >= 20 AND run <= 150)""")
def w6(t):
    lines = t.seg.select("video_id", "seg_idx", F.when(F.col("seg_idx") % 4 == 3, F.col("text")).otherwise(F.concat(tf.sec_to_hms(F.col("start_s")), F.lit(": "), "text")).alias("line"))
    clock = r"(\d{2}:[0-5]\d:[0-5]\d)\b"
    found = F.regexp_extract("line", clock, 1)
    stamp = F.when(found != "", tf.hms_to_sec(found, "null"))
    rows = wi.budget_window(lines, tx.chunk_tokens(F.col("line")), stamp, start=20, budget=150)
    shifted = F.regexp_replace(F.col("line"), F.lit(clock), tf.sec_to_hms(F.col("stamp_s") - 20))
    return rows.select("video_id", "seg_idx", F.when(F.col("whole"), F.col("line")).otherwise(shifted).alias("line"), "reached_end")


@query("w9_every_nth_micro_windows", "seg", """
SELECT video_id, seg_idx, greatest(0, start_s - 5) AS w_start, start_s + 15 AS w_end, greatest(0, start_s) AS after_start FROM
(SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS rn FROM seg) WHERE (rn - 1) % 10 = 0""")
def w9(t):
    return wi.every_nth(t.seg, 10).select("video_id", "seg_idx", F.greatest(F.lit(0.0), F.col("start_s") - 5).alias("w_start"), (F.col("start_s") + 15).alias("w_end"),
                                          F.greatest(F.lit(0.0), F.col("start_s")).alias("after_start"))


@query("w10_even_anchors", "evs", f"""
WITH st AS (SELECT DISTINCT video_id, CAST(floor(start_s) AS BIGINT) AS sec FROM evs),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sec) - 1 AS r, count(*) OVER (PARTITION BY video_id) AS n FROM st),
w AS (SELECT DISTINCT video_id, CAST(round_even(i * (n - 1) / 11.0::DOUBLE, 0) AS BIGINT) AS r FROM n, range(12) AS q(i))
SELECT n.video_id, {HMS_SQL.format('sec')} AS stamp FROM n LEFT JOIN w USING (video_id, r) WHERE n <= 12 OR w.r IS NOT NULL""")
def w10(t):
    stamps = t.evs.select("video_id", F.floor("start_s").alias("stamp_s")).distinct()
    return wi.anchors(stamps, 12).select("video_id", tf.sec_to_hms(F.col("stamp_s")).alias("stamp"))


@query("w11_difficulty_quota", "", """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, CASE WHEN r < round_even(0.3::DOUBLE * n, 0) THEN 'easy' WHEN r < round_even(0.3::DOUBLE * n, 0) + round_even(0.4::DOUBLE * n, 0) THEN 'medium' ELSE 'hard' END AS difficulty FROM r""")
def w11(t):
    docs = t.documents.select("source", "doc_id", "n_chars")
    ranked = scan(density_blocks(docs, ["source"], "n_chars", tie="doc_id"), ["source"], ["n_chars", "doc_id"], number="r").drop(BLOCK)
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    easy, medium = (F.bround(F.lit(q) * F.col("n")) for q in (0.3, 0.4))
    pos = F.col("r") - 1
    return ranked.join(n, "source").select("source", "doc_id", F.when(pos < easy, "easy").when(pos < easy + medium, "medium").otherwise("hard").alias("difficulty"))


@query("w12_boundary_midpoints", "ref", """
WITH b AS (SELECT video_id, CASE WHEN idx = 0 THEN 0 ELSE start_s END AS x FROM ref UNION SELECT video_id, duration FROM ref),
m AS (SELECT video_id, (x + lead(x) OVER (PARTITION BY video_id ORDER BY x)) / 2.0::DOUBLE AS mid FROM b) SELECT video_id, mid FROM m WHERE mid IS NOT NULL""")
def w12(t):
    """First boundary moved to 0 and the duration added, as the boundaries of captions are taken."""
    b = t.ref.select("video_id", F.when(F.col("idx") == 0, 0).otherwise(F.col("start_s")).alias("x")).unionByName(
        t.ref.select("video_id", F.col("duration").cast("long").alias("x"))).distinct()
    nxt = F.lead("x").over(Window.partitionBy("video_id").orderBy("x"))
    return b.select("video_id", ((F.col("x") + nxt) / 2).alias("mid")).where("mid IS NOT NULL")


@query("w13_strictly_increasing_starts", "ref", """
WITH b AS (SELECT video_id, idx, start_s::DOUBLE AS s, end_s + (idx % 3 - 1) * 5.0::DOUBLE AS e FROM ref),
l AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY idx) AS pe FROM b)
SELECT video_id, idx + 1 AS index, CASE WHEN s <= pe THEN round(pe + 0.001::DOUBLE, 3) ELSE s END AS start_s, e AS end_s FROM l""")
def w13(t):
    b = t.ref.select("video_id", "idx", F.col("start_s").cast("double").alias("s"), (F.col("end_s") + (F.col("idx") % 3 - 1) * 5.0).alias("e"))
    prev = F.lag("e").over(Window.partitionBy("video_id").orderBy("idx"))
    return b.select("video_id", (F.col("idx") + 1).cast("long").alias("index"), F.when(F.col("s") <= prev, F.round(prev + 0.001, 3)).otherwise(F.col("s")).alias("start_s"), F.col("e").alias("end_s"))


@query("w15_first_last_stamps", "seg dur", f"""
WITH s AS (SELECT video_id, min({HMS_SQL.format('start_s')}) AS f, max({HMS_SQL.format('start_s')}) AS l, count(DISTINCT {HMS_SQL.format('start_s')}) AS n FROM seg WHERE seg_idx % 5 <> 4 GROUP BY 1)
SELECT video_id, coalesce(f, '00:00:00') AS first_ts, coalesce(l, {HMS_SQL.format('duration')}) AS last_ts, coalesce(n, 0) AS stamps FROM dur LEFT JOIN s USING (video_id)""")
def w15(t):
    """Stamps at the head of transcript lines, distinct; defaults 0 and the duration."""
    line = F.concat(F.when(F.col("seg_idx") % 5 == 4, "no stamp ").otherwise(F.concat(F.lit(" ["), tf.sec_to_hms(F.col("start_s")), F.lit("] "))), "text")
    found = F.regexp_extract(line, r"^\s*\[?(\d{1,2}:\d{2}:\d{2})\]?\s*(?:[:\-–—]\s*|\s+)", 1)
    stamps = t.seg.select("video_id", tf.normalize_stamp(found).alias("st")).where("st <> ''").distinct().groupBy("video_id").agg(
        F.min("st").alias("f"), F.max("st").alias("l"), F.count(F.lit(1)).alias("n"))
    return t.dur.join(stamps, "video_id", "left").select("video_id", F.coalesce("f", F.lit("00:00:00")).alias("first_ts"), F.coalesce("l", tf.sec_to_hms(F.col("duration"))).alias("last_ts"),
                                                         F.coalesce("n", F.lit(0)).alias("stamps"))


UNION_SQL = """
{p}c AS (SELECT video_id, event_id, greatest(0, least(start_s, duration)) AS s, greatest(0, least(end_s, duration)) AS e FROM {src} JOIN dur USING (video_id)),
{p}k AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {p}c WHERE e > s),
{p}g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 0.05::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e, event_id) AS g FROM {p}k),
{p}u AS (SELECT video_id, g, min(s) AS s, max(e) AS e FROM {p}g GROUP BY 1, 2)
"""


@query("a1_interval_union", "dur", f"WITH {UNION_SQL.format(p='a', src='evs')} SELECT video_id, round(s, 6) AS start_s, round(e, 6) AS end_s FROM au")
def a1(t):
    rows = t.evs.join(t.dur, "video_id")
    return wi.interval_union(rows, F.col("duration").cast("double")).select("video_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("a2_speech_coverage", "dur", f"""
WITH kept AS (SELECT video_id, event_id, start_s, end_s FROM (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS p FROM evs WHERE end_s > start_s) WHERE p IS DISTINCT FROM text),
{UNION_SQL.format(p='a', src='evs')}, {UNION_SQL.format(p='k', src='kept')},
m AS (SELECT d.video_id, duration::DOUBLE AS dur, coalesce((SELECT sum(e - s) FROM au WHERE au.video_id = d.video_id), 0) AS ua, coalesce((SELECT sum(e - s) FROM ku WHERE ku.video_id = d.video_id), 0) AS uk,
   (SELECT sum(end_s - start_s) FROM evs WHERE evs.video_id = d.video_id) AS sa, (SELECT sum(end_s - start_s) FROM kept WHERE kept.video_id = d.video_id) AS sk,
   CASE WHEN CAST(d.video_id AS BIGINT) % 3 = 0 THEN 60.5::DOUBLE END AS removed FROM dur d),
c AS (SELECT *, CASE WHEN removed IS NOT NULL THEN greatest(0, dur - removed) WHEN uk > 0 THEN uk ELSE ua END AS sp, CASE WHEN removed IS NOT NULL THEN removed WHEN uk > 0 THEN greatest(0, dur - uk) ELSE greatest(0, dur - ua) END AS rm FROM m)
SELECT video_id, round(sp, 4) AS speech, round(rm, 4) AS removed, round(sp / dur, 6) AS speech_ratio, CASE WHEN removed IS NOT NULL THEN 'logger' WHEN uk > 0 THEN 'kept' ELSE 'raw' END AS source,
  round(ua, 4) AS union_raw, round(uk, 4) AS union_kept, round(sa, 4) AS sum_raw, round(sk, 4) AS sum_kept FROM c""")
def a2(t):
    rows = t.evs.where("end_s > start_s").select("video_id", "event_id", "start_s", "end_s", "text")
    kept = scan(density_blocks(rows, ["video_id"], "start_s", tie="event_id"), ["video_id"], ["start_s", "event_id"], lag={"prev": "text"}).drop(BLOCK).where(
        (F.length(tx.strip(F.col("text"))) >= 4) & ~F.col("prev").eqNullSafe(F.col("text")))
    d = F.col("duration").cast("double")

    def covered(x, name):
        u = wi.interval_union(x.join(t.dur, "video_id"), d).groupBy("video_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias(f"u{name}"))
        s = x.groupBy("video_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias(f"s{name}"))
        return s.join(u, "video_id", "left")

    removed = F.when(F.col("video_id").cast("long") % 3 == 0, F.lit(60.5))
    m = t.dur.withColumn("ext", removed).join(covered(rows, "a"), "video_id", "left").join(covered(kept, "k"), "video_id", "left")
    ua, uk = F.coalesce("ua", F.lit(0.0)), F.coalesce("uk", F.lit(0.0))
    speech = F.when(F.col("ext").isNotNull(), F.greatest(F.lit(0.0), d - F.col("ext"))).when(uk > 0, uk).otherwise(ua)
    gone = F.when(F.col("ext").isNotNull(), F.col("ext")).otherwise(F.greatest(F.lit(0.0), d - F.when(uk > 0, uk).otherwise(ua)))
    return m.select("video_id", F.round(speech, 4).alias("speech"), F.round(gone, 4).alias("removed"), F.round(speech / d, 6).alias("speech_ratio"),
                    F.when(F.col("ext").isNotNull(), "logger").when(uk > 0, "kept").otherwise("raw").alias("source"), F.round(ua, 4).alias("union_raw"), F.round(uk, 4).alias("union_kept"),
                    F.round("sa", 4).alias("sum_raw"), F.round("sk", 4).alias("sum_kept"))


@query("a9_corpus_rates", "seg pred dur", f"""
WITH k AS (SELECT video_id, CAST(sum({TOK_SQL.format('text')}) AS DOUBLE) AS tok, max(end_s) AS d FROM seg GROUP BY 1), c AS (SELECT video_id, count(*) AS n, min(duration) AS d FROM pred GROUP BY 1)
SELECT round_even((SELECT avg(tok / d * 60) FROM k), 2) AS tokens_per_min, round((SELECT avg(n) FROM c), 6) AS captions_per_video, round((SELECT avg(n / d * 60) FROM c), 6) AS captions_per_min""")
def a9(t):
    k = t.seg.groupBy("video_id").agg(F.sum(tx.chunk_tokens(F.col("text"))).alias("tok"), F.max("end_s").alias("d"))
    c = t.pred.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("duration").alias("d"))
    rates = c.agg(F.round(F.avg("n"), 6).alias("captions_per_video"), F.round(F.avg(F.col("n") / F.col("d") * 60), 6).alias("captions_per_min"))
    both = k.agg(F.bround(F.avg(F.col("tok") / F.col("d") * 60), 2).alias("tokens_per_min")).unionByName(rates, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("a20_nonempty_rates", "lin", r"""
SELECT video_id, count(*) AS rows_total, count(*) FILTER (WHERE regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> '') AS rows_filled,
  round(count(*) FILTER (WHERE regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> '') / greatest(1, count(*)), 6) AS filled_rate, CAST(sum(length(text)) AS BIGINT) AS chars FROM lin GROUP BY 1""")
def a20(t):
    filled = F.count_if(tx.strip(F.col("text")) != "")
    return t.lin.groupBy("video_id").agg(F.count(F.lit(1)).alias("rows_total"), filled.alias("rows_filled"), F.round(filled / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("filled_rate"), F.sum(F.length("text")).alias("chars"))


@query("p13_share_trim_range", "evs", """
WITH e AS (SELECT *, CASE WHEN CAST(video_id AS BIGINT) % 3 = 0 THEN text WHEN text = 'click' THEN 'Sharing  Started' WHEN text = 'error' THEN 'screen: stop sharing' ELSE text END AS title, row_number() OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS r FROM evs),
a AS (SELECT video_id, arg_max(start_s, r) FILTER (WHERE regexp_matches(lower(title), 'sharing\\s*started|start\\s*sharing|開始共享|開始分享')) AS s, arg_max(end_s, r) FILTER (WHERE regexp_matches(lower(title), 'sharing\\s*stopp?ed|stop\\s*sharing|停止共享|停止分享')) AS x,
  arg_min(start_s, r) AS fs, arg_max(end_s, r) AS le FROM e GROUP BY 1),
b AS (SELECT video_id, CASE WHEN coalesce(s, 0) = 0 AND x IS NULL THEN greatest(0, fs) ELSE coalesce(s, 0) END AS s, CASE WHEN coalesce(s, 0) = 0 AND x IS NULL THEN greatest(greatest(0, fs), le) ELSE x END AS x FROM a)
SELECT video_id, round(CASE WHEN s <> 0 OR x IS NOT NULL THEN greatest(0, s - 2) ELSE s END, 6) AS trim_start, round(CASE WHEN x IS NOT NULL THEN greatest(greatest(0, s - 2), x + 2) END, 6) AS trim_end FROM b""".replace("\\\\", "\\"))
def p13(t):
    title = F.when(F.col("video_id").cast("long") % 3 == 0, F.col("text")).when(F.col("text") == "click", "Sharing  Started").when(F.col("text") == "error", "screen: stop sharing").otherwise(F.col("text"))
    events = t.evs.withColumn("title", title)
    return ch.trim_range(events).select("video_id", F.round("trim_start", 6).alias("trim_start"), F.round("trim_end", 6).alias("trim_end"))


@query("u3_schedule_union", "ref", """
WITH s AS (SELECT video_id, duration, i * (duration / 11.0::DOUBLE) AS x FROM dur, range(1, 11) AS r(i)
UNION SELECT video_id, duration, (duration - duration // 600 * 600) / 2.0::DOUBLE + i * 600.0::DOUBLE FROM dur, range(200) AS r(i) WHERE duration >= 600 AND i <= duration // 600
UNION SELECT video_id, duration, start_s::DOUBLE FROM ref) SELECT video_id, round(x, 6) AS at_s FROM s WHERE x < duration""")
def u3(t):
    d = F.col("duration").cast("double")
    points = t.dur.select("video_id", "duration", F.explode(F.concat(ch.equal_points(d, 10), ch.interval_points(d, 600.0))).alias("x")).unionByName(
        t.ref.select("video_id", "duration", F.col("start_s").cast("double").alias("x"))).distinct()
    return points.where("x < duration").select("video_id", F.round("x", 6).alias("at_s"))


@query("u4_id_set_operations", "", """
SELECT 'todo' AS kind, doc_id AS id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def u4(t):
    d, l = t.documents.select("doc_id"), t.read("labels").select("doc_id")
    return d.subtract(l).select(F.lit("todo").alias("kind"), F.col("doc_id").alias("id")).unionByName(d.intersect(l).select(F.lit("both").alias("kind"), F.col("doc_id").alias("id")))


@query("f10_gap_sessions", "evs", """
WITH g AS (SELECT *, start_s - lag(start_s) OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS gap FROM evs),
s AS (SELECT video_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY gap DESC, start_s DESC, event_id DESC) AS rk FROM g WHERE gap > 90) WHERE rk <= 11),
n AS (SELECT g.video_id, g.start_s, sum(CASE WHEN s.event_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY g.video_id ORDER BY g.start_s, g.event_id) AS session FROM g LEFT JOIN s USING (video_id, event_id))
SELECT video_id, CAST(session AS BIGINT) AS session, round(min(start_s), 6) AS start_s, round(max(start_s), 6) AS end_s, count(*) AS n FROM n GROUP BY 1, 2""")
def f10(t):
    rows = wi.sessions(t.evs.select("video_id", "event_id", "start_s"), 90.0, cap=12)
    return rows.groupBy("video_id", "session").agg(F.round(F.min("start_s"), 6).alias("start_s"), F.round(F.max("start_s"), 6).alias("end_s"), F.count(F.lit(1)).alias("n"))


@query("f25_slides_to_topics", "ref evs", """
WITH g AS (SELECT *, start_s - lag(start_s) OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS gap FROM evs),
n AS (SELECT *, sum(CASE WHEN gap > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS session FROM g),
b AS (SELECT video_id, session, min(start_s) AS s, max(start_s) AS e FROM n GROUP BY 1, 2)
SELECT r.video_id, r.title, round(s, 2) AS start_s, round(e, 2) AS end_s, r.idx + 1 AS order_hint FROM ref r JOIN b ON r.video_id = b.video_id AND r.idx = b.session""")
def f25(t):
    blocks = wi.sessions(t.evs.select("video_id", "event_id", "start_s"), 90.0).groupBy("video_id", "session").agg(F.min("start_s").alias("s"), F.max("start_s").alias("e"))
    return t.ref.select("video_id", "title", "idx").join(blocks, (blocks.session == F.col("idx")) & (blocks.video_id == t.ref.video_id)).select(
        t.ref.video_id, "title", F.round("s", 2).alias("start_s"), F.round("e", 2).alias("end_s"), (F.col("idx") + 1).cast("long").alias("order_hint"))


@query("t3_top_k_per_window", "evs", """
SELECT video_id, w AS window_no, event_id, value FROM (SELECT *, CAST(floor(start_s / 600) AS BIGINT) AS w, row_number() OVER (PARTITION BY video_id, floor(start_s / 600) ORDER BY value DESC, event_id) AS rn FROM evs) WHERE rn <= 6""")
def t3(t):
    rows = t.evs.select("video_id", F.floor(F.col("start_s") / 600).alias("window_no"), "event_id", "value")
    return wi.top_rows(rows, ["video_id", "window_no"], [F.desc("value"), F.asc("event_id")], 6)
