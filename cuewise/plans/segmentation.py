"""Operators that carry state along a video: merges, packing, chunking, chapter balance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions import timefmt as tf
from cuewise.operators import boundedfolds as bf
from cuewise.operators import chapters as ch
from cuewise.operators import folds as fo
from cuewise.operators import similarity as si
from cuewise.operators import textrows as tr
from cuewise.operators import windows as wi
from cuewise.operators.barrier import once
from cuewise.operators.keywords import top_lists
from cuewise.operators.ordered import BLOCK, density_blocks, fixed_blocks, scan
from cuewise.operators.thinning import thin_gaps
from cuewise.plans.registry import query
from cuewise.plans.texts import MADE_TITLE_SQL, TOKS, words_sql, word_boxes
from cuewise.plans.timebase import TOK_SQL, TRIM_SQL, thin_sql
from cuewise.session import checkpointed

STRIP = TRIM_SQL.format
EVENTS_SQL = "o AS (SELECT *, text || CASE event_id % 3 WHEN 0 THEN '.' WHEN 1 THEN '' ELSE '' END AS tx, row_number() OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS rn FROM evs)"


def events(t):
    rows = t.evs.withColumn("tx", F.concat("text", F.when(F.col("event_id") % 3 == 0, ".").otherwise("")))
    return density_blocks(rows.select("video_id", "event_id", "start_s", "end_s", "tx"), ["video_id"], "start_s", tie="event_id")


def run_summary(labels, *more):
    """One row per run. A run's end is the end of its last row."""
    return labels.groupBy("video_id", "run").agg(
        F.round(F.min("start_s"), 2).alias("start_s"), F.round(F.max_by("end_s", F.struct("start_s", "event_id")), 2).alias("end_s"), F.count(F.lit(1)).alias("n"), *more)


def run_sql(anchor, opens, state, extra=""):
    """Recursive check of a run rule over EVS: state columns `a` (number) and `m` (flag)."""
    return f"""WITH RECURSIVE {EVENTS_SQL},
f AS (SELECT video_id, rn, event_id, event_id AS run, {anchor} FROM o WHERE rn = 1
 UNION ALL SELECT o.video_id, o.rn, o.event_id, CASE WHEN {opens} THEN o.event_id ELSE f.run END, {state} FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1)
SELECT f.video_id, f.run, round(min(o.start_s), 2) AS start_s, round(arg_max(o.end_s, o.rn), 2) AS end_s, count(*) AS n{extra} FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn GROUP BY 1, 2"""


F1_OPENS = "(f.a IS NULL OR o.start_s - f.e > 1.2::DOUBLE OR o.end_s - f.a > 90)"


@query("f1_smart_merge", "evs", run_sql("start_s AS a, end_s AS e", F1_OPENS,
    f"CASE WHEN {F1_OPENS} THEN o.start_s WHEN o.end_s - f.a >= 45 AND right(o.tx, 1) = '.' THEN NULL ELSE f.a END, o.end_s", ", md5(string_agg(o.tx, ' ' ORDER BY o.rn)) AS text_md5"))
def f1(t):
    rows = events(t).withColumn("mark", tx.ends_sentence(F.col("tx"))).withColumn("blank", tx.strip(F.col("tx")) == "")
    labels = fo.runs(rows, ["video_id"], ["start_s", "event_id"], "event_id", ["start_s", "end_s", "mark", "blank"], fo.smart_merge(), keep=["start_s", "end_s", "tx"])
    return run_summary(labels, F.md5(wi.joined_text(["start_s", "event_id"], "tx", " ")).alias("text_md5"))


@query("f1_smart_merge_clean_text")
def f1_clean(t):
    """Merged speech with repeated phrases and tokens reduced; back-references have no form in the check engine."""
    rows = fixed_blocks(t.seg.withColumn("mark", tx.ends_sentence(F.col("text"))).withColumn("blank", tx.strip(F.col("text")) == ""), "seg_idx")
    labels = fo.runs(rows, ["video_id"], ["start_s", "seg_idx"], "seg_idx", ["start_s", "end_s", "mark", "blank"], fo.smart_merge(), keep=["start_s", "text"])
    merged = labels.groupBy("video_id", "run").agg(wi.joined_text(["start_s", "seg_idx"], "text", " ").alias("text")).withColumn("key", F.concat_ws("/", "video_id", "run"))
    return tr.limit_tokens(merged.withColumn("text", tx.collapse_phrases(F.col("text"))), "key", "text")


F2_OPENS = "o.end_s - f.a > 300"


@query("f2_fixed_span_packing", "evs", run_sql("start_s AS a", F2_OPENS, f"CASE WHEN {F2_OPENS} THEN o.start_s ELSE f.a END"))
def f2(t):
    return run_summary(fo.runs(events(t), ["video_id"], ["start_s", "event_id"], "event_id", ["start_s", "end_s"], fo.packing(300.0), keep=["start_s", "end_s"]))


@query("f3_fixed_blocks", "evs", run_sql("CASE WHEN end_s - start_s >= 600 THEN NULL ELSE start_s END AS a", "f.a IS NULL", "CASE WHEN o.end_s - coalesce(f.a, o.start_s) >= 600 THEN NULL ELSE coalesce(f.a, o.start_s) END"))
def f3(t):
    return run_summary(fo.runs(events(t), ["video_id"], ["start_s", "event_id"], "event_id", ["start_s", "end_s"], fo.fixed_blocks_rule(600.0), keep=["start_s", "end_s"]))


@query("f4_anchored_groups", "evs", run_sql("start_s AS a", "o.start_s - f.a >= 600", "CASE WHEN o.start_s - f.a >= 600 THEN o.start_s ELSE f.a END"))
def f4(t):
    return run_summary(fo.runs(events(t), ["video_id"], ["start_s", "event_id"], "event_id", ["start_s"], fo.anchored(600.0), keep=["start_s", "end_s"]))


@query("f4_forced_chapters", "evs", run_sql("start_s AS a", "o.end_s - f.a >= 600", "CASE WHEN o.end_s - f.a >= 600 THEN o.start_s ELSE f.a END"))
def f4_forced(t):
    return run_summary(fo.runs(events(t), ["video_id"], ["start_s", "event_id"], "event_id", ["start_s", "end_s"], fo.forced(600.0), keep=["start_s", "end_s"]))


CHUNK_SQL = rf"""
hit AS (SELECT l.video_id, r.idx AS chapter_idx, r.title, l.line_no, l.start_s, l.start_s + 15 AS end_s, l.text FROM lin l JOIN ref r ON l.video_id = r.video_id AND l.start_s >= r.start_s - 1 AND l.start_s < r.end_s),
whole AS (SELECT video_id, chapter_idx, coalesce({TOK_SQL.format("string_agg(text, ' ' ORDER BY line_no) FILTER (WHERE text <> '')")}, 0) AS tok FROM hit GROUP BY 1, 2),
nb AS (SELECT h.video_id, h.chapter_idx, h.line_no, {STRIP('text')} AS t, {TOK_SQL.format(STRIP('text'))} AS k, row_number() OVER (PARTITION BY h.video_id, h.chapter_idx ORDER BY line_no) AS rn FROM hit h JOIN whole w USING (video_id, chapter_idx) WHERE w.tok > 120 AND {STRIP('text')} <> ''),
f AS (SELECT video_id, chapter_idx, rn, 0 AS chunk, k AS total, [{{'l': line_no, 'k': k}}] AS cur, []::BIGINT[] AS carried FROM nb WHERE rn = 1
 UNION ALL SELECT video_id, chapter_idx, rn, CASE WHEN flush THEN chunk + 1 ELSE chunk END, CASE WHEN flush THEN coalesce(list_sum([x.k FOR x IN kept]), 0) + k ELSE total + k END, CASE WHEN flush THEN list_append(kept, {{'l': line_no, 'k': k}}) ELSE list_append(cur, {{'l': line_no, 'k': k}}) END, CASE WHEN flush THEN [x.l FOR x IN kept] ELSE []::BIGINT[] END
 FROM (SELECT n.video_id, n.chapter_idx, n.rn, f.chunk, f.total, f.cur, n.k, n.line_no, f.total + n.k > 120 AS flush, [x FOR x, i IN f.cur IF list_sum([y.k FOR y IN f.cur[i:]]) <= 30] AS kept FROM f JOIN nb n ON n.video_id = f.video_id AND n.chapter_idx = f.chapter_idx AND n.rn = f.rn + 1)),
mem AS (SELECT video_id, chapter_idx, chunk, line_no FROM f JOIN nb USING (video_id, chapter_idx, rn) UNION ALL SELECT video_id, chapter_idx, chunk, unnest(carried) FROM f),
sub AS (SELECT m.video_id, m.chapter_idx, m.chunk, string_agg(n.t, ' ' ORDER BY m.line_no) AS text FROM mem m JOIN nb n ON n.video_id = m.video_id AND n.chapter_idx = m.chapter_idx AND n.line_no = m.line_no GROUP BY 1, 2, 3),
trig AS (SELECT f.video_id, f.chapter_idx, f.chunk, min(h.start_s) AS s FROM f JOIN nb n USING (video_id, chapter_idx, rn) JOIN hit h ON h.video_id = n.video_id AND h.chapter_idx = n.chapter_idx AND h.line_no = n.line_no GROUP BY 1, 2, 3),
edge AS (SELECT video_id, chapter_idx, min(start_s) AS s, arg_max(end_s, line_no) AS e FROM hit GROUP BY 1, 2),
chunks AS (SELECT s.video_id, s.chapter_idx, s.chunk, CASE WHEN s.chunk = 0 THEN e.s ELSE t.s END AS start_s, coalesce(lead(t.s) OVER (PARTITION BY s.video_id, s.chapter_idx ORDER BY s.chunk), e.e) AS end_s, text FROM sub s JOIN trig t USING (video_id, chapter_idx, chunk) JOIN edge e USING (video_id, chapter_idx)
 UNION ALL SELECT h.video_id, h.chapter_idx, 0, min(start_s), arg_max(end_s, line_no), coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (WHERE text <> ''), '') FROM hit h JOIN whole w USING (video_id, chapter_idx) WHERE w.tok <= 120 GROUP BY 1, 2)
"""


def line_chunks(t):
    """LIN as segments of 15 s in the chapters of REF, chunked at 120 tokens with 30 carried."""
    segs = t.lin.select("video_id", F.col("line_no").cast("long").alias("line_no"), "start_s", (F.col("start_s") + 15).alias("end_s"), "text")
    return si.chunk_chapters(ch.contain(segs, t.ref), most=120, carry=30)


@query("f5_token_bounded_chunks", "lin ref", "WITH RECURSIVE " + CHUNK_SQL + f" SELECT video_id, chapter_idx, chunk AS chunk_index, 'ch' || chapter_idx || '_' || chunk AS chunk_id, start_s, end_s, {TOK_SQL.format('text')} AS token_estimate, md5(text) AS text_md5 FROM chunks")
def f5(t):
    return line_chunks(t).select("video_id", F.col("chapter_idx").cast("long").alias("chapter_idx"), "chunk_index", "chunk_id", "start_s", "end_s", "token_estimate", F.md5("text").alias("text_md5"))


@query("a24_chunk_summary", "lin ref", "WITH RECURSIVE " + CHUNK_SQL + f" SELECT video_id, count(*) AS chunks, CAST(sum({TOK_SQL.format('text')}) AS BIGINT) // count(*) AS avg_tokens_per_chunk FROM chunks GROUP BY 1")
def a24(t):
    return line_chunks(t).groupBy("video_id").agg(F.count(F.lit(1)).alias("chunks"), F.floor(F.sum("token_estimate") / F.count(F.lit(1))).alias("avg_tokens_per_chunk"))


@query("f6_gap_line_joining", "seg", f"""
WITH k AS (SELECT * REPLACE (start_s + (seg_idx // 4) * 40 AS start_s) FROM seg), g AS (SELECT *, start_s - lag(start_s) OVER (PARTITION BY video_id ORDER BY seg_idx) AS gap FROM k),
i AS (SELECT *, sum(CASE WHEN gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY seg_idx) AS g FROM g),
c AS (SELECT video_id, g, CAST(min(start_s) AS BIGINT) AS s, CAST(max(start_s) AS BIGINT) AS e FROM i GROUP BY 1, 2),
r AS (SELECT *, e - s >= 60 AS long, g = max(g) OVER (PARTITION BY video_id) AS last, count(*) FILTER (WHERE e - s >= 60) OVER (PARTITION BY video_id) AS n FROM c)
SELECT i.video_id, CAST(i.g AS BIGINT) AS grp, seg_idx, printf('[%02d:%02d:%02d-%02d:%02d:%02d]', s // 3600, s % 3600 // 60, s % 60, e // 3600, e % 3600 // 60, e % 60) AS head, {STRIP('text')} AS text
FROM i JOIN r ON r.video_id = i.video_id AND r.g = i.g WHERE long OR (last AND n = 0)""")
def f6(t):
    """The documented rule; the stamp parsing of the original never matches a line, so only its fallback ran."""
    return si.gap_lines(t.seg.withColumn("start_s", F.col("start_s") + F.floor(F.col("seg_idx") / 4) * 40), max_gap=30.0, shortest=60.0)


BAL_SQL = """
tg AS (SELECT video_id, start_s AS s, CASE idx % 5 WHEN 0 THEN '[m1] ' || title WHEN 1 THEN '[m1] ' || title || ' longer title' WHEN 2 THEN title || ' and quite a bit more text' ELSE title END AS title, duration AS d,
  CASE WHEN duration < 1800 THEN {g[0]} WHEN duration < 3600 THEN {g[1]} WHEN duration < 7200 THEN {g[2]} WHEN duration < 10800 THEN {g[3]} ELSE {g[4]} END AS mg,
  CASE WHEN duration < 1800 THEN {lo[0]} WHEN duration < 3600 THEN {lo[1]} WHEN duration < 7200 THEN {lo[2]} WHEN duration < 10800 THEN {lo[3]} ELSE {lo[4]} END AS lo,
  CASE WHEN duration < 1800 THEN {hi[0]} WHEN duration < 3600 THEN {hi[1]} WHEN duration < 7200 THEN {hi[2]} WHEN duration < 10800 THEN {hi[3]} ELSE {hi[4]} END AS hi, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS rn FROM ref),
"""
CUR_BAL = BAL_SQL.format(g=[120, 180, 240, 300, 360], lo=[5, 6, 8, 10, 12], hi=[10, 12, 16, 20, 24])
OLD_BAL = BAL_SQL.format(g=[90, 180, 300, 540, 600], lo=[6, 8, 10, 12, 14], hi=[12, 16, 20, 24, 28])
TAG = r"regexp_extract({0}, '^\[([^\]]+)\]', 1)"


def tagged(t):
    k = F.col("idx") % 5
    title = (F.when(k == 0, F.concat(F.lit("[m1] "), "title")).when(k == 1, F.concat(F.lit("[m1] "), "title", F.lit(" longer title"))).when(k == 2, F.concat("title", F.lit(" and quite a bit more text"))).otherwise(F.col("title")))
    return t.ref.withColumn("title", title)


@query("f7_chapter_balance", "ref", "WITH RECURSIVE " + CUR_BAL + rf"""
f AS (SELECT video_id, rn, s AS ks, title AS kt, true AS opens FROM tg WHERE rn = 1 UNION ALL
 SELECT video_id, rn, CASE WHEN m THEN ks ELSE s END, CASE WHEN NOT m THEN title WHEN nt <> '' AND ot = '' THEN title WHEN length(title) > length(kt) * 1.3::DOUBLE THEN title ELSE kt END, NOT m FROM
 (SELECT *, CASE WHEN s - ks < greatest(120, mg // 2) THEN true WHEN ot <> '' AND nt <> '' AND ot = nt THEN s - ks < mg * 0.7::DOUBLE ELSE s - ks < mg // 2 END AS m FROM
  (SELECT tg.*, f.ks, f.kt, {TAG.format('f.kt')} AS ot, {TAG.format('tg.title')} AS nt FROM f JOIN tg ON tg.video_id = f.video_id AND tg.rn = f.rn + 1))),
k AS (SELECT f.video_id, ks AS s, arg_max(kt, f.rn) AS title, min(d) AS d, min(lo) AS lo, min(hi) AS hi FROM f JOIN tg USING (video_id, rn) GROUP BY 1, 2),
n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM k),
b AS (SELECT *, least(s // greatest(1, d // hi), hi - 1) AS b FROM n WHERE n > hi),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, b ORDER BY abs(s - (b * greatest(1, d // hi) + CASE WHEN b < hi - 1 THEN (b + 1) * greatest(1, d // hi) ELSE d + 1 END) // 2), s) AS q FROM b)
SELECT video_id, s AS start_s, title FROM n WHERE n <= hi UNION ALL SELECT video_id, s, title FROM r WHERE q = 1""")
def f7(t):
    return bf.balance(tagged(t))


@query("f7_chapter_balance_legacy", "ref", "WITH RECURSIVE " + OLD_BAL + """
f AS (SELECT video_id, rn, s AS ks, title AS kt, 1 AS grp FROM tg WHERE rn = 1 UNION ALL
 SELECT tg.video_id, tg.rn, CASE WHEN tg.s - ks >= mg OR length(title) > length(kt) THEN tg.s ELSE ks END, CASE WHEN tg.s - ks >= mg OR length(title) > length(kt) THEN title ELSE kt END, CASE WHEN tg.s - ks >= mg THEN grp + 1 ELSE grp END FROM f JOIN tg ON tg.video_id = f.video_id AND tg.rn = f.rn + 1),
k AS (SELECT f.video_id, grp, arg_max(ks, f.rn) AS s, arg_max(kt, f.rn) AS title, min(d) AS d, min(hi) AS hi FROM f JOIN tg USING (video_id, rn) GROUP BY 1, 2),
n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, s // (d // hi) ORDER BY s) AS q FROM n WHERE n > hi AND s // (d // hi) < hi)
SELECT video_id, s AS start_s, title FROM n WHERE n <= hi UNION ALL SELECT video_id, s, title FROM r WHERE q = 1""")
def f7_legacy(t):
    return bf.balance(tagged(t), legacy=True)


def close_stamps(t):
    """EVS starts squeezed 60 times, so that many lie within a second."""
    return density_blocks(t.evs.select("video_id", "event_id", (F.col("start_s") / 60).alias("t")), ["video_id"], "t", tie="event_id")


@query("f8_running_midpoint_merge", "evs", """WITH RECURSIVE o AS (SELECT video_id, start_s / 60 AS t, row_number() OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS rn FROM evs),
f AS (SELECT video_id, rn, t AS v, 1 AS grp FROM o WHERE rn = 1 UNION ALL SELECT o.video_id, o.rn, CASE WHEN o.t - f.v < 1 THEN (f.v + o.t) / 2 ELSE o.t END, CASE WHEN o.t - f.v < 1 THEN grp ELSE grp + 1 END FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1)
SELECT video_id, round(arg_max(v, rn), 6) AS t FROM f GROUP BY video_id, grp""")
def f8(t):
    return fo.fold(close_stamps(t), ["video_id"], ["t", "event_id"], ["t"], fo.midpoint_step(), "t double").select("video_id", F.round("t", 6).alias("t"))


@query("f9_thin_to_n", "evs", f"""WITH RECURSIVE o AS (SELECT video_id, start_s / 60 AS t, row_number() OVER (PARTITION BY video_id ORDER BY start_s, event_id) AS rn FROM evs),
f AS (SELECT video_id, rn, t AS v, 1 AS grp FROM o WHERE rn = 1 UNION ALL SELECT o.video_id, o.rn, CASE WHEN o.t - f.v < 1 THEN (f.v + o.t) / 2 ELSE o.t END, CASE WHEN o.t - f.v < 1 THEN grp ELSE grp + 1 END FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1),
m AS (SELECT video_id, list(v ORDER BY v) AS l FROM (SELECT video_id, arg_max(v, rn) AS v FROM f GROUP BY video_id, grp) GROUP BY 1),
{thin_sql("m", 21)}
SELECT video_id, round(t, 6) AS t FROM (SELECT video_id, unnest(l) AS t FROM tn WHERE len(l) <= 21)""")
def f9(t):
    """Runs on merged stamps, which are at least a second apart."""
    merged = fo.fold(close_stamps(t), ["video_id"], ["t", "event_id"], ["t"], fo.midpoint_step(), "t double")
    return thin_gaps(merged, 21).select("video_id", F.round("t", 6).alias("t"))


@query("f11_gap_merge", "ref", """
WITH z AS (SELECT video_id, start_s, end_s - CASE WHEN idx % 3 = 0 THEN 20 WHEN idx % 3 = 1 THEN 5 ELSE 0 END AS end_s FROM ref),
k AS (SELECT *, end_s - start_s >= 300 AS ok, bool_or(end_s - start_s >= 300) OVER (PARTITION BY video_id) AS anyok, row_number() OVER (PARTITION BY video_id ORDER BY end_s - start_s DESC, start_s) AS r FROM z),
p AS (SELECT *, max(end_s) OVER (PARTITION BY video_id ORDER BY start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM k WHERE ok OR (NOT anyok AND r = 1)),
g AS (SELECT *, sum(CASE WHEN pk IS NULL OR start_s - pk > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_s) AS g FROM p)
SELECT video_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM g GROUP BY video_id, g""")
def f11(t):
    k = F.col("idx") % 3
    blocks = t.ref.select("video_id", "start_s", (F.col("end_s") - F.when(k == 0, 20).when(k == 1, 5).otherwise(0)).alias("end_s"))
    return bf.merge_gaps(blocks, 300.0, 15.0)


LINE_WORDS_SQL = f"""
lw AS (SELECT video_id, line_no, w, count(*) AS n, min(i) AS p FROM (SELECT video_id, line_no, unnest(range(len(k))) AS i, unnest(k) AS w FROM (SELECT video_id, line_no, {words_sql('text')} AS k FROM lin)) GROUP BY 1, 2, 3),
kw AS (SELECT video_id, line_no, list(w) AS k FROM (SELECT *, row_number() OVER (PARTITION BY video_id, line_no ORDER BY n DESC, p) AS rk FROM lw) WHERE rk <= 10 GROUP BY 1, 2)
"""


def line_keywords(t):
    kw = top_lists(t.lin, ["video_id", "line_no"], "text", 10).withColumnRenamed("top", "k")
    return t.lin.select("video_id", "line_no").join(kw, ["video_id", "line_no"], "left").withColumn("line_no", F.col("line_no").cast("long"))


JAC = "coalesce(len(list_intersect({0}, {1})) / nullif(len(list_distinct({0} || {1})), 0)::DOUBLE, 0)"


@query("f12_keyword_segmentation", "lin", f"""WITH RECURSIVE {LINE_WORDS_SQL},
o AS (SELECT l.video_id, l.line_no, coalesce(k, []) AS k FROM lin l LEFT JOIN kw USING (video_id, line_no)),
f AS (SELECT video_id, line_no, line_no AS run, k AS u FROM o WHERE line_no = 0 UNION ALL
 SELECT o.video_id, o.line_no, CASE WHEN {JAC.format('f.u', 'o.k')} < 0.05 THEN o.line_no ELSE f.run END, CASE WHEN {JAC.format('f.u', 'o.k')} < 0.05 THEN o.k ELSE list_distinct(f.u || o.k) END FROM f JOIN o ON o.video_id = f.video_id AND o.line_no = f.line_no + 1)
SELECT video_id, run, count(*) AS n FROM f GROUP BY 1, 2""")
def f12(t):
    # places alone, read by the fold's test for blocks and by the fold
    rows = checkpointed(fo.with_last_places(line_keywords(t).select("video_id", "line_no", "k"), ["video_id"], "line_no", "k").drop("k"))
    labels = fo.runs(fixed_blocks(rows, "line_no"), ["video_id"], ["line_no"], "line_no", ["line_no", "n", "back"], fo.keyword_shift(0.05))
    return labels.groupBy("video_id", "run").agg(F.count(F.lit(1)).alias("n"))


TF_SQL = r"""
tk AS (SELECT video_id, line_no, [y FOR y IN [regexp_extract(x, '[a-zA-Z0-9_]{3,}$') FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')] IF y <> ''] AS k FROM lin),
tfr AS (SELECT video_id, line_no, w, count(*) AS tf FROM (SELECT video_id, line_no, unnest(k) AS w FROM tk) GROUP BY ALL), dfr AS (SELECT video_id, w, count(*) AS df FROM tfr GROUP BY ALL), nn AS (SELECT video_id, count(*) AS n FROM lin GROUP BY 1),
x AS (SELECT tfr.*, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS x FROM tfr JOIN dfr USING (video_id, w) JOIN nn USING (video_id)), nm AS (SELECT video_id, line_no, sqrt(sum(x * x)) AS nm FROM x GROUP BY ALL),
dot AS (SELECT a.video_id, b.line_no, sum(a.x * b.x) AS d FROM x a JOIN x b ON a.video_id = b.video_id AND a.w = b.w AND b.line_no = a.line_no + 1 GROUP BY 1, 2),
sm AS (SELECT l.video_id, l.line_no, CASE WHEN p.nm IS NOT NULL AND q.nm IS NOT NULL THEN round(coalesce(d, 0) / (p.nm * q.nm), 9) END AS sim FROM lin l LEFT JOIN nm p ON p.video_id = l.video_id AND p.line_no = l.line_no - 1 LEFT JOIN nm q ON q.video_id = l.video_id AND q.line_no = l.line_no LEFT JOIN dot ON dot.video_id = l.video_id AND dot.line_no = l.line_no WHERE l.line_no > 0),
t0 AS (SELECT video_id, round(greatest(0.05, least(0.92, avg(sim) - 0.5 * stddev_pop(sim))), 9) AS t0 FROM sm GROUP BY 1 HAVING count(sim) > 0),
tt AS (SELECT video_id, a, round(greatest(0.02, t0 - 0.05 * a), 9) AS t FROM t0, range(7) AS r(a)),
cn AS (SELECT tt.video_id, a, t, 1 + count(*) FILTER (WHERE sim < t) AS blocks FROM tt JOIN sm USING (video_id) GROUP BY ALL),
ch AS (SELECT video_id, arg_min(t, a) FILTER (WHERE blocks >= 3 OR a = 6 OR t <= 0.02) AS t FROM cn GROUP BY 1)
"""


@query("f13_cosine_segmentation", "lin", f"WITH {TF_SQL}, " + """
s AS (SELECT l.video_id, l.line_no, CASE WHEN sim < t THEN 1 ELSE 0 END AS sp FROM lin l SEMI JOIN t0 USING (video_id) LEFT JOIN sm USING (video_id, line_no) LEFT JOIN ch USING (video_id)),
b AS (SELECT video_id, sum(sp) OVER (PARTITION BY video_id ORDER BY line_no) AS b FROM s)
SELECT video_id, CAST(b AS BIGINT) AS block_no, count(*) AS n FROM b GROUP BY 1, 2""")
def f13(t):
    """Split where the similarity of neighbours is under a threshold set by mean and deviation; the
    back-off thresholds are all counted in one pass and the first that gives three blocks is used.
    Lowering a threshold can only merge; that is how the original behaves too. Bounds fit the test lines."""
    # one number a line, read four times
    sims = checkpointed(si.line_similarity(t.lin))
    return si.cosine_blocks(t.lin, sims, low=0.05, high=0.92, sigmas=0.5, step=0.05, tries=6, floor=0.02, wanted=3).groupBy("video_id", "block_no").agg(F.count(F.lit(1)).alias("n"))


@query("f18_forward_text_merge", "lin", f"""WITH RECURSIVE o AS (SELECT video_id, line_no, list_distinct({TOKS.format('text')}) AS k FROM lin),
f AS (SELECT video_id, line_no, line_no AS run, k AS u FROM o WHERE line_no = 0 UNION ALL
 SELECT o.video_id, o.line_no, CASE WHEN {JAC.format('f.u', 'o.k')} > 0.1 THEN f.run ELSE o.line_no END, CASE WHEN {JAC.format('f.u', 'o.k')} > 0.1 THEN f.u ELSE o.k END FROM f JOIN o ON o.video_id = f.video_id AND o.line_no = f.line_no + 1)
SELECT video_id, run, count(*) AS n FROM f GROUP BY 1, 2""")
def f18(t):
    """Character pairs stand in for words when the line holds Han characters."""
    c = F.col("text")
    keys = F.when(c.rlike(tx.HAN_ANY), tx.bigrams(c)).otherwise(F.array_distinct(tx.tokens(c)))
    rows = fixed_blocks(t.lin.select("video_id", F.col("line_no").cast("long").alias("line_no"), keys.alias("k")), "line_no")
    labels = fo.runs(rows, ["video_id"], ["line_no"], "line_no", ["k"], fo.similar_text(0.1))
    return labels.groupBy("video_id", "run").agg(F.count(F.lit(1)).alias("n"))


@query("f19_near_equal_title_merge", "ref", r"""WITH RECURSIVE
c AS (SELECT video_id, start_s, end_s, CASE WHEN idx % 4 < 2 THEN 'signup intro part' ELSE title END AS title, idx, row_number() OVER (PARTITION BY video_id ORDER BY end_s - start_s DESC, start_s) AS rk FROM ref),
o AS (SELECT video_id, start_s, end_s, title, round(0.35::DOUBLE * (idx % 5 / 5.0::DOUBLE) + 0.25::DOUBLE * 0.4::DOUBLE + 0.25::DOUBLE * 0.6::DOUBLE + 0.15::DOUBLE * (idx % 4 = 0)::INT, 3) AS conf,
  row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS rn, list_distinct(regexp_extract_all(lower(title), '[a-z0-9_]+')) AS w FROM c WHERE rk <= 20),
f AS (SELECT video_id, rn, start_s AS s, end_s AS e, title AS t, conf AS q, w AS k FROM o WHERE rn = 1 UNION ALL
 SELECT video_id, rn, CASE WHEN m THEN s ELSE start_s END, end_s, CASE WHEN m THEN t ELSE title END, CASE WHEN m THEN round(0.5::DOUBLE * (q + conf), 3) ELSE conf END, CASE WHEN m THEN k ELSE w END FROM
 (SELECT o.*, f.s, f.t, f.q, f.k, len(list_intersect(f.k, o.w)) >= 0.82::DOUBLE * len(list_distinct(f.k || o.w)) AS m FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1))
SELECT video_id, s AS start_s, arg_max(e, rn) AS end_s, any_value(t) AS title, arg_max(q, rn) AS confidence FROM f GROUP BY video_id, s""")
def f19(t):
    k = F.col("idx") % 4
    title = F.when(k < 2, "signup intro part").otherwise(F.col("title"))
    sim, w = F.col("idx") % 5 / 5.0, F.lit(0.4)
    best = wi.top_rows(t.ref.select("video_id", "start_s", "end_s", title.alias("title"), bf.confidence(sim, w, 1 - w, k == 0).alias("confidence")), ["video_id"], [F.desc(F.col("end_s") - F.col("start_s")), F.asc("start_s")], 20)
    return bf.merge_titles(best)


@query("f20_near_duplicate_lines")
def f20(t):
    """Exact similarity ratio: within a window of lines, then against the lines kept before the window."""
    from cuewise.operators.neardup import dedup_lines

    lines = t.lin.select("video_id", F.col("line_no").cast("long").alias("line_no"), "text")
    # else the filter repeats what makes the text
    lines = once(lines, text=tx.normalize_line(F.col("text"))).where("text <> ''")
    return dedup_lines(lines.withColumn("window_no", F.floor(F.col("line_no") / 8)), counted=t.lin)


@query("f20_levenshtein_near_duplicates", "lin", """
WITH l AS (SELECT video_id, line_no, text AS t FROM lin)
SELECT video_id, line_no FROM l WHERE EXISTS (SELECT 1 FROM l p WHERE p.video_id = l.video_id AND p.line_no < l.line_no AND abs(length(p.t) - length(l.t)) <= 2 AND levenshtein(p.t, l.t) <= 2)""")
def f20_levenshtein(t):
    """Lines within two edits of an earlier line, by shared pieces: two edits leave one of three
    pieces of a line whole, so candidates meet on an equal piece and are then verified exactly."""
    from cuewise.operators.neardup import near_earlier

    lines = t.lin.select("video_id", F.col("line_no").cast("long").alias("line_no"), "text")
    return near_earlier(lines, edits=2)


@query("f22_stamp_collision_bump", "uni", """WITH RECURSIVE
o AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS rn, start_s // 900 * 900 AS s, min(duration) OVER (PARTITION BY video_id) - 1 AS fin,
  CASE WHEN unit_no IS NULL THEN '' WHEN unit_no % 2 = 0 THEN '[單元' || unit_no || '：u' || unit_no || '] ' ELSE '[單元' || unit_no || '] ' END || title AS title FROM uni WHERE title <> ''),
f AS (SELECT video_id, rn, s AS placed, title, [s] AS used FROM o WHERE rn = 1 UNION ALL
 SELECT video_id, rn, placed, title, CASE WHEN placed IS NULL THEN used ELSE list_append(used, placed) END FROM (SELECT o.video_id, o.rn, o.title, f.used,
  CASE WHEN NOT list_contains(f.used, o.s) THEN o.s ELSE list_filter(list_concat(range(o.s + 1, o.s + 121), range(o.s - 1, o.s - 121, -1)), lambda x: x >= 0 AND x <= o.fin AND NOT list_contains(f.used, x))[1] END AS placed
  FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1))
SELECT video_id, placed AS start_s, title FROM f WHERE placed IS NOT NULL""")
def f22(t):
    rough = (F.floor(F.col("start_s") / 900) * 900).alias("start_s")
    return bf.place_stamps(t.uni.select("video_id", "idx", rough, "duration", "title", "unit_no", F.when(F.col("unit_no") % 2 == 0, F.concat(F.lit("u"), "unit_no")).alias("unit_title")))


@query("f24_reading_order_lines")
def f24(t):
    """Tokens of 40 text lines make a frame; lines are joined by baseline and gap, then screen words go."""
    boxes = word_boxes(t).select("video_id", F.floor(F.col("line_no") / 40).alias("frame"), F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"),
                                 F.col("y1").cast("double").alias("y1"), (F.col("y1") + 10).cast("double").alias("y2"), F.lit(1280).alias("w"), F.lit(720).alias("h"), F.col("w").alias("text"))
    lines = bf.reading_lines(boxes)
    keep = (F.length("text") >= 2) & ~F.lower("text").isin(tx.LINE_DENYLIST)
    return lines.where(keep).groupBy("video_id", "frame", "text").agg(F.min("line_no").alias("line_no"))
