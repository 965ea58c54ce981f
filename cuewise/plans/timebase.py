"""Transcript sources, clock text, token estimates, chapter boundaries and containment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions import timefmt as tf
from cuewise.operators import chapters as ch
from cuewise.operators.ordered import fixed_blocks, scan
from cuewise.operators.ranges import point_join
from cuewise.plans.registry import query
from cuewise.sources import transcripts as tr

HMS_SQL = "printf('%02d:%02d:%02d', CAST(trunc({0}) AS BIGINT) // 3600, CAST(trunc({0}) AS BIGINT) % 3600 // 60, CAST(trunc({0}) AS BIGINT) % 60)"
TRIM_SQL = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
TOK_SQL = r"CAST(floor(length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]', '', 'g')) * 1.5::DOUBLE + length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]', '', 'g')) * 0.3::DOUBLE) AS BIGINT)"
PTOK_SQL = r"CASE WHEN length({0}) = 0 THEN 0 ELSE length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) + greatest(1, length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}]', '', 'g')) // 4) END"


def rendered(t):
    """SEG as transcript text: both grammars in turn, with a line that fits neither."""
    clock = F.concat(tf.sec_to_hms(F.col("start_s")), F.lit(": "), F.col("text"))
    bracket = F.format_string("[%.1f - %.1f] %s", "start_s", "end_s", "text")
    return t.seg.select("video_id", F.col("seg_idx").alias("part"),
                        F.concat(F.when(F.col("seg_idx") % 2 == 0, clock).otherwise(bracket), F.lit("\n(noise)")).alias("text"))


RENDERED_SQL = f"""
lines AS (SELECT video_id, seg_idx AS part, {TRIM_SQL.format("CASE WHEN seg_idx % 2 = 0 THEN " + HMS_SQL.format("start_s") + " || ': ' || text ELSE printf('[%.1f - %.1f] %s', start_s, end_s, text) END")} AS line FROM seg),
parsed AS (
  SELECT video_id, part, 0 AS line_no,
    CASE WHEN line[1] = '[' THEN CAST(regexp_extract(line, '^\\[(\\d+\\.?\\d*)', 1) AS DOUBLE)
         ELSE CAST(substr(line, 1, 2) AS DOUBLE) * 3600 + CAST(substr(line, 4, 2) AS DOUBLE) * 60 + CAST(substr(line, 7, 2) AS DOUBLE) END AS start_s,
    CASE WHEN line[1] = '[' THEN CAST(regexp_extract(line, '- (\\d+\\.?\\d*)\\]', 1) AS DOUBLE) END AS e,
    CASE WHEN line[1] = '[' THEN {TRIM_SQL.format("regexp_extract(line, '^[^]]*[]](.*)', 1)")} ELSE {TRIM_SQL.format("substr(line, 10)")} END AS text
  FROM lines),
segs AS (SELECT video_id, part, line_no, start_s, coalesce(e, lead(start_s) OVER (PARTITION BY video_id ORDER BY part), start_s + 30) AS end_s, text FROM parsed)
"""


def thin_sql(lists: str, keep: int) -> str:
    """The plain rule on lists `(video_id, l)`, one stamp per step."""
    gaps = "list_transform(range(1, len(l)), lambda x: l[x + 1] - l[x])"
    return f"""tn AS (SELECT video_id, l FROM {lists} UNION ALL
 SELECT video_id, list_concat(l[1:k - 1], l[k + 1:]) FROM (SELECT video_id, l, CASE WHEN i < len(l) - 1 THEN i + 1 ELSE i END AS k FROM (SELECT video_id, l, list_position({gaps}, list_min({gaps})) AS i FROM tn WHERE len(l) > {keep})))"""


@query("s1_transcript_source", "seg", f"WITH {RENDERED_SQL} SELECT video_id, part, start_s, end_s, text FROM segs")
def s1(t):
    return tr.parse_transcript(rendered(t)).select("video_id", "part", "start_s", "end_s", "text")


@query("s2_parallel_array_transcript", "seg", f"""
SELECT video_id, seg_idx, {HMS_SQL.format('start_s')} || ': ' || {TRIM_SQL.format('text')} AS line,
       {HMS_SQL.format('start_s')} || ' - ' || {HMS_SQL.format('end_s')} || ': ' || {TRIM_SQL.format('text')} AS line_end FROM seg""")
def s2(t):
    """Array transcripts hold at most one block of rows per record, so a long video is several records."""
    records = (
        fixed_blocks(t.seg, "seg_idx", 4096).groupBy("video_id", "_b")
        .agg(F.sort_array(F.collect_list(F.struct("seg_idx", "text", "start_s", "end_s"))).alias("r"))
        .select("video_id", F.col("r.seg_idx").alias("pos"), F.struct(F.col("r.text").alias("text"), F.col("r.start_s").alias("start"), F.col("r.end_s").alias("end")).alias("asr"))
    )
    rows = records.select("video_id", F.explode(F.arrays_zip("pos", "asr.text", "asr.start", "asr.end")).alias("z"))
    start, end = tf.sec_to_hms(F.col("z.start")), tf.sec_to_hms(F.col("z.end"))
    body = F.concat(F.lit(": "), tx.strip(F.col("z.text")))
    return rows.select("video_id", F.col("z.pos").alias("seg_idx"), F.concat(start, body).alias("line"),
                       F.concat(start, F.lit(" - "), end, body).alias("line_end"))


@query("s3_chapter_map_source", "ref", "SELECT video_id, start_s AS sec, title FROM ref")
def s3(t):
    maps = ch.chapter_map(t.ref.select("video_id", "start_s", "title")).select("video_id", F.to_json("chapters").alias("doc"))
    pairs = maps.select("video_id", F.explode(F.map_entries(F.from_json("doc", "map<string,string>"))).alias("e"))
    return pairs.select("video_id", tf.hms_to_sec(F.col("e.key")).alias("sec"), F.col("e.value").alias("title"))


@query("s9_transcript_sink", "seg", f"""
SELECT video_id, seg_idx, printf('[%.1f - %.1f] %s', start_s, end_s, text) AS line,
  CASE WHEN {TRIM_SQL.format('text')} <> '' THEN '[' || {HMS_SQL.format('start_s')} || '-' || {HMS_SQL.format('end_s')} || '] ' || {TRIM_SQL.format('text')} END AS compact FROM seg""")
def s9(t):
    compact = tr.compact_lines(t.seg).select("video_id", "seg_idx", F.col("line").alias("compact"))
    return tr.bracket_lines(t.seg).select("video_id", "seg_idx", "line").join(compact, ["video_id", "seg_idx"], "left")


@query("w1_end_inference", "seg dur", """
SELECT video_id, seg_idx, coalesce(lead(start_s) OVER w, start_s + 30) AS end_tail,
       coalesce(lead(start_s) OVER w, CAST(duration AS DOUBLE)) AS end_duration
FROM seg LEFT JOIN dur USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx)""")
def w1(t):
    rows = scan(fixed_blocks(t.seg, "seg_idx"), ["video_id"], ["seg_idx"], lead={"nxt": "start_s"})
    return rows.join(t.dur, "video_id", "left").select(
        "video_id", "seg_idx", F.coalesce("nxt", F.col("start_s") + 30).alias("end_tail"),
        F.coalesce("nxt", F.col("duration").cast("double")).alias("end_duration"))


@query("w2_boundaries_to_segments", "ref", """
WITH b AS (SELECT video_id, start_s AS s, duration FROM ref UNION SELECT video_id, 0, duration FROM ref),
segs AS (SELECT video_id, CAST(s AS DOUBLE) AS seg_start, CAST(coalesce(lead(s) OVER (PARTITION BY video_id ORDER BY s), duration) AS DOUBLE) AS seg_end,
  lead(s) OVER (PARTITION BY video_id ORDER BY s) IS NULL AS is_last FROM b)
SELECT video_id, seg_start, seg_end FROM segs WHERE NOT is_last OR seg_start <> seg_end""")
def w2(t):
    return ch.segments(t.ref.select("video_id", "start_s", "duration"), zero="add").select(
        "video_id", F.col("s").alias("seg_start"), F.col("e").alias("seg_end"))


@query("w3_sequential_numbering", "ref", """
SELECT video_id, title, row_number() OVER w AS unit_no, printf('Q%03d', row_number() OVER w) AS question_id,
       printf('T%02d', row_number() OVER w) AS topic_id, row_number() OVER w - 1 AS chunk_index
FROM ref WINDOW w AS (PARTITION BY video_id ORDER BY start_s)""")
def w3(t):
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("start_s"))
    return t.ref.withColumn("n", n).select(
        "video_id", "title", F.col("n").cast("long").alias("unit_no"), F.format_string("Q%03d", "n").alias("question_id"),
        F.format_string("T%02d", "n").alias("topic_id"), (F.col("n") - 1).cast("long").alias("chunk_index"))


@query("j4_segment_chapter_containment", "seg ref", """
SELECT video_id, seg_idx, idx AS chapter_idx, title FROM seg s JOIN ref r USING (video_id)
WHERE s.start_s >= r.start_s - 1 AND s.start_s < r.end_s""")
def j4(t):
    return ch.contain(t.seg, t.ref).select("video_id", "seg_idx", "chapter_idx", "title")


@query("x1_clock_to_seconds", "ref", r"""
WITH s AS (SELECT video_id, idx, i, CASE i
   WHEN 0 THEN printf('%02d:%02d:%02d', start_s // 3600, start_s % 3600 // 60, start_s % 60)
   WHEN 1 THEN printf('%02d:%02d', start_s // 60 % 60, start_s % 60)
   WHEN 2 THEN printf('%02d:%02d:%02d', start_s // 3600, start_s % 120, start_s % 60)
   WHEN 3 THEN printf('%02d:%02d:%02d.5', start_s // 3600, start_s % 3600 // 60, start_s % 60)
   ELSE title END AS stamp FROM ref, range(5) AS r(i)),
p AS (SELECT *, string_split(stamp, ':') AS a, len(string_split(stamp, ':')) AS n FROM s),
v AS (SELECT *, TRY_CAST(a[1] AS BIGINT) AS h, TRY_CAST(a[2] AS BIGINT) AS m,
        CASE WHEN regexp_full_match(a[3], '\d+') THEN CAST(a[3] AS BIGINT) END AS s3, TRY_CAST(a[3] AS DOUBLE) AS d3 FROM p)
SELECT video_id, idx, i, stamp,
  coalesce(CASE WHEN n = 3 THEN h * 3600 + m * 60 + s3 WHEN n = 2 THEN h * 60 + m END, 0) AS zero,
  CASE WHEN n = 3 THEN h * 3600 + m * 60 + s3 WHEN n = 2 THEN h * 60 + m END AS missing,
  CASE WHEN n = 3 AND m < 60 AND s3 < 60 THEN h * 3600 + m * 60 + s3 ELSE -1 END AS strict,
  CASE WHEN n = 3 AND m < 60 AND s3 < 60 THEN h * 3600 + m * 60 + s3 WHEN n = 2 AND h < 60 AND m < 60 THEN h * 60 + m ELSE -1 END AS two_part,
  CASE WHEN n = 3 AND m < 60 AND d3 < 60 THEN h * 3600 + m * 60 + d3 WHEN n = 2 AND m < 60 THEN h * 60 + m::DOUBLE END AS with_decimals
FROM v""")
def x1(t):
    s = F.col("start_s")
    hour = F.floor(s / 3600)
    forms = F.array(
        tf.sec_to_hms(s), F.format_string("%02d:%02d", F.floor(s / 60) % 60, s % 60),
        F.format_string("%02d:%02d:%02d", hour, s % 120, s % 60),
        F.concat(tf.sec_to_hms(s), F.lit(".5")), F.col("title"))
    rows = t.ref.select("video_id", "idx", F.posexplode(forms).alias("i", "stamp"))
    st = F.col("stamp")
    return rows.select("*", tf.hms_to_sec(st).alias("zero"), tf.hms_to_sec(st, "null").alias("missing"),
                       tf.hms_to_sec(st, "strict").alias("strict"), tf.hms_to_sec(st, "two_part").alias("two_part"),
                       tf.hms_to_sec(st, "decimal").alias("with_decimals"))


@query("x2_seconds_to_clock", "evs", f"""
SELECT event_id, {HMS_SQL.format('start_s')} AS hms, {HMS_SQL.format('greatest(start_s - 600, 0)')} AS clamped,
  CASE WHEN start_s < 3600 THEN printf('%02d:%02d', CAST(trunc(start_s) AS BIGINT) // 60, CAST(trunc(start_s) AS BIGINT) % 60) ELSE {HMS_SQL.format('start_s')} END AS short FROM evs""")
def x2(t):
    s = F.col("start_s")
    return t.evs.select("event_id", tf.sec_to_hms(s).alias("hms"), tf.sec_to_hms(s - 600).alias("clamped"),
                        tf.sec_to_hms(s, short=True).alias("short"))


@query("x3_stamp_normalisation", "ref", r"""
WITH s AS (SELECT video_id, idx, i, CASE i WHEN 0 THEN printf('%d:%02d', start_s // 60 % 60, start_s % 60)
   WHEN 1 THEN printf('%d:%d:%d', start_s // 3600, start_s % 3600 // 60, start_s % 60) ELSE title END AS stamp FROM ref, range(3) AS r(i)),
p AS (SELECT *, [CASE WHEN length(x) < 2 THEN '0' || x ELSE x END FOR x IN string_split(stamp, ':')] AS a FROM s)
SELECT video_id, idx, i, CASE len(a) WHEN 2 THEN '00:' || a[1] || ':' || a[2] WHEN 3 THEN a[1] || ':' || a[2] || ':' || a[3] ELSE stamp END AS normal,
  regexp_full_match(stamp, '\d{2}:\d{2}:\d{2}') AS is_hms FROM p""")
def x3(t):
    s = F.col("start_s")
    forms = F.array(F.format_string("%d:%02d", F.floor(s / 60) % 60, s % 60),
                    F.format_string("%d:%d:%d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60), F.col("title"))
    rows = t.ref.select("video_id", "idx", F.posexplode(forms).alias("i", "stamp"))
    return rows.select("video_id", "idx", "i", tf.normalize_stamp(F.col("stamp")).alias("normal"), tf.is_hms(F.col("stamp")).alias("is_hms"))


HAN_TABLE = ("aeiou", "啊我一哦㐀")


@query("x4_token_estimates", "", f"""
WITH d AS (SELECT doc_id, text, translate(text, '{HAN_TABLE[0]}', '{HAN_TABLE[1]}') AS han FROM documents)
SELECT doc_id, {TOK_SQL.format('text')} AS chunk_plain, {TOK_SQL.format('han')} AS chunk_han,
       {PTOK_SQL.format('text')} AS prompt_plain, {PTOK_SQL.format('han')} AS prompt_han FROM d""")
def x4(t):
    han = F.translate("text", *HAN_TABLE)
    return t.documents.select("doc_id", tx.chunk_tokens(F.col("text")).alias("chunk_plain"), tx.chunk_tokens(han).alias("chunk_han"),
                              tx.prompt_tokens(F.col("text")).alias("prompt_plain"), tx.prompt_tokens(han).alias("prompt_han"))


@query("x23_duration_policy", "dur", """
SELECT video_id, duration,
  CASE WHEN duration < 1800 THEN 120 WHEN duration < 3600 THEN 180 WHEN duration < 7200 THEN 240 WHEN duration < 10800 THEN 300 ELSE 360 END AS min_gap,
  CASE WHEN duration < 1800 THEN '5-10/30' WHEN duration < 3600 THEN '6-12/40' WHEN duration < 7200 THEN '8-16/50' WHEN duration < 10800 THEN '10-20/60' ELSE '12-24/80' END AS band,
  CASE WHEN duration < 1800 THEN 90 WHEN duration < 3600 THEN 180 WHEN duration < 7200 THEN 300 WHEN duration < 10800 THEN 540 ELSE 600 END AS legacy_gap,
  CASE WHEN duration < 1800 THEN '6-12/30' WHEN duration < 3600 THEN '8-16/40' WHEN duration < 7200 THEN '10-20/50' WHEN duration < 10800 THEN '12-24/60' ELSE '14-28/80' END AS legacy_band
FROM dur""")
def x23(t):
    now, old = ch.policy(F.col("duration")), ch.policy(F.col("duration"), legacy=True)

    def band(p):
        return F.format_string("%d-%d/%d", p["low"], p["high"], p["cap"])

    return t.dur.select("video_id", "duration", now["min_gap"].alias("min_gap"), band(now).alias("band"),
                        old["min_gap"].alias("legacy_gap"), band(old).alias("legacy_band"))


@query("x24_schedules", "dur", """
WITH eq AS (SELECT video_id, i, 'equal' AS kind, i * (duration / 11.0::DOUBLE) AS pt FROM dur, range(1, 11) AS r(i)),
iv AS (SELECT video_id, i, 'interval' AS kind, (duration - duration // 60 * 60) / 2.0::DOUBLE + i * 60.0::DOUBLE AS pt FROM dur, range(400) AS r(i) WHERE duration >= 60 AND i <= duration // 60),
mi AS (SELECT video_id, i, 'middle' AS kind, CAST((duration * i // 15 + duration * (i + 1) // 15 - 1) // 2 AS DOUBLE) AS pt FROM dur, range(15) AS r(i)),
fb AS (SELECT video_id, i, 'fallback' AS kind, CAST(i * 300 AS DOUBLE) AS pt FROM dur, range(400) AS r(i) WHERE i * 300 < duration),
fr AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY f) - 1 AS i, 'frame' AS kind, CAST(f AS DOUBLE) AS pt FROM (SELECT DISTINCT video_id, CAST(floor(pt * 2.5::DOUBLE) AS BIGINT) AS f FROM eq))
SELECT video_id, kind, round(pt, 6) AS pt FROM (SELECT * FROM eq UNION ALL SELECT * FROM iv UNION ALL SELECT * FROM mi UNION ALL SELECT * FROM fb UNION ALL SELECT * FROM fr)""")
def x24(t):
    d = F.col("duration").cast("double")
    kinds = {
        "equal": ch.equal_points(d, 10), "interval": ch.interval_points(d, 60.0), "middle": ch.midpoints(d, 15),
        "fallback": ch.fallback_points(d, 300), "frame": ch.frame_numbers(ch.equal_points(d, 10), 2.5, d),
    }

    def tagged(kind, points):
        return F.transform(points, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("pt")))

    rows = F.concat(*[tagged(k, v) for k, v in kinds.items()])
    out = t.dur.select("video_id", F.explode(rows).alias("r"))
    return out.select("video_id", "r.kind", F.round("r.pt", 6).alias("pt"))


@query("d4_row_generators", "seg", f"""
SELECT video_id, seg_idx, 'word' AS kind, i AS pos, w AS item FROM (SELECT video_id, seg_idx, unnest(range(len(p))) AS i, unnest(p) AS w FROM (SELECT *, string_split(text, ' ') AS p FROM seg))
UNION ALL SELECT video_id, seg_idx, 'tick', i, {HMS_SQL.format('start_s + i * 5')} FROM seg, range(4) AS r(i)""")
def d4(t):
    words = t.seg.select("video_id", "seg_idx", F.lit("word").alias("kind"), F.posexplode(F.split("text", " ")).alias("pos", "item"))
    ticks = t.seg.select("video_id", "seg_idx", F.lit("tick").alias("kind"),
                         F.posexplode(F.sequence(F.col("start_s").cast("long"), F.col("end_s").cast("long") - 1, F.lit(5).cast("long"))).alias("pos", "at"))
    return words.unionByName(ticks.withColumn("item", tf.sec_to_hms(F.col("at"))).drop("at")).withColumn("pos", F.col("pos").cast("long"))


@query("slice_chapter_token_report", "seg ref", f"""WITH {RENDERED_SQL},
hit AS (SELECT s.video_id, r.idx, s.part, s.text FROM segs s JOIN ref r ON s.video_id = r.video_id AND s.start_s >= r.start_s - 1 AND s.start_s < r.end_s),
chap AS (SELECT video_id, idx, count(*) AS n, {TOK_SQL.format("string_agg(text, ' ' ORDER BY part)")} AS tokens FROM hit GROUP BY 1, 2)
SELECT video_id, count(*) AS chapters, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(tokens) AS BIGINT) // count(*) AS mean_tokens FROM chap GROUP BY 1""")
def slice_report(t):
    hits = ch.contain(tr.parse_transcript(rendered(t)), t.ref)
    per_chapter = hits.groupBy("video_id", "chapter_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tx.count_of(F.col("text"), tx.HAN_WIDE)).alias("han"), F.sum(F.length("text")).alias("chars"))
    tokens = tx.chunk_tokens_of(F.col("han"), F.col("chars") + F.col("n") - 1)
    return per_chapter.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("chapters"), F.sum("n").alias("segments"), F.floor(F.sum(tokens) / F.count(F.lit(1))).alias("mean_tokens"))
