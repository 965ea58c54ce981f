"""Course units, manifests and source preference."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions import timefmt as tf
from cuewise.operators import units as un
from cuewise.plans.registry import query
from cuewise.plans.timebase import HMS_SQL, TRIM_SQL
from cuewise.sources import manifest as mf

SUGG_SQL = r"""
su AS (SELECT video_id, idx, CASE WHEN idx % 3 = 0 THEN unit_no END AS client_no, CASE WHEN idx % 3 = 1 THEN unit_no END AS parent_no,
  CASE WHEN idx % 3 = 2 AND unit_no IS NOT NULL THEN '[單元' || unit_no || '：x] ' || title ELSE title END AS title, CASE WHEN idx % 7 = 6 THEN 'soon' ELSE time END AS time FROM uni),
ky AS (SELECT *, coalesce(client_no, parent_no, TRY_CAST(regexp_extract(title, '(?:^\s*\[\s*單元\s*|單元\s*)(\d+)(?:\s*\]|\s*[:：])', 1) AS INTEGER)) AS unit,
  CASE WHEN time <> 'soon' THEN CAST(time[1:2] AS BIGINT) * 3600 + CAST(time[4:5] AS BIGINT) * 60 + CAST(time[7:8] AS BIGINT) END AS sec FROM su),
fi AS (SELECT video_id, unit, min(sec) AS sec FROM ky WHERE unit IS NOT NULL AND sec IS NOT NULL GROUP BY 1, 2),
fl AS (SELECT u.video_id, u.unit_no, u.title, CASE WHEN u.time <> '' THEN u.time WHEN sec IS NOT NULL THEN printf('%02d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) ELSE u.time END AS time,
  CASE WHEN u.time <> '' THEN 'existing' WHEN sec IS NOT NULL THEN 'filled' ELSE 'unmatched' END AS state FROM units u LEFT JOIN fi ON fi.video_id = u.video_id AND fi.unit = u.unit_no)
"""


def suggestions(t):
    k = F.col("idx") % 3
    title = F.when((k == 2) & F.col("unit_no").isNotNull(), F.concat(F.lit("[單元"), F.col("unit_no"), F.lit("：x] "), "title")).otherwise(F.col("title"))
    return t.uni.select("video_id", "idx", F.when(k == 0, F.col("unit_no")).alias("client_no"), F.when(k == 1, F.col("unit_no")).alias("parent_no"),
                        title.alias("title"), F.when(F.col("idx") % 7 == 6, "soon").otherwise(F.col("time")).alias("time"))


@query("j9_unit_time_fill", "uni units", f"WITH {SUGG_SQL} SELECT * FROM fl")
def j9(t):
    return un.fill_times(t.units, suggestions(t))


@query("j9_unit_fill_counters", "uni units", f"""WITH {SUGG_SQL}
SELECT video_id, count(*) FILTER (WHERE state = 'filled') AS filled_count, count(*) FILTER (WHERE state = 'existing') AS skipped_existing_time, count(*) FILTER (WHERE state = 'unmatched') AS unmatched_units,
  (SELECT count(*) FROM ky WHERE ky.video_id = fl.video_id AND unit IS NULL) AS unmatched_suggested, (SELECT count(*) FROM ky WHERE ky.video_id = fl.video_id AND unit IS NOT NULL AND sec IS NULL) AS invalid_suggested_times FROM fl GROUP BY 1""")
def j9_counters(t):
    return un.fill_counters(t.units, suggestions(t))


@query("j10_unit_mapping_validation", "uni units", r"""
WITH su AS (SELECT video_id, idx, CASE WHEN idx % 3 = 0 THEN unit_no * (1 + idx % 2) END AS client_no, CASE WHEN idx % 3 = 1 THEN unit_no END AS parent_no,
  CASE WHEN idx % 3 = 2 AND unit_no IS NOT NULL THEN '[單元9] [單元' || unit_no || '：x] ' || title WHEN idx % 11 = 10 THEN '  ' ELSE title END AS title, CASE WHEN idx % 7 = 6 THEN 'soon' ELSE time END AS time FROM uni),
v AS (SELECT video_id, idx, parent_no, client_no, time, trim(regexp_replace(title, '^\s*\[\s*單元\s*\d+\s*(?:[:：][^\]]+)?\]\s*', '')) AS title FROM su WHERE trim(title) <> '' AND time <> 'soon'),
k AS (SELECT *, coalesce(client_no, TRY_CAST(regexp_extract(title, '\[\s*單元\s*(\d+)\s*[:：]', 1) AS INTEGER)) AS unit FROM v)
SELECT k.video_id, row_number() OVER (PARTITION BY k.video_id ORDER BY k.time, idx) AS unit_no, parent_no, k.title, k.time, u.unit_no AS client_no, u.title AS client_title FROM k LEFT JOIN units u ON u.video_id = k.video_id AND u.unit_no = k.unit""")
def j10(t):
    k = F.col("idx") % 3
    title = F.when((k == 2) & F.col("unit_no").isNotNull(), F.concat(F.lit("[單元9] [單元"), F.col("unit_no"), F.lit("：x] "), "title")).when(F.col("idx") % 11 == 10, "  ").otherwise(F.col("title"))
    su = t.uni.select("video_id", "idx", F.when(k == 0, F.col("unit_no") * (1 + F.col("idx") % 2)).cast("int").alias("client_no"), F.when(k == 1, F.col("unit_no")).alias("parent_no"),
                      title.alias("title"), F.when(F.col("idx") % 7 == 6, "soon").otherwise(F.col("time")).alias("time"))
    return un.normalize_suggestions(su, t.units)


ROLL_SQL = """
m AS (SELECT video_id, unit_no, arg_min(title, time || printf('%06d', idx)) AS first_chapter, arg_max(title, time || printf('%06d', idx)) AS last_chapter, min(time) AS start, min(start_s) AS s, count(*) AS n FROM uni WHERE unit_no IS NOT NULL GROUP BY 1, 2),
r AS (SELECT u.video_id, u.unit_no, u.title, m.start, m.s, lead(m.start) OVER w AS e, lead(m.s) OVER w AS es, n, first_chapter, last_chapter FROM units u LEFT JOIN m USING (video_id, unit_no) WINDOW w AS (PARTITION BY u.video_id ORDER BY u.unit_no)),
en AS (SELECT video_id, unit_no, title, coalesce(start, '') AS time, CASE WHEN start IS NOT NULL THEN e END AS end_time,
  CASE WHEN start IS NOT NULL AND es - s <> 0 THEN printf('%02d:%02d:%02d', greatest(es - s, 0) // 3600, greatest(es - s, 0) % 3600 // 60, greatest(es - s, 0) % 60) END AS duration, coalesce(n, 0) AS n, first_chapter, last_chapter FROM r),
iss AS (SELECT video_id, unit_no, time, nx AS next_time FROM (SELECT *, lead(time) OVER (PARTITION BY video_id ORDER BY unit_no) AS nx FROM en) WHERE time <> '' AND nx <> '' AND time >= nx)
"""


@query("a13_unit_roll_up", "uni units", f"WITH {ROLL_SQL} SELECT * FROM en")
def a13(t):
    return un.roll_up(t.units, t.uni)


@query("a13_unit_diagnostics", "uni units", f"""WITH {ROLL_SQL}
SELECT e.video_id, count(*) AS total_units, count(*) FILTER (WHERE time <> '') AS units_found, count(*) FILTER (WHERE time = '') AS units_missing,
 (SELECT count(*) FROM uni WHERE uni.video_id = e.video_id) AS total_suggested, (SELECT count(unit_no) FROM uni WHERE uni.video_id = e.video_id) AS mapped_suggested,
 (SELECT count(*) FROM uni WHERE uni.video_id = e.video_id AND unit_no IS NULL) AS unmapped_suggested, NOT EXISTS (SELECT 1 FROM iss WHERE iss.video_id = e.video_id) AS timestamps_valid FROM en e GROUP BY 1""")
def a13_diagnostics(t):
    en = un.roll_up(t.units, t.uni)
    issues = un.order_issues(en).groupBy("video_id").agg(F.count(F.lit(1)).alias("bad"))
    a = en.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_units"), F.count_if(F.col("time") != "").alias("units_found"), F.count_if(F.col("time") == "").alias("units_missing"))
    s = t.uni.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_suggested"), F.count("unit_no").alias("mapped_suggested"), F.count_if(F.col("unit_no").isNull()).alias("unmapped_suggested"))
    return a.join(s, "video_id", "left").join(issues, "video_id", "left").withColumn("timestamps_valid", F.col("bad").isNull()).drop("bad")


@query("w14_unit_order_violations", "uni units", f"WITH {ROLL_SQL} SELECT * FROM iss")
def w14(t):
    return un.order_issues(un.roll_up(t.units, t.uni))


@query("a21_mapping_summary", "uni", """
WITH g AS (SELECT video_id, coalesce(unit_no, -1) AS unit_no, idx, left(title, 50) || ' @ ' || time AS item FROM uni)
SELECT video_id, unit_no, count(*) AS n, arg_min(item, idx) AS first_item, CASE WHEN count(*) > 1 THEN arg_max(item, idx) END AS last_item, string_agg(item, '; ' ORDER BY idx) AS items FROM g GROUP BY 1, 2""")
def a21(t):
    """Suggestions per client unit, unit -1 for those without one."""
    item = F.concat(F.substring("title", 1, 50), F.lit(" @ "), "time")
    g = t.uni.select("video_id", F.coalesce("unit_no", F.lit(-1)).alias("unit_no"), "idx", item.alias("item"))
    items = F.sort_array(F.collect_list(F.struct("idx", "item")))
    return g.groupBy("video_id", "unit_no").agg(F.count(F.lit(1)).alias("n"), F.min_by("item", "idx").alias("first_item"),
                                                F.when(F.count(F.lit(1)) > 1, F.max_by("item", "idx")).alias("last_item"), F.concat_ws("; ", F.transform(items, lambda x: x["item"])).alias("items"))


@query("p1_unit_validation", "uni", """
WITH r AS (SELECT video_id, idx, CASE WHEN idx % 13 = 12 THEN '"' || idx || '"' WHEN idx % 17 = 16 THEN '0' WHEN unit_no IS NULL AND idx % 4 <> 3 THEN '1' ELSE CAST(unit_no AS VARCHAR) END AS u, CASE WHEN idx % 11 = 10 THEN NULL WHEN idx % 9 = 8 THEN '5' WHEN idx % 10 = 9 THEN '"  "' ELSE '"' || title || '"' END AS t FROM uni),
m AS (SELECT video_id, idx, CASE WHEN u IS NULL THEN 'Unit at index ' || idx || ' is missing ''UnitNo''' WHEN t IS NULL THEN 'Unit at index ' || idx || ' is missing ''Title'''
 WHEN u[1] = '"' THEN 'Unit at index ' || idx || ': ''UnitNo'' must be an integer (got str)' WHEN t = '5' THEN 'Unit at index ' || idx || ': ''Title'' must be a string (got int)'
 WHEN CAST(u AS INT) < 1 THEN 'Unit at index ' || idx || ': ''UnitNo'' must be positive (got ' || u || ')' WHEN t = '"  "' THEN 'Unit at index ' || idx || ': ''Title'' cannot be empty' END AS msg FROM r)
SELECT video_id, count(msg) = 0 AS ok, arg_min(msg, idx) FILTER (WHERE msg IS NOT NULL) AS message FROM m GROUP BY 1""")
def p1(t):
    i = F.col("idx")
    u = F.when(i % 13 == 12, F.concat(F.lit('"'), i, F.lit('"'))).when(i % 17 == 16, "0").when(F.col("unit_no").isNull() & (i % 4 != 3), "1").otherwise(F.col("unit_no").cast("string"))
    title = F.when(i % 11 == 10, F.lit(None).cast("string")).when(i % 9 == 8, "5").when(i % 10 == 9, '"  "').otherwise(F.concat(F.lit('"'), "title", F.lit('"')))
    rows = t.uni.select("video_id", "idx", u.alias("unit_json"), title.alias("title_json"))
    return un.validate_units(rows)


@query("p17_attribute_projection", "", """
SELECT CAST(d.doc_id AS VARCHAR) AS video_id, split_part(text, chr(10), 1) AS title, lang AS channel_id, n_chars AS view_count, 'https://www.youtube.com/watch?v=' || d.doc_id AS link,
  left(CAST(d.doc_id AS VARCHAR), 2) || '/' || d.doc_id || '.mp4' AS path, len(string_split(text, chr(10))) AS n_labels, p.url AS description FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def p17(t):
    vid = F.col("doc_id").cast("string")
    pages = t.read("pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("description"))
    lines = F.split("text", "\n")
    return t.documents.join(pages, "doc_id", "left").select(
        vid.alias("video_id"), lines[0].alias("title"), F.col("lang").alias("channel_id"), F.col("n_chars").alias("view_count"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), vid).alias("link"), F.concat(F.substring(vid, 1, 2), F.lit("/"), vid, F.lit(".mp4")).alias("path"),
        F.size(lines).cast("long").alias("n_labels"), "description")


@query("s13_manifest_upsert", "man", """
WITH o AS (SELECT team_id, video_id, -1 AS version, n_chars AS chars, has_chunks AS f FROM man JOIN documents ON CAST(doc_id AS VARCHAR) = video_id),
n AS (SELECT source, CASE WHEN doc_id % 5 < 2 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '-new' END, v, n_chars + v, false FROM documents, range(3) AS r(v) WHERE v <= doc_id % 3),
l AS (SELECT team_id, video_id, max({'v': version, 'c': chars, 'f': f}) AS r FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1, 2),
g AS (SELECT DISTINCT source AS team_id, CAST(doc_id AS VARCHAR) AS video_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT l.team_id, l.video_id, r.c AS chars, r.f OR g.video_id IS NOT NULL AS has_chunks, r.f OR g.video_id IS NOT NULL AS has_embeddings FROM l LEFT JOIN g USING (team_id, video_id)""")
def s13(t):
    vid = F.col("doc_id").cast("string").alias("video_id")
    docs = t.documents.select("doc_id", F.col("source").alias("team_id"), vid, "n_chars")
    old = t.man.join(docs.select("team_id", "video_id", "doc_id", "n_chars"), ["team_id", "video_id"]).select(
        "team_id", "video_id", F.col("n_chars").alias("chars"), "has_chunks", F.col("has_chunks").alias("has_embeddings"))
    versions = F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3))
    own = F.when(F.col("doc_id") % 5 < 2, F.col("video_id")).otherwise(F.concat("video_id", F.lit("-new"))).alias("video_id")
    new = docs.select("team_id", own, "n_chars", versions.alias("version")).select(
        "team_id", "video_id", "version", (F.col("n_chars") + F.col("version")).alias("chars"))
    flags = docs.join(t.read("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return mf.upsert(old, new, flags)


@query("s16_source_preference", "seg lin", f"""
WITH c AS (SELECT CAST(page_id AS VARCHAR) AS video_id, 0 AS r, 'raw' AS source, i AS pos, l AS line FROM (SELECT page_id, unnest(range(len(p))) AS i, unnest(p) AS l FROM (SELECT page_id, string_split(CASE WHEN page_id % 3 = 0 THEN html ELSE ' ' END, chr(10)) AS p FROM pages))
 UNION ALL SELECT video_id, 1, 'segments', seg_idx, {HMS_SQL.format('start_s')} || ': ' || {TRIM_SQL.format('text')} FROM seg WHERE {TRIM_SQL.format('text')} <> ''
 UNION ALL SELECT video_id, 2, 'plain', line_no, text FROM lin),
b AS (SELECT video_id, min(r) AS r FROM c WHERE trim(line) <> '' GROUP BY 1)
SELECT video_id, source, pos, md5(line) AS line_md5 FROM c SEMI JOIN b USING (video_id, r)""")
def s16(t):
    """Raw text first, then a transcript rebuilt from segments, then plain text; line by line."""
    pages = t.read("pages").select(F.col("page_id").cast("string").alias("video_id"), F.posexplode(F.split(F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(" "), "\n")).alias("pos", "line"))
    raw = pages.select("video_id", F.col("pos").cast("long").alias("pos"), "line")
    body = tx.strip(F.col("text"))
    segs = t.seg.where(body != "").select("video_id", F.col("seg_idx").alias("pos"), F.concat(tf.sec_to_hms(F.col("start_s")), F.lit(": "), body).alias("line"))
    plain = t.lin.select("video_id", F.col("line_no").cast("long").alias("pos"), F.col("text").alias("line"))
    return mf.first_existing([("raw", raw), ("segments", segs), ("plain", plain)], "video_id").select("video_id", "source", "pos", F.md5("line").alias("line_md5"))


@query("s18_payload_conversion", "seg", """
SELECT video_id, seg_idx, coalesce(TRY_CAST(CASE WHEN seg_idx % 5 = 4 THEN 'n/a' ELSE CAST(start_s AS VARCHAR) END AS DOUBLE), 0) AS start_s, end_s, text FROM seg""")
def s18(t):
    raw = t.seg.select("video_id", "seg_idx", F.when(F.col("seg_idx") % 5 == 4, "n/a").otherwise(F.col("start_s").cast("string")).alias("start"), F.col("end_s").cast("string").alias("end"), "text")
    payload = raw.select("video_id", "seg_idx", F.named_struct(F.lit("start"), mf.safe_double(F.col("start")), F.lit("end"), mf.safe_double(F.col("end")), F.lit("text"), F.col("text").cast("string")).alias("seg"))
    return payload.select("video_id", "seg_idx", F.col("seg.start").alias("start_s"), F.col("seg.end").alias("end_s"), "seg.text")


@query("j14_topic_assignment", "", r"""
WITH w AS (SELECT lower(x) AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) AS x FROM documents)),
tp AS (SELECT w AS topic, row_number() OVER (ORDER BY count(*) DESC, w) AS p FROM w GROUP BY w ORDER BY p LIMIT 11),
tt AS (SELECT * FROM tp UNION ALL SELECT (SELECT topic FROM tp WHERE p = 1) || ' ' || (SELECT topic FROM tp WHERE p = 2), 12),
d AS (SELECT doc_id, lower(text) AS c FROM documents),
s AS (SELECT doc_id, topic, p, (length(c) - length(replace(c, topic, ''))) // length(topic) AS hits, length(topic) * 0.1::DOUBLE AS lb, instr(c, topic) AS at_pos,
  list_sum([(length(c) - length(replace(c, q, ''))) // length(q) FOR q IN string_split(topic, ' ')]) / len(string_split(topic, ' '))::DOUBLE AS part FROM d, tt),
v AS (SELECT *, hits * 2.0::DOUBLE + part + lb + CASE WHEN at_pos > 0 THEN 10.0::DOUBLE / at_pos ELSE 0 END AS score, hits * length(topic) AS simple FROM s)
SELECT doc_id, round(max(score), 9) AS best_score, CASE WHEN max(score) > 15 THEN arg_min(topic, {'s': -score, 'p': p}) END AS topic,
  CASE WHEN max(simple) > 10 THEN arg_min(topic, {'s': -simple, 'p': p}) END AS simple_topic FROM v GROUP BY 1""")
def j14(t):
    """Topics: the 11 most frequent words of all documents, and the first two as one phrase; always 12 rows."""
    from cuewise.operators.keywords import corpus_topics, assign_topics

    return assign_topics(t.documents.select("doc_id", "text"), corpus_topics(t.documents.select("text"), 11))
