"""Text cleaning, statistics, filters, keywords, samples and joined text streams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuewise.functions import text as tx
from cuewise.functions import timefmt as tf
from cuewise.operators import chapters as ch
from cuewise.operators import textrows as tr
from cuewise.operators import windows as wi
from cuewise.operators.barrier import once
from cuewise.operators.keywords import HAN2_OR_WORD4, top_lists, top_words, words
from cuewise.plans.registry import query
from cuewise.plans.timebase import HAN_TABLE, HMS_SQL, PTOK_SQL, TRIM_SQL
from cuewise.session import checkpointed

W = r"[\p{L}\p{N}_]"
STRIP = TRIM_SQL.format


def quoted(items):
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


@query("p2_required_keys", "", """
WITH r AS (SELECT conv_id, turn, ['QuestionId'] || CASE WHEN turn % 3 <> 1 THEN ['QuestionText'] ELSE [] END || ['Options'] || CASE WHEN turn % 4 <> 2 THEN ['CorrectAnswer', 'Explanation'] ELSE [] END || ['Tags'] || CASE WHEN role <> 'user' THEN ['Difficulty'] ELSE [] END AS k FROM conversations)
SELECT conv_id, turn, len(k) = 7 AS ok, array_to_string(list_sort([x FOR x IN ['QuestionId','QuestionText','Options','CorrectAnswer','Explanation','Tags','Difficulty'] IF NOT list_contains(k, x)]), ',') AS missing FROM r""")
def p2(t):
    """Required keys of question records, read from their JSON text."""
    c = t.read("conversations")
    v = lambda cond, name: F.when(cond, F.col("text")).alias(name)
    yes = F.lit(True)
    record = F.to_json(F.struct(v(yes, "QuestionId"), v(F.col("turn") % 3 != 1, "QuestionText"), v(yes, "Options"), v(F.col("turn") % 4 != 2, "CorrectAnswer"), v(F.col("turn") % 4 != 2, "Explanation"), v(yes, "Tags"), v(F.col("role") != "user", "Difficulty")))
    from cuewise.functions.jsontext import missing_keys

    missing = missing_keys(record)
    return c.select("conv_id", "turn", (F.size(missing) == 0).alias("ok"), F.array_join(F.array_sort(missing), ",").alias("missing"))


SLIDE_SQL = "sl AS (SELECT video_id, line_no, start_s, CASE WHEN line_no % 9 = 5 THEN ' 助教 ' ELSE text END AS text, CASE WHEN line_no % 4 = 0 THEN 'cap' ELSE ' ' END AS caption, line_no % 7 = 0 AS topics, max(start_s) OVER (PARTITION BY video_id) + 15 AS dur FROM lin)"


@query("p4_slide_segment_filter", "lin", f"""WITH {SLIDE_SQL}
SELECT video_id, line_no, start_s BETWEEN 30 AND dur - 45 AS inside FROM sl WHERE NOT regexp_full_match({STRIP('text')}, '新竹小幫手|老師|助教') AND NOT (length({STRIP('text')}) < 30 AND trim(caption) = '' AND NOT topics)""")
def p4(t):
    """Blacklist and short-text rule; `inside` marks rows the optional head and tail trim would keep."""
    dur = t.lin.groupBy("video_id").agg((F.max("start_s") + 15).alias("dur"))
    n = F.col("line_no")
    sl = t.lin.join(dur, "video_id").select("video_id", "line_no", "start_s", "dur", F.when(n % 9 == 5, " 助教 ").otherwise(F.col("text")).alias("text"),
                                            F.when(n % 4 == 0, "cap").otherwise(" ").alias("caption"), F.when(n % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("topics"))
    return ch.slide_filter(sl).select("video_id", "line_no", ((F.col("start_s") >= 30) & (F.col("start_s") <= F.col("dur") - 45)).alias("inside"))


@query("p5_denylist_first_occurrence", "lin", f"""
SELECT video_id, x AS text, min(line_no) AS line_no FROM (SELECT video_id, line_no, {STRIP("CASE WHEN line_no % 11 = 3 THEN ' Settings ' ELSE text END")} AS x FROM lin) WHERE length(x) >= 2 AND lower(x) NOT IN {quoted(tx.LINE_DENYLIST)} GROUP BY 1, 2""")
def p5(t):
    lines = t.lin.withColumn("text", F.when(F.col("line_no") % 11 == 3, " Settings ").otherwise(F.col("text")))
    return tr.first_occurrences(lines).select("video_id", "text", F.col("line_no").cast("long").alias("line_no"))


ENT_SQL = "(SELECT -sum(c / n * log2(c / n + 1e-12::DOUBLE)) FROM (SELECT count(*)::DOUBLE AS c, any_value(length({0}))::DOUBLE AS n FROM (SELECT unnest(string_split({0}, '')) AS q) GROUP BY q))"
TOKS = r"[x FOR x IN regexp_split_to_array({0}, '[\s\p{{Z}}]+') IF x <> '']"
CHARS_SQL = r'''regexp_replace({0}, '[^_()\[\]{{}}=:.<>+\-*/%|&!^,@''"\\]', '', 'g')'''


@query("p6_low_information_lines", "lin", rf"""
WITH pc AS (SELECT video_id, line_no, unnest(range(len(k))) AS piece, unnest(k) AS text FROM (SELECT video_id, line_no, string_split_regex(text, '[ .,]+') AS k FROM lin) UNION ALL SELECT video_id, line_no, -1, text FROM lin),
s AS (SELECT video_id, line_no, piece, CASE (line_no + piece) % 5 WHEN 1 THEN text || ' ' || text WHEN 2 THEN text || ' 12:30' WHEN 3 THEN text || ' file' ELSE text END AS t FROM pc),
c AS (SELECT t, {STRIP('t')} AS st, {TOKS.format('t')} AS tk, CASE WHEN length(t) BETWEEN 2 AND 24 THEN string_split(t, '') END AS q FROM (SELECT DISTINCT t FROM s)),
en AS (SELECT *, -list_sum(list_transform(list_distinct(q), lambda x: len(list_filter(q, lambda y: y = x)) / length(t)::DOUBLE * log2(len(list_filter(q, lambda y: y = x)) / length(t)::DOUBLE + 1e-12::DOUBLE))) AS e FROM c),
lo AS (SELECT t, CASE WHEN length(t) < 2 THEN true
 WHEN regexp_matches(st, '^(def |class |import |from |for |while |if |elif |else:|return )') OR length({CHARS_SQL.format('st')}) >= greatest(2, length(st) // 10) THEN false
 WHEN regexp_matches(t, 'https?://|{W}[\p{{L}}\p{{N}}_.-]+\.(com|org|edu|net|io|gov|tw|jp)(/|$|[^\p{{L}}\p{{N}}_])') OR regexp_matches(t, '[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+\.{W}+')
  OR regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_])\d+(\.\d+)?\s?((px|cm|mm|in|s|ms|GB|MB|KB|dpi|fps|Hz)($|[^\p{{L}}\p{{N}}_])|%[\p{{L}}\p{{N}}_])') OR regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])(\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[:：]\d{{2}}([:：]\d{{2}})?)($|[^\p{{L}}\p{{N}}_])') THEN false
 WHEN length(t) >= 25 THEN false
 WHEN len(tk) <= 1 OR 1.0::DOUBLE - len(list_distinct(tk)) / len(tk)::DOUBLE >= 0.60 THEN true WHEN e < 1.20 THEN true
 ELSE regexp_matches(lower(t), '{"|".join(tx.SCREEN_WORDS)}') END AS low FROM en)
SELECT video_id, line_no, CAST(piece AS BIGINT) AS piece, low FROM s JOIN lo USING (t)""")
def p6(t):
    """Whole lines (piece -1), and every word of them as a short line of its own."""
    parts = t.lin.select("video_id", "line_no", F.posexplode(F.split("text", "[ .,]+")).alias("piece", "text")).unionByName(t.lin.select("video_id", "line_no", F.lit(-1).alias("piece"), "text"))
    n = (F.col("line_no") + F.col("piece")) % 5
    body = (F.when(n == 1, F.concat("text", F.lit(" "), "text")).when(n == 2, F.concat("text", F.lit(" 12:30"))).when(n == 3, F.concat("text", F.lit(" file"))).otherwise(F.col("text")))
    return once(parts, t=body).select("video_id", F.col("line_no").cast("long").alias("line_no"), F.col("piece").cast("long").alias("piece"), tx.is_low_information(F.col("t")).alias("low"))


TOKEN_SQL = rf"""
tok AS (SELECT video_id, line_no, p, w, ((p * 37 + line_no * 11) % 100) / 100.0::DOUBLE AS conf, p * 60 + line_no % 7 * 5 AS x1, p * 60 + line_no % 7 * 5 + 10 * length(w) AS x2, line_no * 14 + p % 3 AS y1
  FROM (SELECT video_id, line_no, unnest(range(len(k))) AS p, unnest(k) AS w FROM (SELECT video_id, line_no, {TOKS.format('text')} AS k FROM lin)))
"""


def word_boxes(t):
    """Words of LIN as recognised tokens of a 1280 x 720 frame."""
    rows = t.lin.select("video_id", F.col("line_no").cast("long").alias("line_no"), F.posexplode(tx.tokens(F.col("text"))).alias("p", "w"))
    p, n = F.col("p").cast("long"), F.col("line_no")
    x1 = p * 60 + n % 7 * 5
    return rows.select("video_id", "line_no", p.alias("p"), "w", ((p * 37 + n * 11) % 100 / 100.0).alias("conf"), x1.alias("x1"), (x1 + 10 * F.length("w")).alias("x2"), (n * 14 + p % 3).alias("y1"))


@query("p7_token_keep_rule", "lin", rf"""WITH {TOKEN_SQL},
r AS (SELECT *, length(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) AS l FROM tok)
SELECT video_id, line_no, p, (CASE WHEN l > 0 AND a / l::DOUBLE >= 0.7 THEN conf >= 0.60 ELSE conf >= 0.75 END) AND NOT ((x1 + x2) / 2.0::DOUBLE / 1280 > 0.82) AS keep FROM r""")
def p7(t):
    center = (F.col("x1") + F.col("x2")) / 2.0
    return word_boxes(t).select("video_id", "line_no", "p", tx.keep_token(F.col("w"), F.col("conf"), center, F.lit(1280.0)).alias("keep"))


@query("p8_speech_segment_keep", "seg", rf"""
WITH s AS (SELECT video_id, seg_idx, start_s, CASE WHEN seg_idx % 6 = 5 THEN start_s ELSE end_s END AS e, CASE WHEN seg_idx % 5 = 4 THEN ' -- ok' WHEN seg_idx % 7 = 6 THEN '：啊哦' ELSE text END AS t FROM seg),
c AS (SELECT *, regexp_replace({STRIP("regexp_replace(t, '[\\s\\p{Z}]+', ' ', 'g')")}, '^[\s\p{{Z}}:：,\-–—·.。!！?？]+', '') AS k FROM s)
SELECT video_id, seg_idx, k AS text FROM c WHERE e > start_s AND k <> '' AND (length(regexp_replace(k, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) >= 2 OR length(k) >= 4)""")
def p8(t):
    i = F.col("seg_idx")
    rows = t.seg.select("video_id", "seg_idx", "start_s", F.when(i % 6 == 5, F.col("start_s")).otherwise(F.col("end_s")).alias("end_s"), F.when(i % 5 == 4, " -- ok").when(i % 7 == 6, "：啊哦").otherwise(F.col("text")).alias("text"))
    k = tx.strip_leading_junk(F.col("text"))
    return rows.where((F.col("end_s") > F.col("start_s")) & (k != "") & ((tx.count_of(k, tx.HAN) >= 2) | (F.length(k) >= 4))).select("video_id", "seg_idx", k.alias("text"))


ADMIN_TEXT_SQL = "ad AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' Join the link' WHEN 1 THEN text || ' Zoom now' || chr(10) || 'more' WHEN 2 THEN text || ' record id api' ELSE text END AS t FROM documents)"
SEP = r"(^|[^\p{L}\p{N}_])"
END = r"($|[^\p{L}\p{N}_])"


def admin_text(t):
    k = F.col("doc_id") % 5
    return t.documents.select("doc_id", F.when(k == 0, F.concat("text", F.lit(" Join the link"))).when(k == 1, F.concat("text", F.lit(" Zoom now\nmore"))).when(k == 2, F.concat("text", F.lit(" record id api"))).otherwise(F.col("text")).alias("t"))


@query("p9_admin_chatter", "", rf"""WITH {ADMIN_TEXT_SQL},
k AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+') AS w FROM ad),
m AS (SELECT *, regexp_matches(t, '(?i){SEP}(zoom|meeting id|passcode|log[\s-]?in){END}|出勤|請假|排程|課程公告|麥克風|鏡頭|連線問題|投影|錄影設定') AS hit FROM k)
SELECT doc_id, hit OR (len([x FOR x IN w IF x IN ('id','passcode','join','record','mute','unmute','link','網址')]) >= 2 AND len([x FOR x IN w IF x IN ('class','function','api','dataset','變數','函式','圖層','製圖','建模','演算法','模型')]) = 0) AS is_admin,
 md5({STRIP(r"regexp_replace(regexp_replace(regexp_replace(t, '(?i)" + SEP + r"(zoom|meeting id|passcode|log[\s-]?in)" + END + r"', '\1 \3', 'g'), '(?i)(meeting id|passcode|zoom|mute|unmute|record|join|link|網址)[^\n]*', ' ', 'g'), '[\s\p{Z}]{2,}', ' ', 'g')")}) AS scrubbed_md5 FROM m""")
def p9(t):
    return admin_text(t).select("doc_id", tx.is_admin(F.col("t")).alias("is_admin"), F.md5(tx.scrub_admin(F.col("t"))).alias("scrubbed_md5"))


@query("p12_informative_blocks", "lin", f"""
WITH g AS (SELECT video_id, line_no, length({STRIP('text')}) >= 40 AS ok FROM lin), n AS (SELECT video_id, count(*) FILTER (WHERE ok) AS g, count(*) AS a FROM g GROUP BY 1),
r AS (SELECT video_id, line_no, CASE WHEN g > 0 THEN g ELSE a END AS tot, row_number() OVER (PARTITION BY video_id ORDER BY line_no) - 1 AS i FROM g JOIN n USING (video_id) WHERE ok OR g = 0)
SELECT video_id, line_no FROM r WHERE tot <= 12 OR (i % (tot // 12) = 0 AND i // (tot // 12) < 12)""")
def p12(t):
    return tr.informative_sample(t.lin, 12).select("video_id", F.col("line_no").cast("long").alias("line_no"))


def words_sql(x, n=4):
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{{n},}}')"


TOPW_SQL = rf"""
dw AS (SELECT doc_id, w, count(*) AS n, min(i) AS p FROM (SELECT doc_id, unnest(range(len(k))) AS i, unnest(k) AS w FROM (SELECT doc_id, {words_sql('text')} AS k FROM documents)) GROUP BY 1, 2),
dt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rk FROM dw)
"""


@query("p14_relevance_filter", "lin", rf"""WITH {TOPW_SQL},
g AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, list(w) AS g FROM dt WHERE rk <= 10 GROUP BY 1),
lw AS (SELECT video_id, line_no, w, count(*) AS n, min(i) AS p FROM (SELECT video_id, line_no, unnest(range(len(k))) AS i, unnest(k) AS w FROM (SELECT video_id, line_no, {words_sql('text')} AS k FROM lin)) GROUP BY 1, 2, 3),
c AS (SELECT video_id, line_no, list(w) AS c FROM (SELECT *, row_number() OVER (PARTITION BY video_id, line_no ORDER BY n DESC, p) AS rk FROM lw) WHERE rk <= 10 GROUP BY 1, 2),
s AS (SELECT l.video_id, l.line_no, length(text) AS size, CASE WHEN g IS NULL OR c IS NULL THEN 0 ELSE least(1.0, len(list_intersect(g, c)) / len(list_distinct(g || c))::DOUBLE + CASE WHEN list_bool_or([list_bool_or([contains(y, x) OR contains(x, y) FOR x IN g]) FOR y IN c]) THEN 0.1 ELSE 0 END)::DOUBLE END AS score FROM lin l LEFT JOIN g USING (video_id) LEFT JOIN c USING (video_id, line_no)),
k AS (SELECT *, score >= 0.12 AS ok, count(*) FILTER (WHERE score >= 0.12) OVER (PARTITION BY video_id) AS k, count(*) OVER (PARTITION BY video_id) AS a, row_number() OVER (PARTITION BY video_id, score >= 0.12 ORDER BY score DESC, size DESC, line_no) AS rk FROM s)
SELECT video_id, line_no, round(score, 9) AS score FROM k WHERE ok OR (NOT ok AND rk <= 5 - k) OR greatest(k, least(5, a)) < 3""")
def p14(t):
    g = top_lists(t.documents, ["doc_id"], "text", 10).select(F.col("doc_id").cast("string").alias("video_id"), F.col("top").alias("g"))
    c = top_lists(t.lin, ["video_id", "line_no"], "text", 10).withColumnRenamed("top", "c")
    sizes = t.lin.select("video_id", "line_no", F.length("text").alias("size"))
    rows = sizes.join(c, ["video_id", "line_no"], "left").join(g, "video_id", "left")
    score = F.when(F.col("g").isNull() | F.col("c").isNull(), 0.0).otherwise(tx.relevance(F.col("g"), F.col("c")))
    blocks = once(rows, score=score).select("video_id", F.col("line_no").cast("long").alias("pos"), "score", "size")
    # two numbers a line, read three times
    return tr.relevance_filter(checkpointed(blocks), refill=5).select("video_id", F.col("pos").alias("line_no"), F.round("score", 9).alias("score"))


MADE_TITLE_SQL = "mt AS (SELECT video_id, idx, CASE WHEN idx % 12 = 6 THEN 'x' ELSE CASE idx % 6 WHEN 0 THEN '說明' WHEN 1 THEN title || ' 操作' WHEN 2 THEN 'Welcome ' || title WHEN 3 THEN repeat(title || ' ', 6) WHEN 4 THEN title || ' error' ELSE title END END AS title FROM ref)"


def made_titles(t):
    k = F.col("idx") % 6
    return t.ref.select("video_id", "idx", F.when(F.col("idx") % 12 == 6, "x").when(k == 0, "說明").when(k == 1, F.concat("title", F.lit(" 操作"))).when(k == 2, F.concat(F.lit("Welcome "), "title"))
                        .when(k == 3, F.repeat(F.concat("title", F.lit(" ")), 6)).when(k == 4, F.concat("title", F.lit(" error"))).otherwise(F.col("title")).alias("title"))


@query("p15_title_tests", "ref", rf"""WITH {MADE_TITLE_SQL},
kt AS (SELECT video_id, list(text) AS terms FROM (SELECT DISTINCT video_id, text FROM evs WHERE text <> 'signup') GROUP BY 1)
SELECT video_id, idx, regexp_matches(trim(title), '^說明$|操作|Part|Chapter') AS generic, length(title) < 2 OR regexp_matches(title, '操作|Part|Chapter') AS bare, len(regexp_extract_all(title, '{W}([\p{{L}}\p{{N}}_-]*{W})?')) <= 10 AND NOT regexp_matches(lower(title), 'slide|agenda|welcome|thanks|q\s*&\s*a|speaker') AS valid,
  len(list_intersect(terms, regexp_extract_all(lower(title), '{W}+'))) >= 1 AS covered FROM mt LEFT JOIN kt USING (video_id)""")
def p15(t):
    terms = t.evs.where("text <> 'signup'").groupBy("video_id").agg(F.collect_set("text").alias("terms"))
    title = F.col("title")
    covered = F.arrays_overlap("terms", words(F.lower(title), tx.WORD))
    return made_titles(t).join(terms, "video_id", "left").select("video_id", "idx", tx.is_generic_title(title).alias("generic"), tx.is_bare_title(title).alias("bare"), tx.is_valid_title(title).alias("valid"), covered.alias("covered"))


@query("p16_routing_predicate", "", "SELECT doc_id, len(string_split(text, chr(10))) * 60 >= 1800 AND len(string_split(text, chr(10))) * 60 <= 14400 AND length(text) >= 5000 AS multi_pass FROM documents")
def p16(t):
    d = F.size(F.split("text", "\n")) * 60
    return t.documents.select("doc_id", ch.needs_several_passes(d, F.length("text")).alias("multi_pass"))


@query("x6_repeat_token_limit", "", rf"""
WITH k AS (SELECT doc_id, unnest(range(len(k))) AS i, unnest(k) AS w FROM (SELECT doc_id, {TOKS.format('text')} AS k FROM documents)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS n FROM k)
SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS text_md5, count(*) AS tokens FROM r WHERE n <= 5 GROUP BY 1""")
def x6(t):
    return tr.limit_tokens(t.documents, "doc_id", "text").select("doc_id", F.md5("text").alias("text_md5"), F.size(tx.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("x6_repeat_phrases")
def x6_phrases(t):
    """Back-references have no SQL form in the check engine; tested with literals."""
    doubled = F.concat(F.repeat(F.concat(F.substring("text", 1, 5), F.lit(" ")), 4), "text")
    return t.documents.select("doc_id", tx.collapse_phrases(doubled).alias("text"))


@query("x7_title_cleaning", "ref", rf"""
WITH s AS (SELECT video_id, idx, CASE idx % 7 WHEN 0 THEN '那個' || title || '，。' WHEN 1 THEN '[tag ' || idx || ']  ' || title WHEN 2 THEN '單元' || idx || ' - ' || title WHEN 3 THEN '然後ab！' WHEN 4 THEN '[solo]' ELSE title || '、； ' END AS t FROM ref),
f AS (SELECT *, {"".join("replace(" for _ in tx.FILLERS)}t{"".join(f", '{w}', '')" for w in tx.FILLERS)} AS c FROM s),
g AS (SELECT *, regexp_replace(regexp_replace({STRIP('c')}, '[。，“”、！？\.!?,]+$', ''), '[\s\p{{Z}}]+', ' ', 'g') AS k, regexp_replace(regexp_replace({STRIP('c')}, '[。，、！？]+$', ''), '[\s\p{{Z}}]+', ' ', 'g') AS l FROM f),
u AS (SELECT *, CASE WHEN t[1] = '[' AND contains(t, ']') THEN trim(t[2:instr(t, ']') - 1]) || CASE WHEN trim(t[instr(t, ']') + 1:]) <> '' THEN ' - ' || trim(t[instr(t, ']') + 1:]) ELSE '' END ELSE {STRIP('t')} END AS b FROM g)
SELECT video_id, idx, CASE WHEN length(k) BETWEEN 1 AND 3 THEN {STRIP('t')} ELSE k END AS cleaned, CASE WHEN length(l) BETWEEN 1 AND 3 THEN upper(l[1]) || lower(l[2:]) ELSE l END AS legacy,
  {STRIP(r"regexp_replace(b, '^[\s\p{Z}]*單元\s*\d+\s*[-－–—:：]\s*', '')")} AS client, regexp_replace(regexp_replace({STRIP('t')}, '[\s\p{{Z}}]+', ' ', 'g'), '[，。；、\s]+$', '') AS topic FROM u""")
def x7(t):
    k, title = F.col("idx") % 7, F.col("title")
    made = (F.when(k == 0, F.concat(F.lit("那個"), title, F.lit("，。"))).when(k == 1, F.concat(F.lit("[tag "), F.col("idx"), F.lit("]  "), title)).when(k == 2, F.concat(F.lit("單元"), F.col("idx"), F.lit(" - "), title))
            .when(k == 3, "然後ab！").when(k == 4, "[solo]").otherwise(F.concat(title, F.lit("、； "))))
    rows = once(t.ref.select("video_id", "idx", "title"), t=made)
    return rows.select("video_id", "idx", tx.clean_title(F.col("t")).alias("cleaned"), tx.clean_title(F.col("t"), legacy=True).alias("legacy"), tx.client_title(F.col("t")).alias("client"), tx.topic_title(F.col("t")).alias("topic"))


@query("x8_overlay_cleaning", "", rf"""
WITH d AS (SELECT doc_id, '12:30:45 ' || text || ' 2024/1/5 on 2024-01-05, 25℃ now Google.com  end' AS t FROM documents)
SELECT doc_id, md5({STRIP(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b\d{2}:\d{2}:\d{2}\b', ' ', 'g'), '\b(?:\d{4}/\d{1,2}/\d{1,2}|202\d-\d{1,2}-\d{1,2})\b', ' ', 'g'), '[℃°]\s*\S*', ' ', 'g'), '(?:聯成電腦|Amara\.org|Google|msn)\S*', ' ', 'g'), '[\s\p{Z}]{2,}', ' ', 'g')")}) AS slide_md5,
  md5({STRIP(r"regexp_replace(t, '[\s\p{Z}]{2,}', ' ', 'g')")}) AS speech_md5 FROM d""")
def x8(t):
    d = F.concat(F.lit("12:30:45 "), "text", F.lit(" 2024/1/5 on 2024-01-05, 25℃ now Google.com  end"))
    return t.documents.select("doc_id", F.md5(tx.clean_slide_text(d, watermarks=True)).alias("slide_md5"), F.md5(tx.clean_speech_text(d)).alias("speech_md5"))


UNIQ_SQL = r"coalesce(len(list_distinct([y FOR y IN [regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') FOR x IN regexp_split_to_array({0}, '[\r\n]+')] IF y <> ''])) / nullif(len([y FOR y IN [regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') FOR x IN regexp_split_to_array({0}, '[\r\n]+')] IF y <> '']), 0)::DOUBLE, 0)"
JUNK_SQL = r"least(1.0::DOUBLE, len(regexp_extract_all({0}, '(?:\d{2}:\d{2}:\d{2})|(?:\d{4}/\d{1,2}/\d{1,2})|(?:℃)|(?:https?://\S+)')) / greatest(1, length({0}) // 120)::DOUBLE)"
CODE_SQL = rf"((regexp_matches({{0}}, '`[^`]+`'))::INT + (regexp_matches({{0}}, '(?m):\s*$'))::INT + (regexp_matches({{0}}, '{SEP}(def|class|if|else|for|while|print){END}'))::INT + (regexp_matches({{0}}, '[\{{\}}\[\]()]'))::INT + (regexp_matches({{0}}, '(?m)^\s{{2,}}\S'))::INT + (regexp_matches({{0}}, '(?m)^\s*#'))::INT) / 6.0::DOUBLE"


def code_sql(x):
    return CODE_SQL.replace("{0}", x)


def fill(s, x):
    return s.replace("{0}", x)


@query("x9_text_statistics", "", rf"""
WITH c AS (SELECT doc_id, q, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS q FROM documents) GROUP BY 1, 2),
e AS (SELECT doc_id, -sum(c / n_chars * log2(c / n_chars + 1e-12::DOUBLE)) AS e FROM c JOIN (SELECT doc_id, length(text)::DOUBLE AS n_chars FROM documents) USING (doc_id) GROUP BY 1),
k AS (SELECT doc_id, text, {TOKS.format('text')} AS tk FROM documents)
SELECT doc_id, round(coalesce(e, 0), 6) AS entropy, round(CASE WHEN len(tk) <= 1 THEN 1 ELSE 1.0::DOUBLE - len(list_distinct(tk)) / len(tk)::DOUBLE END, 6) AS repeat_ratio,
 round(coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE, 0), 6) AS ascii_ratio, length(regexp_replace(text, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS han,
 round(coalesce(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE, 0), 6) AS caps_ratio,
 round({fill(UNIQ_SQL, 'text')}, 6) AS unique_lines, round({fill(JUNK_SQL, 'text')}, 6) AS junk, round({code_sql('text')}, 6) AS code FROM k LEFT JOIN e USING (doc_id)""")
def x9(t):
    c = F.col("text")
    cols = {"entropy": tx.entropy(c), "repeat_ratio": tx.repeat_ratio(c), "ascii_ratio": tx.ascii_letter_ratio(c), "caps_ratio": tx.caps_ratio(c),
            "unique_lines": tx.unique_line_ratio(c), "junk": tx.junk_ratio(c), "code": tx.code_likeness(c)}
    return t.documents.select("doc_id", tx.count_of(c, tx.HAN).alias("han"), *[F.round(v, 6).alias(n) for n, v in cols.items()])


def qa(x):
    return f"greatest(0, least(1, 0.45::DOUBLE * least(1.0::DOUBLE, length({x}) / 2500.0::DOUBLE) + 0.25::DOUBLE * {code_sql(x)} + 0.20::DOUBLE * {fill(UNIQ_SQL, x)} - 0.20::DOUBLE * {fill(JUNK_SQL, x)}))"


def qb(x):
    u = fill(UNIQ_SQL, x)
    return f"greatest(0, least(1, 0.50::DOUBLE * least(1.0::DOUBLE, length({x}) / 3000.0::DOUBLE) + 0.25::DOUBLE * least(1.0::DOUBLE, length(regexp_replace({x}, '[^。！？.!?,，]', '', 'g')) / greatest(1, length({x}) // 120)::DOUBLE) + 0.20::DOUBLE * {u} - 0.15::DOUBLE * (1 - {u})))"


@query("x10_quality_and_weights", "", rf"""
WITH d AS (SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 3 THEN '' ELSE text END AS a, CASE WHEN d.doc_id % 7 = 2 THEN coalesce(url, '') ELSE coalesce(html, '') END AS b, (d.doc_id % 10) / 10.0::DOUBLE AS sim FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id),
q AS (SELECT *, {qa('a')} AS qa, {qb('b')} AS qb FROM d),
w AS (SELECT *, CASE WHEN a = '' AND b <> '' THEN 0.25 WHEN b = '' AND a <> '' THEN 0.75 WHEN (length(a) < 200 OR length(b) < 200) AND a <> '' AND b <> '' THEN greatest(0.25, least(0.75, qa / CASE WHEN qa + qb = 0 THEN 1 ELSE qa + qb END))
  WHEN length(a) < 200 OR length(b) < 200 THEN 0.25 ELSE least(0.75, greatest(0.25, qa * (0.5 + 0.5 * sim) / CASE WHEN (qa + qb) = 0 THEN 1 ELSE qa * (0.5 + 0.5 * sim) + qb * (0.5 + 0.5 * sim) END)) END::DOUBLE AS w, CASE WHEN length(a) < 200 OR length(b) < 200 THEN 0 ELSE sim END AS s FROM q)
SELECT doc_id, round(qa, 6) AS slide_quality, round(qb, 6) AS speech_quality, round(w, 6) AS w_slide, round(1 - w, 6) AS w_speech, round(s, 6)::DOUBLE AS sim, round(greatest(0, least(1, 0.5 * s + 0.25 * w + 0.25 * (1 - w))), 6)::DOUBLE AS fused FROM w""")
def x10(t):
    p = t.read("pages").select(F.col("page_id").alias("doc_id"), "html", "url")
    html = F.coalesce("html", F.lit(""))
    d = t.documents.join(p, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 11 == 3, "").otherwise(F.col("text")).alias("a"),
                                                     F.when(F.col("doc_id") % 7 == 2, F.coalesce("url", F.lit(""))).otherwise(html).alias("b"), (F.col("doc_id") % 10 / 10.0).alias("sim"))
    d = once(d, qa=tx.slide_quality(F.col("a")), qb=tx.speech_quality(F.col("b")))
    w, w2, s = tx.source_weights(F.col("a"), F.col("b"), F.col("sim"), F.col("qa"), F.col("qb"))
    d = once(d, w=w, w2=w2, s=s)
    fused = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.col("s") + 0.25 * F.col("w") + 0.25 * F.col("w2")))
    return d.select("doc_id", *[F.round(c, 6).alias(n) for c, n in ((F.col("qa"), "slide_quality"), (F.col("qb"), "speech_quality"), (F.col("w"), "w_slide"), (F.col("w2"), "w_speech"), (F.col("s"), "sim"), (fused, "fused"))])


WORDN = r"len(regexp_extract_all({0}, '[\p{L}\p{N}_]([\p{L}\p{N}_-]*[\p{L}\p{N}_])?'))"


def likeness_sql(x):
    caps = f"coalesce(length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')), 0)::DOUBLE, 0)"
    return (f"CASE WHEN {fill(WORDN, x)} = 0 THEN 0 ELSE greatest(0, least(1, 0.55::DOUBLE * (1 - length(regexp_replace({x}, '[^,:;.!?]', '', 'g')) / greatest(1, length({x}))::DOUBLE) + 0.35::DOUBLE * (1 - least(abs({fill(WORDN, x)} - 6) / 10.0::DOUBLE, 1))"
            f" + CASE WHEN {caps} > 0.35 THEN 0.3 ELSE 0 END::DOUBLE - CASE WHEN regexp_matches({x}, '{SEP}\\d{{1,2}}{END}') THEN 0.15 ELSE 0 END::DOUBLE)) END")


@query("x11_header_gated_fusion", "lin", rf"""
WITH s AS (SELECT video_id, line_no, {STRIP('text')} AS o, {STRIP('text')} AS a, CASE WHEN line_no % 3 = 0 THEN NULL ELSE (line_no % 10) / 10.0::DOUBLE END AS conf, line_no % 4 = 0 AS ch FROM lin),
g AS (SELECT *, 0.6::DOUBLE * ({likeness_sql('o')}) + 0.4::DOUBLE * coalesce(conf, 0.5::DOUBLE) + CASE WHEN ch THEN 0.1 ELSE 0 END::DOUBLE AS gate FROM s)
SELECT video_id, line_no, round(gate, 9) AS gate, CASE WHEN gate >= 0.65::DOUBLE THEN 'OCR_DOMINANT' ELSE 'BALANCED' END AS strategy,
  md5(CASE WHEN gate >= 0.65::DOUBLE THEN '[OCR_HEADER]' || chr(10) || o || chr(10) || chr(10) || '[ASR_SUMMARY]' || chr(10) || left(a, 500) ELSE '[OCR_TEXT]' || chr(10) || o || chr(10) || chr(10) || '[ASR_TEXT]' || chr(10) || a END) AS fused_md5 FROM g""")
def x11(t):
    n = F.col("line_no")
    rows = once(t.lin, o=F.col("text"), conf=F.when(n % 3 != 0, n % 10 / 10.0), ch=n % 4 == 0)
    rows = once(rows, like=tx.title_likeness(F.col("o")))
    fused, strategy, gate = tx.gated_fusion(F.col("o"), F.col("text"), F.col("conf"), F.col("ch"))
    return rows.select("video_id", n.cast("long").alias("line_no"), F.round(gate, 9).alias("gate"), strategy.alias("strategy"), F.md5(fused).alias("fused_md5"))


def head_sql(x, n):
    return (f"CASE WHEN length({x}) <= {n} THEN {x} ELSE coalesce(nullif((SELECT string_agg(l, chr(10) ORDER BY i) FROM (SELECT i, l, sum(length(l) + 1) OVER (ORDER BY i) AS r FROM (SELECT unnest(range(len(string_split({x}, chr(10))))) AS i, unnest(string_split({x}, chr(10))) AS l)) WHERE r <= {n}), ''), left({x}, {n})) END")


@query("x12_budgeted_fusion", "", rf"""
WITH d AS (SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 4 THEN ' ' ELSE text END AS a, coalesce(html, '') AS b, 0.25::DOUBLE + (d.doc_id % 5) / 10.0::DOUBLE AS w FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id),
s AS (SELECT *, CASE WHEN trim(a) <> '' AND trim(b) <> '' THEN greatest(0.3::DOUBLE, w) / (greatest(0.3::DOUBLE, w) + greatest(0.3::DOUBLE, 1 - w)) WHEN trim(a) <> '' THEN 1.0 WHEN trim(b) <> '' THEN 0.0 ELSE 0.5 END::DOUBLE AS sa,
  CASE WHEN trim(a) <> '' AND trim(b) <> '' THEN greatest(0.3::DOUBLE, 1 - w) / (greatest(0.3::DOUBLE, w) + greatest(0.3::DOUBLE, 1 - w)) WHEN trim(a) <> '' THEN 0.0 WHEN trim(b) <> '' THEN 1.0 ELSE 0.5 END::DOUBLE AS sb FROM d),
n AS (SELECT *, CAST(floor(1200 * sa) AS BIGINT) AS na, CAST(floor(1200 * sb) AS BIGINT) AS nb FROM s)
SELECT doc_id, md5({head_sql('a', 'na')}) AS slide_md5, md5({head_sql('b', 'nb')}) AS speech_md5, na AS slide_budget, nb AS speech_budget FROM n""")
def x12(t):
    p = t.read("pages").select(F.col("page_id").alias("doc_id"), "html")
    d = t.documents.join(p, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 9 == 4, " ").otherwise(F.col("text")).alias("a"), F.coalesce("html", F.lit("")).alias("b"), (0.25 + F.col("doc_id") % 5 / 10.0).alias("w"))
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    na, nb = tx.shares(a, b, w, 1.0 - w, 400 * 3)
    d = once(d, na=na, nb=nb)
    return d.select("doc_id", F.md5(tx.head_lines(a, F.col("na"))).alias("slide_md5"), F.md5(tx.head_lines(b, F.col("nb"))).alias("speech_md5"), F.col("na").alias("slide_budget"), F.col("nb").alias("speech_budget"))


BIG = "list_distinct([substr({0}, i, 2) FOR i IN range(1, greatest(length({0}), 1))])"


@query("x13_text_similarities", "lin", rf"""
WITH n AS (SELECT video_id, line_no, text, coalesce(lead(text) OVER (PARTITION BY video_id ORDER BY line_no), '') AS then FROM lin),
d AS (SELECT video_id, line_no, {STRIP('text')} AS a, {STRIP('"then"')} AS b FROM n),
h AS (SELECT *, translate(a, '{HAN_TABLE[0]}', '{HAN_TABLE[1]}') AS ha, translate(b, '{HAN_TABLE[0]}', '{HAN_TABLE[1]}') AS hb FROM d),
k AS (SELECT *, list_distinct({TOKS.format('a')}) AS ta, list_distinct({TOKS.format('b')}) AS tb, {BIG.format('ha')} AS ga, {BIG.format('hb')} AS gb, list_distinct({words_sql('a')}) AS wa, list_distinct({words_sql('b')}) AS wb FROM h)
SELECT video_id, line_no, round(coalesce(len(list_intersect(ta, tb)) / nullif(len(list_distinct(ta || tb)), 0)::DOUBLE, 0), 9) AS token_jaccard,
  round(CASE WHEN regexp_matches(ha || hb, '[\x{{3400}}-\x{{9fff}}]') THEN coalesce(len(list_intersect(ga, gb)) / nullif(len(list_distinct(ga || gb)), 0)::DOUBLE, 0) ELSE coalesce(len(list_intersect(ta, tb)) / nullif(len(list_distinct(ta || tb)), 0)::DOUBLE, 0) END, 9) AS han_jaccard,
  round(CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE least(1.0, len(list_intersect(wa, wb)) / len(list_distinct(wa || wb))::DOUBLE + CASE WHEN list_bool_or([list_bool_or([contains(y, x) OR contains(x, y) FOR x IN wa]) FOR y IN wb]) THEN 0.1 ELSE 0 END)::DOUBLE END, 9) AS relevance FROM k""")
def x13(t):
    """Each line of a document with the next one."""
    then = F.coalesce(F.lead("text").over(Window.partitionBy("video_id").orderBy("line_no")), F.lit(""))
    pairs = t.lin.select("video_id", F.col("line_no").cast("long").alias("line_no"), "text", then.alias("then"))
    a, b = tx.strip(F.col("text")), tx.strip(F.col("then"))
    d = once(pairs, a=a, b=b, ha=F.translate(a, *HAN_TABLE), hb=F.translate(b, *HAN_TABLE))
    d = once(d, wa=words(F.lower("a")), wb=words(F.lower("b")))
    return d.select("video_id", "line_no", F.round(tx.text_jaccard(F.col("a"), F.col("b")), 9).alias("token_jaccard"), F.round(tx.text_jaccard(F.col("ha"), F.col("hb")), 9).alias("han_jaccard"), F.round(tx.relevance(F.col("wa"), F.col("wb")), 9).alias("relevance"))


P = "[?？!！、,…．。]"


@query("x14_line_normalisation", "lin", rf"""
WITH s AS (SELECT video_id, line_no, CASE line_no % 3 WHEN 0 THEN '-- ' || text || '??!' WHEN 1 THEN '：' || text || '、、  x' ELSE text END AS t FROM lin)
SELECT video_id, line_no, md5({STRIP(rf"regexp_replace(regexp_replace(regexp_replace(t, '({P}){P}+', '\1', 'g'), '[\s\p{{Z}}]{{2,}}', ' ', 'g'), '^[ \t\-–—]+|[ \t\-–—]+$', '', 'g')")}) AS normal_md5,
  regexp_matches(t, '[。．！!？?：:；;」”\.,\)]\s*$') AS ends_sentence, md5(regexp_replace({STRIP("regexp_replace(t, '[\\s\\p{Z}]+', ' ', 'g')")}, '^[\s\p{{Z}}:：,\-–—·.。!！?？]+', '')) AS junk_md5, md5(regexp_replace(t, '[^\x00-\x7f]', ' ', 'g')) AS ascii_md5 FROM s""")
def x14(t):
    k = F.col("line_no") % 3
    made = F.when(k == 0, F.concat(F.lit("-- "), "text", F.lit("??!"))).when(k == 1, F.concat(F.lit("："), "text", F.lit("、、  x"))).otherwise(F.col("text"))
    s = once(t.lin, t=made)
    c = F.col("t")
    return s.select("video_id", F.col("line_no").cast("long").alias("line_no"), F.md5(tx.normalize_line(c)).alias("normal_md5"), tx.ends_sentence(c).alias("ends_sentence"), F.md5(tx.strip_leading_junk(c)).alias("junk_md5"), F.md5(tx.ascii_only(c)).alias("ascii_md5"))


@query("x21_script_mapping", "", f"""
SELECT doc_id, md5(translate(translate(text, 'aeiou', '体台后广画'), '{tx.SIMPLIFIED}', '{tx.TRADITIONAL}')) AS text_md5, translate(translate(lang || '|' || source, 'sr', '书网'), '书网', '書網') AS nested FROM documents""")
def x21(t):
    """Plain text, and values nested in an array and a map."""
    simple = F.translate("text", "aeiou", "体台后广画")
    arr = F.transform(F.array("lang", "source"), lambda x: tx.to_traditional(F.translate(x, "sr", "书网")))
    m = F.transform_values(F.create_map(F.lit("v"), F.array_join(arr, "|")), lambda k, v: tx.to_traditional(v))
    return t.documents.select("doc_id", F.md5(tx.to_traditional(simple)).alias("text_md5"), m["v"].alias("nested"))


@query("x22_content_keys", "", """
SELECT doc_id, md5(text || lang || CAST(n_chars AS DOUBLE)) AS content_md5, sha256(text) AS sha256, left(sha1(text), 16) AS short_hash, '20240101_000000_' || left(md5(source), 8) || '_doc' || doc_id || '.txt' AS unique_name, source || '_' || doc_id || '_ch0_0' AS record_id FROM documents""")
def x22(t):
    name = F.concat(F.lit("20240101_000000_"), F.substring(F.md5("source"), 1, 8), F.lit("_doc"), "doc_id", F.lit(".txt"))
    return t.documents.select("doc_id", F.md5(F.concat("text", "lang", F.col("n_chars").cast("double").cast("string"))).alias("content_md5"), F.sha2("text", 256).alias("sha256"),
                              F.substring(F.sha1("text"), 1, 16).alias("short_hash"), name.alias("unique_name"), F.concat_ws("_", "source", "doc_id", F.lit("ch0_0")).alias("record_id"))


@query("a11_keyword_frequency", "", rf"""WITH {TOPW_SQL},
hw AS (SELECT doc_id, w, count(*) AS n, min(i) AS p FROM (SELECT doc_id, unnest(range(len(k))) AS i, unnest(k) AS w FROM (SELECT doc_id, [x FOR x IN regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') IF regexp_full_match(x, '[a-zA-Z0-9_]{{4,}}')] AS k FROM documents)) GROUP BY 1, 2)
SELECT 'word4' AS kind, doc_id, rk AS rank, w AS word, n FROM dt WHERE rk <= 5
UNION ALL SELECT 'han2_or_word4', doc_id, rk, w, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rk FROM hw) WHERE rk <= 5""")
def a11(t):
    a = top_words(t.documents, ["doc_id"], "text", 5).select(F.lit("word4").alias("kind"), "doc_id", F.col("rank").cast("long").alias("rank"), "word", "n")
    b = top_words(t.documents, ["doc_id"], "text", 5, HAN2_OR_WORD4, lower=False).select(F.lit("han2_or_word4").alias("kind"), "doc_id", F.col("rank").cast("long").alias("rank"), "word", "n")
    return a.unionByName(b)


@query("a12_topic_seeds", "lin seg", rf"""
WITH lw AS (SELECT video_id, line_no, w, count(*) AS n, min(i) AS p FROM (SELECT video_id, line_no, unnest(range(len(k))) AS i, unnest(k) AS w FROM (SELECT video_id, line_no, {words_sql('text')} AS k FROM lin)) GROUP BY 1, 2, 3),
l3 AS (SELECT video_id, 0 AS src, line_no AS a, rk AS b, w FROM (SELECT *, row_number() OVER (PARTITION BY video_id, line_no ORDER BY n DESC, p) AS rk FROM lw) WHERE rk <= 3),
sw AS (SELECT video_id, w, count(*) AS n, min(seg_idx * 1000000 + i) AS p FROM (SELECT video_id, seg_idx, unnest(range(len(k))) AS i, unnest(k) AS w FROM (SELECT video_id, seg_idx, {words_sql('text', 5)} AS k FROM seg)) GROUP BY 1, 2),
s12 AS (SELECT video_id, 1 AS src, rk AS a, 0 AS b, w FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, p) AS rk FROM sw) WHERE rk <= 12),
f AS (SELECT video_id, w, min([src, a, b]) AS o FROM (SELECT * FROM l3 UNION ALL SELECT * FROM s12) GROUP BY 1, 2),
pd AS (SELECT video_id, w, [2, a, 0] AS o FROM (SELECT DISTINCT video_id FROM lin), (VALUES (0, 'chart'), (1, 'graph'), (2, 'diagram'), (3, 'code editor'), (4, 'terminal'), (5, 'equation'), (6, 'table')) AS v(a, w)),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY o) AS place FROM (SELECT * FROM f UNION ALL SELECT * FROM pd)) SELECT video_id, place, w AS word FROM r WHERE place <= 12""")
def a12(t):
    return tr.topic_seeds(t.lin, t.seg, 12)


@query("a17_tfidf_vectors", "lin", r"""
WITH k AS (SELECT video_id, line_no, [y FOR y IN [regexp_extract(x, '[a-zA-Z0-9_]{3,}$') FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')] IF y <> ''] AS k FROM lin),
tf AS (SELECT video_id, line_no, w, count(*) AS tf FROM (SELECT video_id, line_no, unnest(k) AS w FROM k) GROUP BY ALL), df AS (SELECT video_id, w, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT video_id, count(*) AS n FROM lin GROUP BY 1),
x AS (SELECT tf.*, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN df USING (video_id, w) JOIN n USING (video_id)), nm AS (SELECT video_id, line_no, sqrt(sum(x * x)) AS nm FROM x GROUP BY ALL)
SELECT video_id, line_no, w AS word, round(x / nm, 6) AS weight FROM x JOIN nm USING (video_id, line_no)""")
def a17(t):
    return tr.tfidf(t.lin).select("video_id", F.col("line_no").cast("long").alias("line_no"), "word", F.round("weight", 6).alias("weight"))


def scrub_sql(x):
    inner = x
    for p in (rf"(?i){SEP}(zoom|meeting id|passcode|log[\s-]?in){END}",):
        inner = rf"regexp_replace({inner}, '{p}', '\1 \3', 'g')"
    return STRIP(rf"regexp_replace(regexp_replace({inner}, '(?i)(meeting id|passcode|zoom|mute|unmute|record|join|link|網址)[^\n]*', ' ', 'g'), '[\s\p{{Z}}]{{2,}}', ' ', 'g')")


SLIDE_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\b\d{2}:\d{2}:\d{2}\b', ' ', 'g'), '\b(?:\d{4}/\d{1,2}/\d{1,2}|202\d-\d{1,2}-\d{1,2})\b', ' ', 'g'), '[℃°]\s*\S*', ' ', 'g'), '(?:聯成電腦|Amara\.org|Google|msn)\S*', ' ', 'g'), '[\s\p{Z}]{2,}', ' ', 'g')"
SPEECH_CLEAN = r"regexp_replace({0}, '[\s\p{Z}]{2,}', ' ', 'g')"


@query("a19_global_corpus", "lin seg", f"""
WITH a AS (SELECT video_id, string_agg({STRIP('text')}, chr(10) ORDER BY line_no) AS a FROM lin GROUP BY 1), b AS (SELECT video_id, string_agg({STRIP('text')}, chr(10) ORDER BY seg_idx) AS b FROM seg GROUP BY 1),
c AS (SELECT video_id, '【Slides(OCR)】' || chr(10) || {STRIP(fill(SLIDE_CLEAN, "coalesce(a, '')"))} || chr(10) || chr(10) || '【Audio(ASR)】' || chr(10) || {STRIP(fill(SPEECH_CLEAN, "coalesce(b, '')"))} AS t FROM a FULL JOIN b USING (video_id))
SELECT video_id, md5(left({scrub_sql('t')}, 3000)) AS text_md5, length(left({scrub_sql('t')}, 3000)) AS chars FROM c""")
def a19(t):
    lines = t.lin.select("video_id", F.col("line_no").cast("long").alias("pos"), "text")
    speech = t.seg.select("video_id", F.col("seg_idx").alias("pos"), "text")
    return tr.capped_corpus(lines, speech, 3000).select("video_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


@query("w7_sentence_prefix", "", f"""
WITH p AS (SELECT doc_id, unnest(range(len(k))) AS i, unnest(k) AS s FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$') AS k FROM documents)),
r AS (SELECT *, sum({PTOK_SQL.format('s')}) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p), c AS (SELECT doc_id, string_agg(s, '' ORDER BY i) FILTER (WHERE run <= 120) AS cut FROM r GROUP BY 1)
SELECT d.doc_id, md5(CASE WHEN {PTOK_SQL.format('text')} <= 120 THEN text ELSE coalesce(cut, '') END) AS text_md5 FROM documents d LEFT JOIN c USING (doc_id)""")
def w7(t):
    return t.documents.select("doc_id", F.md5(tx.budget_prefix(F.col("text"), 120)).alias("text_md5"))


@query("w8_bucket_representatives", "ref", """
WITH k AS (SELECT *, greatest(1, duration // 8) AS len, duration // 8 AS leg FROM ref),
b AS (SELECT *, least(start_s // len, 7) AS b, start_s // leg AS lb FROM k),
c AS (SELECT *, abs(start_s - (b * len + CASE WHEN b < 7 THEN (b + 1) * len ELSE duration + 1 END) // 2) AS off FROM b)
SELECT 'current' AS variant, video_id, b AS bucket, idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, b ORDER BY off, start_s) AS rn FROM c) WHERE rn = 1
UNION ALL SELECT 'legacy', video_id, lb, idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, lb ORDER BY start_s) AS rn FROM c WHERE lb < 8) WHERE rn = 1""")
def w8(t):
    rows = t.ref.select("video_id", "idx", "start_s", "duration")
    cur = ch.bucket_representatives(rows, F.lit(8)).select(F.lit("current").alias("variant"), "video_id", "bucket", "idx")
    return cur.unionByName(ch.bucket_representatives(rows, F.lit(8), legacy=True).select(F.lit("legacy").alias("variant"), "video_id", "bucket", "idx"))


@query("t2_first_chapters_as_units", "ref", r"""
WITH s AS (SELECT video_id, idx, start_s, CASE idx % 3 WHEN 0 THEN '[單元' || idx || '：x] ' || title WHEN 1 THEN '[tag]' || repeat(title, 8) ELSE title END AS t FROM ref WHERE idx < 5),
c AS (SELECT *, trim(regexp_replace(regexp_replace(t, '^\[單元\d+[：:][^\]]+\]\s*', ''), '^\[.*?\]\s*', '')) AS c FROM s)
SELECT video_id, idx + 1 AS unit_no, CASE WHEN length(c) > 50 THEN left(c, 47) || '...' ELSE c END AS title, printf('%02d:%02d:%02d', start_s // 3600, start_s % 3600 // 60, start_s % 60) AS time FROM c""")
def t2(t):
    k = F.col("idx") % 3
    made = F.when(k == 0, F.concat(F.lit("[單元"), "idx", F.lit("：x] "), "title")).when(k == 1, F.concat(F.lit("[tag]"), F.repeat("title", 8))).otherwise(F.col("title"))
    return ch.first_units(t.ref.withColumn("title", made), 5).select("video_id", "unit_no", "title", "time")


@query("t4_longest_blocks", "ref", """
SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS place FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY end_s - start_s DESC, start_s) AS rn FROM ref) WHERE rn <= 5""")
def t4(t):
    best = wi.top_rows(t.ref.select("video_id", "idx", "start_s", "end_s"), ["video_id"], [F.desc(F.col("end_s") - F.col("start_s")), F.asc("start_s")], 5)
    return best.select("video_id", "idx", F.row_number().over(Window.partitionBy("video_id").orderBy("start_s")).cast("long").alias("place"))


@query("t5_random_sample", "", "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 25")
def t5(t):
    """Sample of a fixed size, repeatable for a seed; the order is a hash, so no sort by random values."""
    return t.documents.select("doc_id", F.md5(F.concat("doc_id", F.lit(":42"))).alias("h")).orderBy("h", "doc_id").limit(25).select("doc_id")


def streams(t):
    asr = t.seg.select("video_id", F.col("start_s").cast("long").alias("sec"), F.col("seg_idx").alias("pos"), "text")
    cap = t.evs.select("video_id", F.floor("start_s").alias("sec"), F.col("event_id").alias("pos"), "text")
    frame = t.pred.select("video_id", F.col("start_s").alias("sec"), F.col("idx").cast("long").alias("pos"), F.when(F.col("idx") % 3 == 0, "image").otherwise(F.col("title")).alias("text"))
    return asr, cap, frame


STREAM_SQL = """
a AS (SELECT video_id, CAST(start_s AS BIGINT) AS sec, 0 AS r, seg_idx AS pos, 'ASR ' AS p, text FROM seg), c AS (SELECT video_id, CAST(floor(start_s) AS BIGINT) AS sec, 1 AS r, event_id AS pos, 'Caption ' AS p, text FROM evs),
f AS (SELECT video_id, start_s AS sec, 2 AS r, idx AS pos, 'Frame ' AS p, title AS text FROM pred WHERE idx % 3 <> 0)
"""


@query("u1_interleave_streams", "seg pred", f"""WITH {STREAM_SQL}
SELECT 'two' AS form, video_id, row_number() OVER (PARTITION BY video_id ORDER BY sec, r, pos) AS place, p || {HMS_SQL.format('sec')} || ': ' || text AS line FROM (SELECT * FROM a UNION ALL SELECT * FROM c)
UNION ALL SELECT 'three', video_id, row_number() OVER (PARTITION BY video_id ORDER BY sec, r, pos), p || {HMS_SQL.format('sec')} || ': ' || text FROM (SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * FROM f)""")
def u1(t):
    asr, cap, frame = streams(t)
    two = tr.interleave([("ASR ", asr), ("Caption ", cap)]).select(F.lit("two").alias("form"), "video_id", F.col("place").cast("long").alias("place"), "line")
    three = tr.interleave([("ASR ", asr), ("Caption ", cap), ("Frame ", frame)], drop_image_frames=True).select(F.lit("three").alias("form"), "video_id", F.col("place").cast("long").alias("place"), "line")
    return two.unionByName(three)


STACK_SQL = """
a AS (SELECT video_id, seg_idx AS pos, text AS line FROM seg), c AS (SELECT video_id, event_id AS pos, text AS line FROM evs), ha AS (SELECT DISTINCT video_id FROM a), hc AS (SELECT DISTINCT video_id FROM c)
"""


def stack_sql(form, h1, h2):
    return f"""SELECT '{form}' AS form, video_id, 0 AS section, pos, line FROM a UNION ALL SELECT '{form}', video_id, 0, -1, '{h1}' FROM ha
UNION ALL SELECT '{form}', video_id, 1, pos, line FROM c UNION ALL SELECT '{form}', video_id, 1, -1, '{h2}' FROM hc SEMI JOIN ha USING (video_id)"""


@query("u2_block_concatenation", "seg dur", f"WITH {STACK_SQL} {stack_sql('asr+captions', 'ASR transcript:', 'Captions:')} UNION ALL {stack_sql('captions+asr', 'Captions:', 'ASR transcript:')}")
def u2(t):
    """The second form is called with its arguments in (speech, captions) order, so its two headings
    stand over the other text; that is kept as it is."""
    asr = t.seg.select("video_id", F.col("seg_idx").alias("pos"), "text")
    cap = t.evs.select("video_id", F.col("event_id").alias("pos"), "text")
    first = tr.stacked([("ASR transcript:", asr), ("Captions:", cap)]).select(F.lit("asr+captions").alias("form"), "*")
    return first.unionByName(tr.stacked([("Captions:", asr), ("ASR transcript:", cap)]).select(F.lit("captions+asr").alias("form"), "*"))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x))


# What the fixture writes in full width, and what that folds to.
NARROW = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
FULL = "".join(chr(ord(c) + 0xFEE0) for c in NARROW)


@query("u5_folded_distinct_titles", "lin", rf"""
WITH w AS (SELECT video_id, line_no, CASE WHEN line_no % 3 = 1 THEN translate(text, '{NARROW}', '{FULL}') || '　Ⅳ' WHEN line_no % 3 = 2 THEN text || ' IV' ELSE text END AS text FROM lin),
s AS (SELECT video_id, line_no, regexp_replace({STRIP(f"replace(translate(nfc_normalize(text), '{FULL}　', '{NARROW} '), 'Ⅳ', 'IV')")}, '[\s\p{{Z}}]+', ' ', 'g') AS t FROM w), f AS (SELECT video_id, lower(t) AS k, arg_min(t, line_no) AS title, min(line_no) AS pos FROM s WHERE t <> '' GROUP BY 1, 2)
SELECT video_id, printf('T%02d', rn) AS topic_id, title FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS rn FROM f) WHERE rn <= 12""")
def u5(t):
    """Every third line in full-width letters and digits, with a wide space and a Roman number of one character."""
    n = F.col("line_no") % 3
    made = F.when(n == 1, F.concat(F.translate("text", NARROW, FULL), F.lit("　Ⅳ"))).when(n == 2, F.concat("text", F.lit(" IV"))).otherwise(F.col("text"))
    title = F.regexp_replace(tx.strip(nfkc(made)), r"(?U)\s+", " ")
    rows = once(t.lin.select("video_id", F.col("line_no").alias("pos"), title.alias("t")), title=F.col("t")).drop("t")
    return tr.folded_distinct(rows, F.col("title"), 12)


@query("d1_pluggable_cleaner", "seg", f"""
SELECT video_id, CAST(floor(start_s / 300) AS BIGINT) AS window_no, md5({STRIP(fill(SPEECH_CLEAN, "string_agg(" + STRIP('text') + ", chr(10) ORDER BY seg_idx)"))}) AS text_md5 FROM seg GROUP BY 1, 2""")
def d1(t):
    """Any `Column -> Column` cleaner; here over five-minute windows."""

    def window_text(df, cleaner):
        rows = df.withColumn("text", tx.strip(F.col("text"))).groupBy("video_id", F.floor(F.col("start_s") / 300).alias("window_no"))
        return rows.agg(cleaner(wi.joined_text(["seg_idx"], "text", "\n")).alias("text"))

    return window_text(t.seg, tx.clean_speech_text).select("video_id", "window_no", F.md5("text").alias("text_md5"))


MERGING = {
    "interleave": lambda a, c: tr.interleave([("ASR ", a), ("Caption ", c)]).select("video_id", F.lit(0).alias("section"), F.col("place").cast("long").alias("pos"), "line"),
    "asr+captions": lambda a, c: tr.stacked([("ASR transcript:", a), ("Captions:", c)]).select("video_id", "section", "pos", "line"),
    "captions+asr": lambda a, c: tr.stacked([("Captions:", c), ("ASR transcript:", a)]).select("video_id", "section", "pos", "line"),
}


def merge_sql(name: str, first: str, head: str, second: str, head2: str) -> str:
    return f"""SELECT '{name}' AS method, video_id, 0 AS section, pos, text AS line FROM {first} UNION ALL SELECT '{name}', video_id, 1, pos, text FROM {second}
UNION ALL SELECT DISTINCT '{name}', video_id, 0, -1, '{head}' FROM {first} UNION ALL SELECT DISTINCT '{name}', video_id, 1, -1, '{head2}' FROM {second} SEMI JOIN {first} USING (video_id)"""


@query("d2_pluggable_merging", "seg pred", f"""WITH {STREAM_SQL}
SELECT 'interleave' AS method, video_id, 0 AS section, row_number() OVER (PARTITION BY video_id ORDER BY sec, r, pos) AS pos, p || {HMS_SQL.format('sec')} || ': ' || text AS line FROM (SELECT * FROM a UNION ALL SELECT * FROM c)
UNION ALL {merge_sql('asr+captions', 'a', 'ASR transcript:', 'c', 'Captions:')} UNION ALL {merge_sql('captions+asr', 'c', 'Captions:', 'a', 'ASR transcript:')}""")
def d2(t):
    """All lines under each way of merging two streams."""
    asr, cap, _ = streams(t)
    out = None
    for name, merge in MERGING.items():
        part = merge(asr, cap).select(F.lit(name).alias("method"), "video_id", "section", "pos", "line")
        out = part if out is None else out.unionByName(part)
    return out


@query("x20_prompt_assembly", "seg ref", f"""
WITH ans AS (SELECT video_id, string_agg({HMS_SQL.format('start_s')} || ' - ' || title, chr(10) ORDER BY start_s) AS a, min(duration) AS d FROM ref GROUP BY 1),
tr AS (SELECT video_id, string_agg({HMS_SQL.format('start_s')} || ': ' || {STRIP('text')}, chr(10) ORDER BY seg_idx) || chr(10) AS tr FROM seg GROUP BY 1)
SELECT video_id, 'user' AS first_role, md5('Given the complete transcript of a video of duration ' || {HMS_SQL.format('d')} || ', use the provided captions to identify distinct chapters based on content shifts.' || chr(10) || 'Here is the transcript to analyze:' || chr(10) || tr) AS user_md5, 'assistant' AS second_role, a AS answer
FROM ans JOIN tr USING (video_id)""")
def x20(t):
    """Training dialog per video, with its whole transcript."""
    from cuewise.operators.prompts import answers, dialog, whole_transcript

    rows = dialog(answers(t.ref), whole_transcript(t.seg), "use the provided captions to identify distinct chapters based on content shifts.\n")
    d = F.col("dialog")
    return rows.select("video_id", d[0]["role"].alias("first_role"), F.md5(d[0]["content"]).alias("user_md5"), d[1]["role"].alias("second_role"), d[1]["content"].alias("answer"))


@query("x20_slide_bullets", "lin", rf"""
WITH s AS (SELECT video_id, line_no, start_s, unnest(range(len(k))) AS i, unnest(k) AS s FROM (SELECT video_id, line_no, start_s, [y FOR y IN [{STRIP('x')} FOR x IN regexp_split_to_array({STRIP('text')}, '[。；;！？!?]\s*|\n+')] IF y <> ''] AS k FROM lin WHERE {STRIP('text')} <> ''))
SELECT video_id, line_no, i AS pos, '    - 「' || s || '」' AS line FROM s UNION ALL SELECT video_id, line_no, -1, '*   於 ' || {HMS_SQL.format('start_s')} || ' 左右捕捉到:' FROM lin WHERE {STRIP('text')} <> ''""")
def x20_bullets(t):
    from cuewise.operators.prompts import slide_bullets

    return slide_bullets(t.lin)


@query("x20_unit_context", "units", r"""
SELECT video_id, '## 預定教學單元結構 (' || count(*) || ' 個單元)' || chr(10) || string_agg(unit_no || '. ' || title, chr(10) ORDER BY unit_no) || chr(10) || '✅ 目標：創建 ' || count(*) * 2 || ' 到 ' || count(*) * 4 || ' 個章節' AS context FROM units GROUP BY 1""")
def x20_units(t):
    from cuewise.operators.prompts import unit_context

    return unit_context(t.units)
