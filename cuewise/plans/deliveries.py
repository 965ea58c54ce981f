"""JSON, request, log and delivery sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewise.functions import jsontext as js
from cuewise.functions import text as tx
from cuewise.functions.timefmt import sec_to_hms
from cuewise.operators import notes as no
from cuewise.operators.barrier import once
from cuewise.operators.textrows import limit_tokens
from cuewise.plans.registry import query
from cuewise.plans.timebase import HMS_SQL, TRIM_SQL
from cuewise.session import work_dir
from cuewise.sources import delivery as de
from cuewise.sources import records as re
from cuewise.sources.predictions import read_prediction_set, write_predictions

STRIP = TRIM_SQL.format
N = "chr(10)"


@query("s4_segment_loader", "seg", f"""
WITH f AS (SELECT *, CAST(video_id AS BIGINT) % 5 AS k, seg_idx // 32 AS part, {STRIP('text')} AS t FROM seg)
SELECT video_id || '/' || part AS file, CAST(trunc(start_s) AS BIGINT) AS start, CASE WHEN seg_idx % 3 = 0 THEN CAST(trunc(start_s) AS BIGINT) ELSE CAST(trunc(end_s) AS BIGINT) END AS "end", md5(t) AS text_md5 FROM f WHERE k IN (0, 1, 2) AND t <> ''
UNION ALL SELECT video_id || '/' || part, 0, 0, md5({STRIP(f"string_agg(text, {N} ORDER BY seg_idx)")}) FROM f WHERE k = 3 GROUP BY video_id, part""")
def s4(t):
    """Files of at most 32 segments in all accepted shapes; shape 4 is valid JSON of another form and gives nothing."""
    item = F.when(F.col("seg_idx") % 3 == 0, F.to_json(F.struct(F.col("start_s").alias("start"), "text"))).otherwise(F.to_json(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text")))
    rows = t.seg.select("video_id", F.floor(F.col("seg_idx") / 32).alias("part"), "seg_idx", item.alias("j"), "text")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", c))), lambda x: x[c])
    files = rows.groupBy("video_id", "part").agg(ordered("j").alias("j"), ordered("text").alias("x"))
    k, joined = F.col("video_id").cast("long") % 5, F.array_join("j", ",")
    body = (F.when(k == 0, F.concat(F.lit("["), joined, F.lit("]"))).when(k == 1, F.concat(F.lit('{"segments": ['), joined, F.lit("]}"))).when(k == 2, F.concat(F.array_join("j", "\n"), F.lit('\n{"text": " "}\n')))
            .when(k == 3, F.array_join("x", "\n")).otherwise('{"other": 1}'))
    out = re.load_segments(files.select(F.concat_ws("/", "video_id", "part").alias("file"), body.alias("body")), "file", "body")
    return out.select("file", "start", "end", F.md5("text").alias("text_md5"))


def requests(t):
    i = F.col("doc_id")
    info = lambda *names: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": "'), F.col(c), F.lit('"')) for n, c in names]), F.lit("}"))
    full = info(("Id", "id"), ("TeamId", "source"), ("SectionNo", "lang"), ("SectionTitle", "lang"))
    part = info(("Id", "id"), ("SectionNo", "lang"))
    body = (F.when(i % 7 == 0, F.concat(F.lit('{"PlayUrl": "u'), i, F.lit('", "Id": "'), i, F.lit('", "TeamId": "'), "source", F.lit('", "SectionNo": "1", "num_questions": 5}')))
            .when(i % 7 == 1, F.concat(F.lit('{"video_url": "v'), i, F.lit('", "video_info": '), full, F.lit(', "skip_client_post": true}')))
            .when(i % 7 == 2, F.concat(F.lit('{"video_url": "", "play_url": "p'), i, F.lit('", "VideoInfo": '), full, F.lit(', "webhook_url": "w"}')))
            .when(i % 7 == 3, F.concat(F.lit('{"PlayUrl": "q'), i, F.lit('", "video_info": '), part, F.lit("}")))
            .when(i % 7 == 4, F.concat(F.lit('{"video_info": '), full, F.lit("}"))).when(i % 7 == 5, '{"video_url": "x"}').otherwise('{"PlayUrl": "z", "TeamId": "t"}'))
    return t.documents.select("doc_id", "source", "lang", i.cast("string").alias("id")).select("doc_id", body.alias("body"))


@query("s5_request_normaliser", "", """
WITH d AS (SELECT doc_id, doc_id % 7 AS k, source, lang, CAST(doc_id AS VARCHAR) AS i FROM documents)
SELECT doc_id, CASE k WHEN 3 THEN 'Missing required field in video_info: TeamId' WHEN 4 THEN 'Missing required field: video_url or play_url' WHEN 5 THEN 'Missing required field: video_info' WHEN 6 THEN 'Missing required field: Id' END AS message, k < 3 AS ok,
 CASE k WHEN 0 THEN 'u' || i WHEN 1 THEN 'v' || i WHEN 2 THEN 'p' || i WHEN 3 THEN 'q' || i WHEN 5 THEN 'x' WHEN 6 THEN 'z' END AS video_url, CASE WHEN k < 5 THEN i END AS id, CASE WHEN k IN (0, 1, 2, 4) THEN source WHEN k = 6 THEN 't' END AS team_id,
 CASE WHEN k = 0 THEN '1' WHEN k < 5 THEN lang END AS section_no, CASE WHEN k IN (0, 6) THEN '' WHEN k IN (1, 2, 4) THEN lang END AS section_title, '[]' AS units, '2024-01-01T00:00:00Z' AS created_at, 'video.mp4' AS original_filename,
 CASE WHEN k = 0 THEN 5 ELSE 10 END AS num_questions, 3 AS num_pages, CASE WHEN k = 2 THEN 'w' END AS webhook_url, k = 1 AS skip_client_post FROM d""")
def s5(t):
    return re.normalize_requests(requests(t), "body", now="2024-01-01T00:00:00Z")


@query("s6_frame_caption_map", "pred", f"""
SELECT video_id, idx, {HMS_SQL.format('(duration * idx / n::DOUBLE)')} || ': ' || title AS line FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM pred)""")
def s6(t):
    n = t.pred.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    entries = F.collect_list(F.struct(F.concat_ws("/", "idx", "n"), "title"))
    maps = t.pred.join(n, "video_id").groupBy("video_id", "duration").agg(F.map_from_entries(entries).alias("captions"))
    return re.caption_lines(maps).select("video_id", F.col("idx"), "line")


@query("s7_metadata_blocks", "ref", """
SELECT video_id, CAST(idx + 1 AS BIGINT) AS block, start_s / 1.0::DOUBLE AS start_sec, CASE WHEN idx % 4 = 3 THEN 0.0 ELSE end_s / 1.0::DOUBLE END AS end_sec, CASE WHEN idx % 3 = 2 THEN '' ELSE title END AS title FROM ref
UNION ALL SELECT DISTINCT video_id, 0, 0.0::DOUBLE, 0.0::DOUBLE, 'Lecture' FROM ref""")
def s7(t):
    k = F.col("idx")
    block = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_s") * 1000, F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("\nEND = "), F.col("end_s") * 1000)), F.when(k % 3 == 2, "").otherwise(F.concat(F.lit("\ntitle= "), "title")))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("idx", block.alias("b")))), lambda x: x["b"])
    files = t.ref.groupBy("video_id").agg(F.concat(F.lit(";FFMETADATA1\ntitle=Lecture\n"), F.array_join(blocks, "\n")).alias("text"))
    return re.metadata_blocks(files)


@query("s8_prediction_set", "pred", f"SELECT video_id, {HMS_SQL.format('start_s')} AS stamp, title FROM pred")
def s8(t):
    """Writes one prediction file per video and reads the set back through the data source; ids come from the file names."""
    path = work_dir(t.spark)
    write_predictions(t.pred.select("video_id", sec_to_hms(F.col("start_s")).alias("stamp"), "title"), path)
    return read_prediction_set(t.spark, path)


def question_rows(t):
    c = t.read("conversations").where("role = 'user'")
    w = tx.tokens(F.col("text"))
    return c.select(F.col("conv_id").cast("string").alias("key"), F.concat(F.lit("team"), F.col("conv_id") % 3).alias("team_id"), F.col("turn").alias("pos"), F.col("text").alias("question"), w.alias("options"),
                    F.substring(F.lit("ABCD"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1)).alias("answer"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("explanation"),
                    F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("odd")), (F.col("turn") % 3 + 1).cast("int")).alias("difficulty"), F.col("role").alias("topic"))


def section_rows(t):
    c = t.read("conversations").where("role <> 'user'")
    return c.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("pos"), F.concat_ws(" ", "role", "turn").alias("title"), F.col("text").alias("content"),
                    F.when(F.col("turn") % 2 == 0, tx.tokens(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("points"), F.array_distinct(tx.tokens(F.col("text"))).alias("examples"))


TK = r"[x FOR x IN regexp_split_to_array(text, '[\s\p{Z}]+') IF x <> '']"
Q_SQL = f"""
q AS (SELECT CAST(conv_id AS VARCHAR) AS key, 'team' || conv_id % 3 AS team_id, turn, text AS question, {TK} AS options, substr('ABCD', turn % 4 + 1, 1) AS answer, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS expl,
  ['easy', 'medium', 'odd'][turn % 3 + 1] AS difficulty, role AS topic, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user'),
se AS (SELECT CAST(conv_id AS VARCHAR) AS key, turn, role || ' ' || turn AS title, text AS content, CASE WHEN turn % 2 = 0 THEN {TK} ELSE [] END AS points, [x FOR x, i IN {TK} IF NOT list_contains(({TK})[1:i - 1], x)] AS examples, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role <> 'user')
"""


@query("s10_delivery_document", "units uni", f"""WITH {Q_SQL},
h AS (SELECT CAST(conv_id AS VARCHAR) AS key, 'team' || conv_id % 3 AS team_id, conv_id % 5 AS section_no, '2024-01-01T00:00:00Z' AS created_at, arg_max(text, turn) AS summary FROM conversations GROUP BY conv_id),
qs AS (SELECT key, list({{'QuestionId': printf('Q%03d', rn), 'QuestionText': question, 'Options': [{{'Label': substr('ABCD', i, 1), 'Text': o}} FOR o, i IN options[1:4]], 'CorrectAnswer': answer, 'Explanation': expl, 'Tags': [topic],
   'Difficulty': CASE difficulty WHEN 'easy' THEN '簡單' WHEN 'medium' THEN '中等' ELSE difficulty END, 'CourseType': CASE turn % 2 WHEN 0 THEN '數學' ELSE '其他' END}} ORDER BY turn) AS q FROM q GROUP BY 1),
ns AS (SELECT key, string_agg('## ' || title || {N} || content || {N} || CASE WHEN len(points) > 0 THEN '### 重點' || {N} || array_to_string(['- ' || x FOR x IN points], {N}) || {N} ELSE '' END
   || CASE WHEN len(examples) > 0 THEN '### 範例' || {N} || array_to_string(['- ' || x FOR x IN examples], {N}) || {N} ELSE '' END, {N} ORDER BY turn) AS note FROM se GROUP BY 1),
un AS (SELECT video_id AS key, list({{'UnitNo': unit_no, 'Title': title, 'Time': time}} ORDER BY unit_no) AS u FROM units GROUP BY 1),
su AS (SELECT video_id AS key, list({{'UnitNo': unit_no, 'Title': title, 'Time': time}} ORDER BY idx) AS s FROM uni GROUP BY 1)
SELECT key, CAST(to_json({{'Id': key, 'TeamId': team_id, 'SectionNo': section_no, 'CreatedAt': created_at, 'Questions': coalesce(q, []), 'CourseNote': {STRIP("coalesce(note || chr(10), '') || '## 總結' || chr(10) || summary")},
   'Units': coalesce(u, []), 'SuggestedUnits': coalesce(s, [])}}) AS VARCHAR) AS document FROM h LEFT JOIN qs USING (key) LEFT JOIN ns USING (key) LEFT JOIN un USING (key) LEFT JOIN su USING (key)""")
def s10(t):
    c = t.read("conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("summary"))
    heads = c.select(F.col("conv_id").cast("string").alias("key"), F.concat(F.lit("team"), F.col("conv_id") % 3).alias("team_id"), (F.col("conv_id") % 5).alias("section_no"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), "summary")
    questions = question_rows(t).withColumn("course_type", F.when(F.col("pos") % 2 == 0, "數學").otherwise("其他"))
    units = lambda df, pos: df.select(F.col("video_id").alias("key"), F.col(pos).alias("pos"), "unit_no", "title", "time")
    return de.delivery(heads, questions, section_rows(t), units(t.units, "unit_no"), units(t.uni, "idx"))


@query("s11_markdown_rendering", "", f"""WITH {Q_SQL}
SELECT 'question' AS kind, key, turn AS pos, '## Q' || turn || '. ' || question || {N} || array_to_string(['- ' || substr('ABCD', i, 1) || '. ' || o FOR o, i IN options[1:4]], {N}) || {N} || '**正確答案**：' || answer || CASE WHEN expl <> '' THEN {N} || '**解析**：' || expl ELSE '' END || {N} || '**難度**：' || difficulty || '　**主題**：' || topic || {N} AS markdown FROM q
UNION ALL SELECT 'section', key, turn, '## ' || title || {N} || content || CASE WHEN len(points) > 0 THEN {N} || '**重點：**' || {N} || array_to_string(['- ' || x FOR x IN points], {N}) ELSE '' END || CASE WHEN len(examples) > 0 THEN {N} || '**範例：**' || {N} || array_to_string(['- ' || x FOR x IN examples], {N}) ELSE '' END || {N} FROM se""")
def s11(t):
    c = F.col
    q = question_rows(t).select(F.lit("question").alias("kind"), "key", "pos", de.question_markdown(c("pos"), c("question"), c("options"), c("answer"), c("explanation"), c("difficulty"), c("topic")).alias("markdown"))
    s = section_rows(t).select(F.lit("section").alias("kind"), "key", "pos", de.section_markdown(c("title"), c("content"), c("points"), c("examples")).alias("markdown"))
    return q.unionByName(s)


@query("s12_artefact_layout", "man", "SELECT 'raw' AS category, team_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(sha256(text)) AS first_hash FROM man JOIN documents ON CAST(doc_id AS VARCHAR) = video_id GROUP BY 2")
def s12(t):
    path = work_dir(t.spark)
    rows = t.documents.select(F.lit("raw").alias("category"), F.col("source").alias("team_id"), F.col("doc_id").cast("string").alias("video_id"), F.lit("transcript.txt").alias("name"), F.col("text").alias("body"))
    de.write_artefacts(rows, path)
    return t.spark.read.parquet(path).groupBy("category", "team_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("content_hash").alias("first_hash"))


@query("s14_vector_records", "seg vec", """
WITH c AS (SELECT s.video_id, seg_idx AS pos, v AS version, 'team' || CAST(s.video_id AS BIGINT) % 3 AS team_id, 'ch0_' || seg_idx AS chunk_id, left(text || repeat('-', v * 1100), 1000) AS text FROM seg s, range(2) AS r(v) WHERE v <= seg_idx % 2)
SELECT team_id || '_' || c.video_id || '_' || chunk_id AS id, version, md5(text) AS text_md5, len(vec) AS dims, c.pos // 100 AS batch_no FROM c JOIN vec USING (video_id, pos) WHERE version = c.pos % 2""")
def s14(t):
    versions = F.explode(F.sequence(F.lit(0).cast("long"), F.col("seg_idx") % 2))
    c = t.seg.select("video_id", F.col("seg_idx").alias("pos"), versions.alias("version"), F.concat(F.lit("team"), F.col("video_id").cast("long") % 3).alias("team_id"), F.concat(F.lit("ch0_"), "seg_idx").alias("chunk_id"), "text")
    c = c.withColumn("text", F.concat("text", F.repeat(F.lit("-"), (F.col("version") * 1100).cast("int"))))
    return de.vector_records(c, t.vec.select("video_id", "pos", "vec")).select("id", "version", F.md5("text").alias("text_md5"), F.size("vec").cast("long").alias("dims"), "batch_no")


@query("s15_metrics_log", "", """
SELECT strftime(TIMESTAMP '2024-03-01 08:00:00' + doc_id * INTERVAL 1500 MILLISECOND, '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 2 = 1 THEN '.500000' ELSE '' END || '+00:00' AS timestamp, CAST(doc_id AS VARCHAR) AS video_id,
  doc_id % 7 AS units_provided, round_even(quality * 0.5 + (doc_id % 10) / 16.0::DOUBLE, 3) AS validation_score, quality * 0.5 + (doc_id % 10) / 16.0::DOUBLE >= 0.55 AS accepted, 0.55::DOUBLE AS threshold FROM labels""")
def s15(t):
    """Two appends to one log, read back in full."""
    path, n = work_dir(t.spark), F.col("doc_id")
    score = F.col("quality") * 0.5 + n % 10 / 16.0
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-03-01 08:00:00").cast("timestamp")) + n * 1500000)
    rows = t.read("labels").select(n.alias("video_id"), (n % 7).alias("units_provided"), score.alias("score"), at.alias("at"))
    half = F.pmod(F.xxhash64("video_id"), F.lit(2))
    for part in (0, 1):
        de.append_metrics(de.validation_log(rows.where(half == part), threshold=0.55), path)
    return de.read_metrics(t.spark, path)


@query("s17_log_durations", "lin", """
SELECT video_id AS file, arg_max((line_no % 24) * 3600 + line_no % 60 * 60 + 30.5::DOUBLE, line_no) FILTER (WHERE line_no % 3 = 0) AS duration, arg_max((line_no % 60) + 0.25::DOUBLE, line_no) FILTER (WHERE line_no % 4 = 1) AS removed FROM lin GROUP BY 1""")
def s17(t):
    n = F.col("line_no")
    line = (F.when(n % 3 == 0, F.format_string("INFO Processing audio with duration %02d:%02d:30.500 now", n % 24, n % 60)).otherwise(F.col("text")))
    removed = F.format_string(" VAD filter removed 00:00:%02d.250 of audio", n % 60)
    rows = t.lin.select(F.col("video_id").alias("file"), n.alias("line_no"), F.when(n % 4 == 1, F.concat(line, removed)).otherwise(line).alias("line"))
    return re.log_durations(rows)


@query("x16_json_extraction", "", """
SELECT event_id, CASE WHEN event_id % 7 <> 5 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS from_blob, CASE WHEN event_id % 7 IN (0, 1, 2, 4) THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS from_repaired FROM events""")
def x16(t):
    """Properties wrapped in prose, in seven ways; way 5 is broken, way 4 has curly quotes."""
    i, p = F.col("event_id") % 7, F.col("props")
    reply = (F.when(i == 0, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone"))).when(i == 1, F.concat(F.lit("```\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit(" "), p, F.lit("\n")))
             .when(i == 3, F.concat(F.lit("The answer is "), p, F.lit(" as asked."))).when(i == 4, F.replace(p, F.lit('"k"'), F.lit("“k”"))).when(i == 5, "no json here").otherwise(F.concat(F.lit("list: ["), p, F.lit("] end"))))
    e = once(t.texts("events").select("event_id", reply.alias("r")), b=js.json_blob(F.col("r")), c=js.repaired_json(F.col("r")))
    mended = F.translate("b", "“”", '""')
    return e.select("event_id", F.try_variant_get(F.try_parse_json(mended), "$.k", "int").alias("from_blob"), F.try_variant_get(F.try_parse_json("c"), "$.k", "int").alias("from_repaired"))


@query("x17_question_normalisation", "", f"""
WITH k AS (SELECT conv_id, turn, {TK} AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN w[1] ELSE array_to_string(w[1:4], '|') END AS options, CASE WHEN turn % 3 = 2 THEN '' ELSE 'B' END AS correct_answer, CASE WHEN turn % 3 = 0 THEN 'easy' ELSE 'medium' END AS difficulty,
 CASE WHEN turn % 2 = 0 THEN '數學' ELSE '其他' END AS course_type, CASE WHEN turn % 5 = 0 THEN w[1] WHEN turn % 5 = 1 THEN '' ELSE array_to_string(w[1:5], '|') END AS tags FROM k""")
def x17(t):
    w = F.col("w")
    q = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    arr = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, q), ", "), F.lit("]"))
    n = F.col("turn")
    doc = F.concat(F.lit('{"question": "x", "options": '), F.when(n % 4 == 1, q(F.get(w, F.lit(0)))).otherwise(arr(w)), F.when(n % 3 == 0, ', "correct_answer": "B", "difficulty": "EASY"').when(n % 3 == 1, ', "correct_option": "B", "difficulty": "odd"').otherwise(""),
                   F.when(n % 2 == 0, ', "course_type": " 數學 "').otherwise(', "course_type": "?"'), F.when(n % 5 == 0, F.concat(F.lit(', "tags": '), q(F.get(w, F.lit(0))))).when(n % 5 == 1, ', "tags": null').otherwise(F.concat(F.lit(', "tags": '), arr(w))), F.lit("}"))
    rows = once(t.read("conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("w")), v=F.parse_json(doc))
    f = js.question_fields(F.col("v"))
    return rows.select("conv_id", "turn", F.array_join(f["options"], "|").alias("options"), f["correct_answer"].alias("correct_answer"), f["difficulty"].alias("difficulty"), f["course_type"].alias("course_type"), F.array_join(f["tags"], "|").alias("tags"))


def option_rows(t):
    w = tx.tokens(F.col("text"))
    rows = t.read("conversations").select("conv_id", "turn", w.alias("w"))
    at = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    texts = F.array(F.concat(F.lit(" "), at(0)), F.lit(""), at(1), F.concat(at(0), F.lit(" ")), F.array_join(F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0))), " "))
    return rows.select("conv_id", "turn", F.array(*[F.lit(x) for x in ("A", "B", "C", " D", "E")]).alias("labels"), texts.alias("texts"), F.element_at(F.array(*[F.lit(x) for x in ("A", "C", "D", "B", "Z")]), (F.col("turn") % 5 + 1).cast("int")).alias("correct"))


OPTION_SQL = f"""
k0 AS (SELECT conv_id, turn, {TK} AS w, ['A', 'C', 'D', 'B', 'Z'][turn % 5 + 1] AS c FROM conversations),
k AS (SELECT conv_id, turn, c, [coalesce(w[1], ''), coalesce(w[2], ''), coalesce(array_to_string(w[3:], ' '), '')] AS w FROM k0),
r AS (SELECT *, nullif(CASE c WHEN 'A' THEN w[1] WHEN 'C' THEN w[2] WHEN 'D' THEN w[1] END, '') AS right_text, list_distinct([]::VARCHAR[]) AS z, [x FOR x, i IN w IF x <> '' AND NOT list_contains(w[1:i - 1], x)] AS cl FROM k),
f AS (SELECT *, (cl || ['（選項補齊）' || i FOR i IN range(len(cl) + 1, 5)])[1:4] AS full_opts FROM r),
tidy AS (SELECT conv_id, turn, full_opts, CASE WHEN right_text IS NOT NULL THEN substr('ABCD', list_position(full_opts, right_text), 1) WHEN c IN ('A', 'B', 'C', 'D') THEN c ELSE 'A' END AS correct FROM f)"""


@query("x18_option_hygiene", "", f"WITH {OPTION_SQL} SELECT conv_id, turn, array_to_string(full_opts, '|') AS options, correct FROM tidy")
def x18(t):
    options, correct = js.tidy_options(F.col("labels"), F.col("texts"), F.col("correct"))
    return option_rows(t).select("conv_id", "turn", F.array_join(options, "|").alias("options"), correct.alias("correct"))


@query("x18_option_shuffle", "", f"""WITH {OPTION_SQL},
mixed AS (SELECT *, list_transform(list_sort(list_transform(full_opts, lambda o: {{'h': md5(o || ':7'), 'o': o}})), lambda s: s.o) AS mixed, full_opts[strpos('ABCD', correct)] AS answer FROM tidy),
named AS (SELECT *, substr('ABCD', list_position(mixed, answer), 1) AS label FROM mixed)
SELECT conv_id, turn, array_to_string(mixed, '|') AS options, label AS correct, '正確答案是 ' || label || '，因為' AS explanation FROM named""")
def x18_shuffle(t):
    """Order by a hash of option and seed; the answer keeps pointing at its text."""
    options, correct = js.tidy_options(F.col("labels"), F.col("texts"), F.col("correct"))
    rows = once(option_rows(t), options=options, correct=correct)
    order, label, expl = js.shuffled(F.col("options"), F.col("correct"), F.concat(F.lit("正確答案是 "), "correct", F.lit("，因為")), seed=7)
    return rows.select("conv_id", "turn", F.array_join(order, "|").alias("options"), label.alias("correct"), expl.alias("explanation"))


MODULE_SQL = """
m AS (SELECT video_id, idx, CASE idx % 7 WHEN 0 THEN '模塊' || idx || '：' || title || ' ~ 00:00-00:25 ~ a、b、 ~ 理論' WHEN 1 THEN idx || '. ' || title || ' @ 00:01:00' WHEN 2 THEN '模塊名稱 ~ 起始時間戳' WHEN 3 THEN '- ' || title WHEN 4 THEN idx || '. ' || title WHEN 5 THEN title || ' ~ ~ x、y' ELSE '# note' END AS l FROM ref)
"""


@query("x19_module_table_topics", "ref", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS n FROM ref WHERE idx % 7 IN (0, 1, 4, 5))
SELECT video_id, lpad(CAST(n AS VARCHAR), 2, '0') AS topic_id, title, CASE idx % 7 WHEN 0 THEN 'a、b、，教學方式：理論' WHEN 1 THEN title WHEN 4 THEN '從章節模塊提取的教學主題' ELSE 'x、y' END AS summary, CASE idx % 7 WHEN 0 THEN 'a|b' WHEN 5 THEN 'x|y' ELSE '' END AS keywords, CASE idx % 7 WHEN 0 THEN '00:00-00:25' WHEN 1 THEN '00:01:00' ELSE '' END AS time_range FROM k""")
def x19(t):
    k, i = F.col("idx") % 7, F.col("idx")
    line = (F.when(k == 0, F.concat(F.lit("模塊"), i, F.lit("："), "title", F.lit(" ~ 00:00-00:25 ~ a、b、 ~ 理論"))).when(k == 1, F.concat(i, F.lit(". "), "title", F.lit(" @ 00:01:00"))).when(k == 2, "模塊名稱 ~ 起始時間戳")
            .when(k == 3, F.concat(F.lit("- "), "title")).when(k == 4, F.concat(i, F.lit(". "), "title")).when(k == 5, F.concat("title", F.lit(" ~ ~ x、y"))).otherwise("# note"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"])
    replies = t.ref.groupBy("video_id").agg(F.array_join(lines, "\n").alias("reply"))
    return no.module_topics(replies, "video_id", "reply").withColumn("keywords", F.array_join("keywords", "|"))


@query("x19_summary_and_takeaways", "", r"""
SELECT doc_id, lang AS topic, source AS core_content, CASE WHEN doc_id % 2 = 0 THEN 'easy' END AS difficulty, array_to_string([y FOR y IN [trim(regexp_replace(trim(x), '^[\s•\-*\d\.\)]+', '')) FOR x IN string_split(text, chr(10))] IF y <> ''], '|') AS takeaways FROM documents""")
def x19_summary(t):
    reply = F.concat(F.lit(" 課程主題： "), "lang", F.lit("\n核心內容："), "source", F.lit("\n其他：x"), F.when(F.col("doc_id") % 2 == 0, "\n難度級別：hard\n難度級別： easy").otherwise(""))
    rows = once(t.documents.select("doc_id", "text", "lang", "source"), reply=reply)
    s = no.labelled_summary(F.col("reply"))
    return rows.select("doc_id", s["topic"].alias("topic"), s["core_content"].alias("core_content"), s["difficulty"].alias("difficulty"), F.array_join(no.takeaways(F.col("text")), "|").alias("takeaways"))


@query("p2_topic_structure_errors", "", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Missing ''topics'' field' WHEN 2 THEN '''topics'' should be a list;Missing ''global_summary'' field' WHEN 3 THEN '''global_summary'' should be a string;Topic 0 missing ''title'';Topic 1 is not a dictionary' WHEN 4 THEN 'Topic 0 title is not a string;Topic 0 missing ''summary''' ELSE 'Data is not a dictionary' END AS errors FROM documents""")
def p2_topics(t):
    k, lang = F.col("doc_id") % 6, F.col("lang")
    doc = (F.when(k == 0, F.concat(F.lit('{"topics": [{"title": "'), lang, F.lit('", "summary": "s"}], "global_summary": "g"}'))).when(k == 1, '{"global_summary": "g"}').when(k == 2, '{"topics": "x"}')
           .when(k == 3, '{"topics": [{"summary": "s"}, 5], "global_summary": 1}').when(k == 4, F.concat(F.lit('{"topics": [{"title": '), "doc_id", F.lit('}], "global_summary": "g"}'))).otherwise("[1]"))
    rows = once(t.documents.select("doc_id", "lang"), v=F.parse_json(doc))
    return rows.select("doc_id", F.array_join(no.topic_errors(F.col("v")), ";").alias("errors"))


@query("p3_section_validation", "", f"""
WITH d AS (SELECT doc_id, doc_id % 6 AS k, regexp_replace(text, '["\\\\\\x00-\\x1f]', ' ', 'g') AS x, lang, source FROM documents)
SELECT doc_id, CASE WHEN k = 0 AND length(trim('lesson: ' || x)) <= 10000 THEN 'valid' WHEN k IN (4, 5) THEN 'fallback' ELSE 'partial' END AS mode, 0 AS pos, CASE WHEN k IN (4, 5) THEN '講義內容（自動生成）' WHEN k = 3 THEN '未命名章節' ELSE lang END AS title,
 CASE WHEN k = 5 THEN length(left(x, 5000)) WHEN k = 4 THEN length(left('{{"sections": [' || x, 5000)) WHEN k = 1 THEN 5 WHEN k = 0 AND length(trim('lesson: ' || x)) <= 10000 THEN length(trim('lesson: ' || x)) ELSE length(left('lesson: ' || x, 10000)) END AS chars, CASE WHEN k IN (4, 5) THEN 1 WHEN k = 2 THEN 10 ELSE 1 END AS points,
 CASE WHEN k IN (4, 5) THEN '由於格式錯誤，系統自動生成了基本講義內容' WHEN k = 3 THEN '講義摘要生成中發生錯誤' ELSE 'summary of ' || source END AS summary FROM d""")
def p3(t):
    k = F.col("doc_id") % 6
    x = F.regexp_replace("text", r'["\\\x00-\x1f]', " ")
    lesson = F.concat(F.lit("lesson: "), "x")
    points = lambda n: F.lit('"key_points": [' + ", ".join(f'"p{i}"' for i in range(n)) + "]")
    body = lambda title, content, pts, summary: F.concat(F.lit('{"sections": [{'), *title, F.lit('"content": "'), content, F.lit('", '), pts, F.lit("}]"), *summary, F.lit("}"))
    title = [F.lit('"title": "'), F.col("lang"), F.lit('", ')]
    summary = [F.lit(', "summary": "summary of '), F.col("source"), F.lit('"')]
    reply = (F.when(k == 0, F.concat(F.lit("```json\n"), body(title, lesson, points(1), summary), F.lit("\n```"))).when(k == 1, body(title, F.lit("short"), points(1), summary))
             .when(k == 2, body(title, lesson, points(12), summary)).when(k == 3, body([], lesson, points(1), [])).when(k == 4, F.concat(F.lit('{"sections": ['), "x")).otherwise(F.col("x")))
    rows = once(once(t.documents.select("doc_id", "text", "lang", "source"), x=x), reply=reply)
    out = no.read_notes(rows, "doc_id", "reply")
    return out.select("doc_id", "mode", "pos", "title", F.length("content").cast("long").alias("chars"), F.size("points").alias("points"), "summary")
