"""Documents and tables handed on: nested JSON, markdown, artefacts, vector records, metric logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.functions.text import strip

# Shown names of the difficulties.
DIFFICULTY_NAMES = {"easy": "簡單", "medium": "中等", "hard": "困難"}


def difficulty_name(c: Column) -> Column:
    out = c
    for key, name in DIFFICULTY_NAMES.items():
        out = F.when(c == key, name).otherwise(out)
    return out


def labelled(options: Column) -> Column:
    """Options as `{Label, Text}` A to D."""
    return F.transform(F.slice(options, 1, 4), lambda o, i: F.struct(F.substring(F.lit("ABCD"), i + 1, F.lit(1)).alias("Label"), o.alias("Text")))


def _gathered(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """`value` of all rows of a key, by `pos`."""
    held = F.sort_array(F.collect_list(F.struct("pos", value.alias("v"))))
    return rows.groupBy("key").agg(F.transform(held, lambda x: x["v"]).alias(name))


# Headings of the course note.
POINTS, EXAMPLES, SUMMARY = "### 重點", "### 範例", "## 總結"


def delivery(heads: DataFrame, questions: DataFrame, sections: DataFrame, units: DataFrame, suggested: DataFrame) -> DataFrame:
    """One JSON document per row of `heads`, with all its questions, note sections and units, in field order.

    heads: key, team_id, section_no, created_at, summary. questions: key, pos, question, options, answer,
    explanation, difficulty, topic, course_type. sections: key, pos, title, content, points, examples.
    units, suggested: key, pos, unit_no, title, time. A document is one cell, of the size of its parts.
    """
    c = F.col
    bullets = lambda head, items: F.when(F.size(items) > 0, F.concat_ws("\n", F.lit(head), F.transform(items, lambda x: F.concat(F.lit("- "), x))))
    question = F.struct(c("question").alias("QuestionText"), labelled(c("options")).alias("Options"), c("answer").alias("CorrectAnswer"), c("explanation").alias("Explanation"),
                        F.array("topic").alias("Tags"), difficulty_name(c("difficulty")).alias("Difficulty"), c("course_type").alias("CourseType"))
    section = F.concat_ws("\n", F.concat(F.lit("## "), c("title")), c("content"), bullets(POINTS, c("points")), bullets(EXAMPLES, c("examples")), F.lit(""))
    unit = F.struct(c("unit_no").alias("UnitNo"), c("title").alias("Title"), c("time").alias("Time"))
    parts = {"q": (questions, question), "n": (sections, section), "u": (units, unit), "s": (suggested, unit)}
    rows = heads
    for name, (df, value) in parts.items():
        got = _gathered(df, value, name)
        empty = F.array().cast(got.schema[name].dataType)
        rows = rows.join(got, "key", "left").withColumn(name, F.coalesce(name, empty))
    fields = ("QuestionText", "Options", "CorrectAnswer", "Explanation", "Tags", "Difficulty", "CourseType")
    numbered = F.transform("q", lambda x, i: F.struct(F.format_string("Q%03d", i + 1).alias("QuestionId"), *[x[f].alias(f) for f in fields]))
    note = strip(F.concat_ws("\n", "n", F.lit(SUMMARY), "summary"))
    doc = F.struct(c("key").alias("Id"), c("team_id").alias("TeamId"), c("section_no").alias("SectionNo"), c("created_at").alias("CreatedAt"), numbered.alias("Questions"),
                   note.alias("CourseNote"), c("u").alias("Units"), c("s").alias("SuggestedUnits"))
    return rows.select("key", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def question_markdown(pos: Column, question: Column, options: Column, answer: Column, explanation: Column, difficulty: Column, topic: Column) -> Column:
    opts = F.transform(F.slice(options, 1, 4), lambda o, i: F.concat(F.lit("- "), F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(". "), o))
    return F.concat_ws("\n", F.concat(F.lit("## Q"), pos, F.lit(". "), question), F.array_join(opts, "\n"), F.concat(F.lit("**正確答案**："), answer),
                       F.when(explanation != "", F.concat(F.lit("**解析**："), explanation)), F.concat(F.lit("**難度**："), difficulty, F.lit("　**主題**："), topic), F.lit(""))


def section_markdown(title: Column, content: Column, points: Column, examples: Column) -> Column:
    bullets = lambda arr: F.array_join(F.transform(arr, lambda k: F.concat(F.lit("- "), k)), "\n")
    return F.concat_ws("\n", F.concat(F.lit("## "), title), content, F.when(F.size(points) > 0, F.concat(F.lit("**重點：**\n"), bullets(points))),
                       F.when(F.size(examples) > 0, F.concat(F.lit("**範例：**\n"), bullets(examples))), F.lit(""))


def write_artefacts(rows: DataFrame, path: str) -> None:
    """Artefact rows `(category, team_id, video_id, name, body)` keyed by category and team, with size and
    content hash. Rows are rebalanced by team: a busy team gets as many files as its bytes ask for."""
    out = rows.withColumn("content_hash", F.sha2("body", 256)).withColumn("chars", F.length("body"))
    out.hint("rebalance", "category", "team_id").write.mode("append").partitionBy("category", "team_id").parquet(path)


def vector_records(chunks: DataFrame, vectors: DataFrame, batch: int = 100) -> DataFrame:
    """Records `{team}_{video}_{chunk}` with metadata and the text cut to 1000 characters; the last
    version of an id wins. `batch_no` groups `batch` positions of a video for sending."""
    rec = chunks.join(vectors, ["video_id", "pos"]).withColumn("id", F.concat_ws("_", "team_id", "video_id", "chunk_id"))
    body = F.struct("version", "team_id", "video_id", "pos", "chunk_id", F.substring("text", 1, 1000).alias("text"), "vec")
    latest = rec.groupBy("id").agg(F.max_by(body, "version").alias("r")).select("id", "r.*")
    return latest.withColumn("batch_no", F.floor(F.col("pos") / batch))


def validation_log(rows: DataFrame, threshold: float) -> DataFrame:
    """Log records of validated units `(at, video_id, units_provided, score)`: six fields, the time as ISO 8601 in UTC
    with microseconds only where there are any, the score to three digits, accepted from the whole score."""
    at = F.to_utc_timestamp("at", F.current_timezone())
    stamp = F.when(F.unix_micros("at") % 1000000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return rows.select(F.concat(stamp, F.lit("+00:00")).alias("timestamp"), F.col("video_id").cast("string").alias("video_id"), F.col("units_provided").cast("long").alias("units_provided"),
                       F.bround("score", 3).alias("validation_score"), (F.col("score") >= threshold).alias("accepted"), F.lit(float(threshold)).alias("threshold"))


METRICS = "timestamp string, video_id string, units_provided long, validation_score double, accepted boolean, threshold double"


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append metric rows as JSON lines."""
    rows.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log; a field that a record lacks is null."""
    return spark.read.schema(METRICS).json(path)
