"""Structured notes, topics and modules read from model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions.jsontext import as_list, strict_json
from cuewise.operators.barrier import once


# Fences around a reply, and what stands in for missing parts.
JSON_FENCE, FENCE = r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```"
NO_TITLE, NO_SUMMARY = "未命名章節", "講義摘要生成中發生錯誤"
FALLBACK_TITLE, FALLBACK_POINT, FALLBACK_SUMMARY = "講義內容（自動生成）", "系統自動提取的內容，可能不完整", "由於格式錯誤，系統自動生成了基本講義內容"
EMPTY_TITLE, EMPTY_CONTENT, EMPTY_POINT = "講義內容", "無法生成完整講義內容", "請參考課程錄影"


def read_notes(replies: DataFrame, key: str, text: str) -> DataFrame:
    """Sections `(key, mode, pos, title, content, points, examples, summary)` of a notes reply; never empty.

    valid: all bounds hold (1–20 sections, title 1–300, content 10–10000, up to 10 points and 5
    examples, summary 10–1000). partial: at most ten sections, fields cut to their bounds.
    fallback: the first 5000 characters as one section when there is no JSON object.
    """
    raw = F.trim("_raw")
    tagged, fenced = F.regexp_extract(raw, JSON_FENCE, 1), F.regexp_extract(raw, FENCE, 1)
    blob = F.when(tagged != "", tagged).when(raw.contains("```") & ~raw.contains("```json") & (fenced != ""), fenced).otherwise(raw)
    rows = once(replies.select(key, F.col(text).alias("_raw")), _v=strict_json(blob))
    v = F.col("_v")
    get = lambda path, t="string": F.try_variant_get(v, path, t)
    listed = F.schema_of_variant(get("$.sections", "variant")).startswith("ARRAY")
    rows = once(rows, _ok=F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), _sections=F.when(listed, get("$.sections", "variant").cast("array<variant>")), _sum=get("$.summary"))
    item = lambda s, path, t="string": F.try_variant_get(s, path, t)

    def clean(arr: Column) -> Column:
        return F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

    def fits(s: Column) -> Column:
        title, content = F.trim(item(s, "$.title")), F.trim(item(s, "$.content"))
        return F.coalesce(F.length(title).between(1, 300) & F.length(content).between(10, 10000) & (F.size(clean(as_list(item(s, "$.key_points", "variant")))) <= 10)
                          & (F.size(clean(as_list(item(s, "$.examples", "variant")))) <= 5), F.lit(False))

    good = F.coalesce(F.col("_ok") & F.size("_sections").between(1, 20) & F.length(F.trim("_sum")).between(10, 1000) & ~F.exists("_sections", lambda s: ~fits(s)), F.lit(False))
    rows = once(rows, mode=F.when(good, "valid").when(F.col("_ok"), "partial").otherwise("fallback"))
    most = F.when(F.col("mode") == "valid", 20).otherwise(10)
    shown = F.filter(F.slice("_sections", F.lit(1), most), lambda s: F.schema_of_variant(s).startswith("OBJECT"))
    section = lambda s: F.struct(
        F.when(F.col("mode") == "valid", F.trim(item(s, "$.title"))).otherwise(F.substring(F.coalesce(item(s, "$.title"), F.lit(NO_TITLE)), 1, 300)).alias("title"),
        F.when(F.col("mode") == "valid", F.trim(item(s, "$.content"))).otherwise(F.substring(F.coalesce(item(s, "$.content"), F.lit("")), 1, 10000)).alias("content"),
        F.slice(clean(as_list(item(s, "$.key_points", "variant"))), 1, 10).alias("points"), F.slice(clean(as_list(item(s, "$.examples", "variant"))), 1, 5).alias("examples"))
    none = F.array().cast("array<string>")
    single = lambda title, content, points: F.array(F.struct(F.lit(title).alias("title"), content.alias("content"), points.alias("points"), none.alias("examples")))
    kept = F.filter(F.transform(shown, section), lambda s: (s["title"] != "") | (s["content"] != ""))
    fallback = single(FALLBACK_TITLE, F.substring("_raw", 1, 5000), F.array(F.lit(FALLBACK_POINT)))
    empty = single(EMPTY_TITLE, F.lit(EMPTY_CONTENT), F.array(F.lit(EMPTY_POINT)))
    sections = F.when(F.col("mode") == "fallback", fallback).when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(empty)
    summary = (F.when(F.col("mode") == "fallback", FALLBACK_SUMMARY).when(F.col("mode") == "valid", F.trim("_sum")).otherwise(F.substring(F.coalesce("_sum", F.lit("")), 1, 1000)))
    out = rows.select(key, "mode", F.when(summary == "", NO_SUMMARY).otherwise(summary).alias("summary"), F.posexplode(sections).alias("pos", "s"))
    return out.select(key, "mode", "pos", "s.*", "summary")


# Words of the header row of a module table.
HEADER_WORDS = "模塊名稱|起始時間戳|結束時間戳|核心學習點|教學方法"


def module_topics(replies: DataFrame, key: str, text: str) -> DataFrame:
    """Topics of a module table with rows separated by `~` or `@`, or one title per line.

    Header rows, comments and bullets are skipped; ids count the kept rows of a text.
    """
    rows = replies.select(key, F.posexplode(F.split(F.trim(text), "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("-") & ~F.col("line").rlike(HEADER_WORDS))
    parts = F.transform(F.when(F.col("line").contains("~"), F.split("line", "~")).when(F.col("line").contains("@"), F.split("line", "@")).otherwise(F.array("line")), lambda x: F.trim(x))
    rows = once(rows, p=parts)
    many = F.size("p") >= 2
    at = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    name = F.regexp_replace(F.when(many, F.regexp_replace(at(0), r"^模塊\d+[：:]\s*", "")).otherwise(at(0)), r"^\d+\.\s*", "")
    rows = once(rows, title=F.when(many, F.trim(name)).otherwise(F.substring(F.trim(name), 1, 100)))
    note = F.when(at(3) != "", F.concat(F.lit("教學方式："), at(3)))
    summary = F.when(~many, "從章節模塊提取的教學主題").otherwise(F.coalesce(F.nullif(F.concat_ws("，", F.nullif(at(2), F.lit("")), note), F.lit("")), name))
    words = F.slice(F.filter(F.transform(F.split(at(2), "、"), lambda x: F.trim(x)), lambda k: k != ""), 1, 5)
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.where("title <> ''").select(key, F.lpad(place.cast("string"), 2, "0").alias("topic_id"), "title", summary.alias("summary"),
                                            F.when(many, words).otherwise(F.array().cast("array<string>")).alias("keywords"), F.when(many, at(1)).otherwise("").alias("time_range"))


# Labels of the summary lines.
SUMMARY_LABELS = {"topic": "課程主題：", "core_content": "核心內容：", "learning_objectives": "學習目標：", "target_audience": "適合對象：", "difficulty": "難度級別："}


def labelled_summary(text: Column) -> dict[str, Column]:
    """Value of each labelled line; the last line with a label counts."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def value(label: str) -> Column:
        hits = F.filter(lines, lambda x: x.startswith(label))
        return F.trim(F.replace(F.get(hits, F.size(hits) - 1), F.lit(label), F.lit("")))

    return {name: value(label) for name, label in SUMMARY_LABELS.items()}


# Fixed value: bullets and numbers in front of a takeaway.
BULLETS = r"^[\s•\-*\d\.\)]+"


def takeaways(text: Column) -> Column:
    """Bulleted lines without their bullets and numbers."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), BULLETS, "")))
    return F.filter(lines, lambda x: x != "")


def topic_errors(v: Column) -> Column:
    """Structure errors of a topics reply (variant), in order."""
    top = F.schema_of_variant(v)
    get = lambda path: F.try_variant_get(v, path, "variant")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
    topics = get("$.topics")
    head = F.array(
        F.when(topics.isNull(), "Missing 'topics' field").when(~kind(topics).startswith("ARRAY"), "'topics' should be a list"),
        F.when(get("$.global_summary").isNull(), "Missing 'global_summary' field").when(kind(get("$.global_summary")) != "STRING", "'global_summary' should be a string"))

    def item(t: Column, i: Column) -> Column:
        a, b = F.try_variant_get(t, "$.title", "variant"), F.try_variant_get(t, "$.summary", "variant")
        lead = F.concat(F.lit("Topic "), i)
        return F.when(~kind(t).startswith("OBJECT"), F.array(F.concat(lead, F.lit(" is not a dictionary")))).otherwise(F.array(
            F.when(a.isNull(), F.concat(lead, F.lit(" missing 'title'"))).when(kind(a) != "STRING", F.concat(lead, F.lit(" title is not a string"))),
            F.when(b.isNull(), F.concat(lead, F.lit(" missing 'summary'"))).when(kind(b) != "STRING", F.concat(lead, F.lit(" summary is not a string")))))

    inner = F.when(kind(topics).startswith("ARRAY"), F.flatten(F.transform(topics.cast("array<variant>"), item))).otherwise(F.array().cast("array<string>"))
    return F.when(~F.coalesce(top.startswith("OBJECT"), F.lit(False)), F.array(F.lit("Data is not a dictionary"))).otherwise(F.array_compact(F.concat(head, inner)))
