"""Readers for segment files, requests, caption maps, metadata blocks, logs and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.functions import text as tx
from cuewise.functions.jsontext import field, strict_json, truthy
from cuewise.functions.timefmt import hms_to_sec, sec_to_hms
from cuewise.operators.barrier import once


def load_segments(files: DataFrame, key: str, body: str) -> DataFrame:
    """Segments `(key, pos, start, end, text)` of a JSON array, `{"segments": […]}`, JSON lines or
    plain text. Other valid JSON gives nothing; blank texts go; the end defaults to the start."""
    rows = once(files.select(key, F.col(body).alias("_body")), _doc=strict_json(F.col("_body")))
    kind = F.schema_of_variant(F.col("_doc"))
    inner = F.try_variant_get(F.col("_doc"), "$.segments", "variant")
    array = F.when(kind.startswith("ARRAY"), F.col("_doc")).when(F.schema_of_variant(inner).startswith("ARRAY"), inner)
    lines = F.filter(F.transform(F.split("_body", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parsed = F.transform(lines, strict_json)
    all_json = ~F.exists(parsed, lambda v: v.isNull())
    whole = F.col("_doc").isNotNull()
    items = F.when(whole, array.cast("array<variant>")).when(all_json, parsed)
    listed = rows.select(key, "_body", F.posexplode_outer(items).alias("pos", "v"), (~whole & ~all_json).alias("_plain"))
    get = lambda path, t: F.try_variant_get(F.col("v"), path, t)
    start = F.coalesce(get("$.start", "double"), F.lit(0.0)).cast("long")
    objects = listed.where(~F.col("_plain") & F.schema_of_variant("v").startswith("OBJECT")).select(
        key, "pos", start.alias("start"), F.coalesce(get("$.end", "double").cast("long"), start).alias("end"), tx.strip(F.coalesce(get("$.text", "string"), F.lit(""))).alias("text"))
    plain = listed.where("_plain").select(key, F.lit(0).alias("pos"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), tx.strip(F.col("_body")).alias("text"))
    return objects.unionByName(plain).where("text <> ''")


def normalize_requests(requests: DataFrame, doc: str, now: str) -> DataFrame:
    """Flat (old) and nested requests to one shape, with the first validation message."""
    d = F.col(doc)
    keys = F.json_object_keys(d)
    old = F.array_contains(keys, "PlayUrl") & ~F.array_contains(keys, "video_info")
    info = F.coalesce(truthy(F.get_json_object(d, "$.video_info")), truthy(F.get_json_object(d, "$.VideoInfo")))
    rows = once(requests, _old=old, _src=F.when(old, d).otherwise(F.coalesce(info, F.lit("{}"))), _info=info,
                video_url=F.when(old, field(d, "PlayUrl")).otherwise(F.coalesce(truthy(field(d, "video_url")), truthy(field(d, "play_url")), truthy(field(d, "PlayUrl")))))
    s = F.col("_src")
    has = F.json_object_keys(s)
    absent = F.lit(None).cast("string")
    for name in ("SectionNo", "TeamId", "Id"):
        absent = F.when(~F.array_contains(has, name), F.lit(name)).otherwise(absent)
    message = (F.when(F.col("_old") & truthy(F.col("video_url")).isNull(), "Missing required field: PlayUrl").when(F.col("_old"), F.concat(F.lit("Missing required field: "), absent))
               .when(F.col("video_url").isNull(), "Missing required field: video_url or play_url").when(F.col("_info").isNull(), "Missing required field: video_info")
               .otherwise(F.concat(F.lit("Missing required field in video_info: "), absent)))
    out = rows.select(*[c for c in requests.columns if c != doc], message.alias("message"), "video_url", field(s, "Id").alias("id"), field(s, "TeamId").alias("team_id"), field(s, "SectionNo").alias("section_no"),
                      F.when(F.col("_old"), field(s, "SectionTitle", F.lit(""))).otherwise(field(s, "SectionTitle")).alias("section_title"), field(s, "Units", F.lit("[]")).alias("units"),
                      field(s, "CreatedAt", F.lit(now)).alias("created_at"), field(s, "OriginalFilename", F.lit("video.mp4")).alias("original_filename"),
                      field(d, "num_questions", F.lit("10")).cast("int").alias("num_questions"), field(d, "num_pages", F.lit("3")).cast("int").alias("num_pages"),
                      field(d, "webhook_url").alias("webhook_url"), field(d, "skip_client_post", F.lit("false")).cast("boolean").alias("skip_client_post"))
    return out.withColumn("ok", F.col("message").isNull())


def caption_lines(maps: DataFrame) -> DataFrame:
    """`{"idx/total": caption}` per video to `HH:MM:SS: caption` lines in numeric order of idx."""
    rows = maps.select("video_id", "duration", F.explode(F.map_entries("captions")).alias("e"))
    parts = F.split("e.key", "/")
    idx, total = parts[0].cast("long"), parts[1].cast("long")
    return rows.select("video_id", idx.alias("idx"), F.concat(sec_to_hms(F.col("duration") * idx / total), F.lit(": "), "e.value").alias("line"))


def metadata_blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """`[CHAPTER]` opens a block, `key=value` lines fill it; lines before the first marker are a block
    too. START and END are milliseconds; the last value of a key counts. One file is one text cell."""
    lines = files.select("video_id", F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "line"))
    mark = F.col("line").startswith("[CHAPTER]")
    block = F.sum(mark.cast("int")).over(Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    pairs = lines.select("video_id", "pos", block.alias("block"), "line", mark.alias("m")).where(~F.col("m") & F.col("line").contains("=")).select(
        "video_id", "block", "pos", F.trim(F.split("line", "=", 2)[0]).alias("k"), F.trim(F.split("line", "=", 2)[1]).alias("v"))
    value = lambda k: F.max_by("v", F.when(F.col("k") == k, F.col("pos")))
    ms = lambda k: F.coalesce(value(k).cast("long"), F.lit(0)) / 1000.0
    return pairs.groupBy("video_id", "block").agg(ms("START").alias("start_sec"), ms("END").alias("end_sec"), F.coalesce(value("title"), F.lit("")).alias("title"))


# The two log messages that carry durations.
DURATION_LOG = r"Processing audio with duration\s+(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)"
REMOVED_LOG = r"VAD filter removed\s+(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)\s+of audio"


def log_durations(lines: DataFrame) -> DataFrame:
    """Last duration and last removed time per file of log lines `(file, line_no, line)`."""

    def last(pattern: str) -> Column:
        found = F.regexp_extract("line", pattern, 1)
        return F.max_by(F.when(found != "", hms_to_sec(found, "decimal")), F.when(found != "", F.col("line_no")))

    return lines.groupBy("file").agg(last(DURATION_LOG).alias("duration"), last(REMOVED_LOG).alias("removed"))


def read_predictions(spark: SparkSession, glob: str) -> DataFrame:
    """Prediction files `*/*.json` with `{"chapters": {stamp: title}}`; the video id is the file stem."""
    files = spark.read.schema("chapters map<string,string>").option("multiLine", True).json(glob)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    pairs = files.select(stem.alias("video_id"), F.explode(F.map_entries("chapters")).alias("e"))
    return pairs.select("video_id", F.col("e.key").alias("stamp"), F.col("e.value").alias("title"))
