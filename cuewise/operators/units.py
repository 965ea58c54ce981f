"""Course units and suggested units. A video has at most one suggestion per chapter second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.text import strip
from cuewise.functions.timefmt import hms_to_sec, is_hms, sec_to_hms

# Unit markers in titles.
UNIT_IN_TITLE = r"(?U)(?:^\s*\[\s*單元\s*|\b單元\s*)(\d+)(?:\s*\]|\s*[:：])"
CLIENT_UNIT = r"(?U)\[\s*單元\s*(\d+)\s*[:：]"
UNIT_PREFIX = r"(?U)^\s*\[\s*單元\s*\d+\s*(?:[:：][^\]]+)?\]\s*"


def unit_key(client: Column, parent: Column, title: Column) -> Column:
    """Unit number of a suggestion: client number, else parent number, else the number in the title."""
    found = F.regexp_extract(strip(title), UNIT_IN_TITLE, 1)
    return F.coalesce(client, parent, F.when(found != "", found.cast("int")))


def _keyed(suggestions: DataFrame) -> DataFrame:
    return suggestions.select("video_id", unit_key(F.col("client_no"), F.col("parent_no"), F.col("title")).alias("unit_no"),
                              hms_to_sec(strip(F.coalesce("time", F.lit(""))), "null").alias("sec"))


def fill_times(units: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Earliest suggested time for units without one. `state` says what happened to the unit."""
    first = _keyed(suggestions).where("unit_no IS NOT NULL AND sec IS NOT NULL").groupBy("video_id", "unit_no").agg(F.min("sec").alias("sec"))
    rows = units.join(first, ["video_id", "unit_no"], "left")
    has = strip(F.coalesce("time", F.lit(""))) != ""
    state = F.when(has, "existing").when(F.col("sec").isNotNull(), "filled").otherwise("unmatched")
    return rows.select("video_id", "unit_no", "title", F.when(state == "filled", sec_to_hms(F.col("sec"))).otherwise(F.col("time")).alias("time"), state.alias("state"))


def fill_counters(units: DataFrame, suggestions: DataFrame) -> DataFrame:
    """The five counters of `fill_times`, per video."""
    u = fill_times(units, suggestions).groupBy("video_id").agg(
        F.count_if(F.col("state") == "filled").alias("filled_count"), F.count_if(F.col("state") == "existing").alias("skipped_existing_time"),
        F.count_if(F.col("state") == "unmatched").alias("unmatched_units"))
    s = _keyed(suggestions).groupBy("video_id").agg(
        F.count_if(F.col("unit_no").isNull()).alias("unmatched_suggested"), F.count_if(F.col("unit_no").isNotNull() & F.col("sec").isNull()).alias("invalid_suggested_times"))
    return u.join(s, "video_id", "left").fillna(0)


def normalize_suggestions(suggestions: DataFrame, units: DataFrame) -> DataFrame:
    """Valid suggestions with known client unit numbers only, their unit title, renumbered by time.

    `suggestions`: video_id, idx, title, time, parent_no, client_no. The number in the title is
    looked for after the unit prefix has been cut.
    """
    raw = strip(F.coalesce("title", F.lit("")))
    rows = suggestions.withColumn("time", strip(F.coalesce("time", F.lit("")))).where((raw != "") & is_hms(F.col("time")))
    rows = rows.withColumn("title", strip(F.regexp_replace(raw, UNIT_PREFIX, "")))
    found = F.regexp_extract("title", CLIENT_UNIT, 1)
    rows = rows.withColumn("unit_key", F.coalesce("client_no", F.when(found != "", found.cast("int"))))
    known = units.select("video_id", F.col("unit_no").alias("unit_key"), strip(F.col("title")).alias("client_title")).distinct()
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("time", "idx"))
    joined = rows.join(known.withColumn("_k", F.lit(True)), ["video_id", "unit_key"], "left")
    return joined.select("video_id", place.cast("long").alias("unit_no"), "parent_no", "title", "time",
                         F.when(F.col("_k"), F.col("unit_key")).alias("client_no"), F.when(F.col("_k") & (F.col("unit_key") != 0), F.col("client_title")).alias("client_title"))


def roll_up(units: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Units with first and last chapter, start, end (start of the next unit) and duration.

    `suggestions`: video_id, idx, unit_no, title, time. Units are in unit_no order.
    """
    at = F.struct(hms_to_sec(F.col("time"), "strict").alias("sec"), F.col("idx"))
    mapped = suggestions.where("unit_no IS NOT NULL").groupBy("video_id", "unit_no").agg(
        F.min_by("title", at).alias("first_chapter"), F.max_by("title", at).alias("last_chapter"),
        F.min_by("time", at).alias("start"), F.min(hms_to_sec(F.col("time"), "strict")).alias("start_s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("video_id").orderBy("unit_no")
    rows = units.select("video_id", "unit_no", "title").join(mapped, ["video_id", "unit_no"], "left")
    rows = rows.withColumn("end", F.lead("start").over(w)).withColumn("end_s", F.lead("start_s").over(w))
    found = F.col("start").isNotNull()
    span = F.col("end_s") - F.col("start_s")
    return rows.select("video_id", "unit_no", "title", F.coalesce("start", F.lit("")).alias("time"), F.when(found, F.col("end")).alias("end_time"),
                       F.when(found & (span != 0), sec_to_hms(span)).alias("duration"), F.coalesce("n", F.lit(0)).alias("n"), "first_chapter", "last_chapter")


def order_issues(enriched: DataFrame) -> DataFrame:
    """Units that do not start before the next unit, both times present."""
    w = Window.partitionBy("video_id").orderBy("unit_no")
    nxt = F.lead("time").over(w)
    a, b = hms_to_sec(F.col("time"), "strict"), hms_to_sec(F.col("_next"), "strict")
    return enriched.withColumn("_next", nxt).where((F.col("time") != "") & (F.col("_next") != "") & (a >= b)).select(
        "video_id", "unit_no", "time", F.col("_next").alias("next_time"))


def validate_units(rows: DataFrame) -> DataFrame:
    """First failing rule of a unit list, per video.

    Rows hold the raw JSON text of each field, null where the key is missing.
    """

    def kind(c: str) -> Column:
        v = F.col(c)
        return (F.when(v.rlike(r"^-?\d+$"), "int").when(v.rlike('^"'), "str").when(v.rlike(r"^-?\d+\.\d"), "float").when(v.isin("true", "false"), "bool")
                .when(v == "null", "NoneType").when(v.rlike(r"^\["), "list").otherwise("dict"))

    no, title = F.col("unit_json"), F.col("title_json")
    at = F.concat(F.lit("Unit at index "), F.col("idx"))
    number = F.when(no == "true", 1).when(no == "false", 0).otherwise(no.try_cast("long"))
    body = F.regexp_replace(title, r'^"|"$', "")
    message = (
        F.when(no.isNull(), F.concat(at, F.lit(" is missing 'UnitNo'")))
        .when(title.isNull(), F.concat(at, F.lit(" is missing 'Title'")))
        .when(~kind("unit_json").isin("int", "bool"), F.concat(at, F.lit(": 'UnitNo' must be an integer (got "), kind("unit_json"), F.lit(")")))
        .when(kind("title_json") != "str", F.concat(at, F.lit(": 'Title' must be a string (got "), kind("title_json"), F.lit(")")))
        .when(number < 1, F.concat(at, F.lit(": 'UnitNo' must be positive (got "), no, F.lit(")")))
        .when(strip(body) == "", F.concat(at, F.lit(": 'Title' cannot be empty"))))
    first = rows.withColumn("_m", message).groupBy("video_id").agg(F.min_by("_m", F.when(F.col("_m").isNotNull(), F.col("idx"))).alias("message"))
    return first.select("video_id", F.col("message").isNull().alias("ok"), "message")
