"""Staging views: the given tables seen as timed segments, chapters, vectors and manifests."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.functions.timefmt import sec_to_hms
from cuewise.operators.ordered import BLOCK, fixed_blocks, scan


class Tables:
    """Lazy access to the given parquet tables and the staging views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table of long texts. A scan with fewer splits than cores is spread, since the work per row
        is heavy; a scan with enough splits is left alone, so large data is not shuffled for this."""
        df = self.read(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def documents(self) -> DataFrame:
        return self.texts("documents")

    @cached_property
    def seg(self) -> DataFrame:
        return self.read("conversations").select(
            F.col("conv_id").cast("string").alias("video_id"),
            F.col("turn").alias("seg_idx"),
            (F.col("turn") * 20).cast("double").alias("start_s"),
            ((F.col("turn") + 1) * 20).cast("double").alias("end_s"),
            F.translate("text", "\n", " ").alias("text"),
        )

    @cached_property
    def lin(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").cast("string").alias("video_id"),
            F.posexplode(F.split("text", "\n")).alias("line_no", "text"),
        ).select("video_id", "line_no", (F.col("line_no") * 15).cast("double").alias("start_s"), "text")

    @cached_property
    def _bounds(self) -> DataFrame:
        """First and last instant per user; both the time base and the duration come from this one pass."""
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.read("events").groupBy("user_id").agg(F.min(us).alias("us0"), F.max(us).alias("us1"))

    @cached_property
    def _timed(self) -> DataFrame:
        scale = F.lit(240000000.0)
        start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("us0")) / scale
        return self.read("events").join(self._bounds, "user_id").select(
            F.col("user_id").cast("string").alias("video_id"),
            "event_id",
            start.alias("start_s"),
            (start + F.col("value")).alias("end_s"),
            F.col("event_type").alias("text"),
            "value",
            "props",
            (F.floor((F.col("us1") - F.col("us0")) / scale) + 60).cast("int").alias("duration"),
        )

    @cached_property
    def evs(self) -> DataFrame:
        return self._timed.drop("duration")

    @cached_property
    def dur(self) -> DataFrame:
        span = F.floor((F.col("us1") - F.col("us0")) / F.lit(240000000.0)) + 60
        return self._bounds.select(F.col("user_id").cast("string").alias("video_id"), span.cast("int").alias("duration"))

    def _chapters(self, kind: str) -> DataFrame:
        """One chapter per distinct second, so at most one row per second of a video."""
        firsts = (
            self._timed.where(F.col("text") == kind)
            .groupBy("video_id", "duration", F.floor("start_s").alias("start_s"))
            .agg(F.min_by(F.struct("event_id", "props", "text"), F.struct("start_s", "event_id")).alias("e"))
        )
        w = Window.partitionBy("video_id").orderBy("start_s")
        return firsts.select(
            "video_id",
            (F.row_number().over(w) - 1).alias("idx"),
            "start_s",
            F.coalesce(F.lead("start_s").over(w), F.col("duration").cast("long")).alias("end_s"),
            F.concat_ws(" ", "e.text", F.get_json_object("e.props", "$.k")).alias("title"),
            F.col("e.event_id").alias("event_id"),
            "duration",
        )

    @cached_property
    def ref(self) -> DataFrame:
        return self._chapters("signup")

    @cached_property
    def pred(self) -> DataFrame:
        return self._chapters("purchase")

    @cached_property
    def uni(self) -> DataFrame:
        return self.ref.select(
            "video_id",
            F.nullif((F.col("event_id") % 6).cast("int"), F.lit(0)).alias("unit_no"),
            "title",
            sec_to_hms(F.col("start_s")).alias("time"),
            "start_s",
            "idx",
            "duration",
        )

    @cached_property
    def units(self) -> DataFrame:
        return self.dur.select("video_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("unit_no")).select(
            "video_id",
            "unit_no",
            F.concat(F.lit("unit "), F.col("unit_no")).alias("title"),
            F.when(F.col("unit_no") == 1, "00:00:00").otherwise("").alias("time"),
        )

    @cached_property
    def vec(self) -> DataFrame:
        rows = self.read("embeddings").select(F.col("label").cast("string").alias("video_id"), "vec_id", F.col("embedding").alias("vec"))
        ranked = scan(fixed_blocks(rows, "vec_id"), ["video_id"], ["vec_id"], number="_n")
        return ranked.select("video_id", "vec_id", (F.col("_n") - 1).cast("long").alias("pos"), "vec")

    @cached_property
    def man(self) -> DataFrame:
        labels = self.read("labels").select("doc_id", F.lit(True).alias("flag"))
        return self.documents.join(labels, "doc_id", "left").select(
            F.col("source").alias("team_id"),
            F.col("doc_id").cast("string").alias("video_id"),
            F.coalesce("flag", F.lit(False)).alias("has_chunks"),
        )


_CHAPTERS = """
SELECT video_id, row_number() OVER w - 1 AS idx, start_s,
       coalesce(lead(start_s) OVER w, CAST(duration AS BIGINT)) AS end_s,
       e.text || ' ' || json_extract_string(e.props, '$.k') AS title, e.event_id AS event_id, duration
FROM (SELECT video_id, CAST(floor(start_s) AS BIGINT) AS start_s,
             arg_min({{'event_id': event_id, 'props': props, 'text': text}}, start_s) AS e
      FROM evs WHERE text = '{kind}' GROUP BY 1, 2) JOIN dur USING (video_id)
WINDOW w AS (PARTITION BY video_id ORDER BY start_s)
"""

#: name -> (views it reads, DuckDB definition)
STAGE_SQL: dict[str, tuple[str, str]] = {
    "seg": ("", """
SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seg_idx, CAST(turn * 20 AS DOUBLE) AS start_s,
       CAST((turn + 1) * 20 AS DOUBLE) AS end_s, replace(text, chr(10), ' ') AS text FROM conversations"""),
    "lin": ("", """
SELECT video_id, line_no, CAST(line_no * 15 AS DOUBLE) AS start_s, text FROM (
  SELECT video_id, unnest(range(len(p))) AS line_no, unnest(p) AS text FROM (
    SELECT CAST(doc_id AS VARCHAR) AS video_id, string_split(text, chr(10)) AS p FROM documents))"""),
    "evs": ("", """
SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, start_s, start_s + value AS end_s,
       event_type AS text, value, props
FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 240000000.0::DOUBLE AS start_s FROM events)"""),
    "dur": ("evs", "SELECT video_id, CAST(floor(max(start_s)) AS INTEGER) + 60 AS duration FROM evs GROUP BY 1"),
    "ref": ("dur", _CHAPTERS.format(kind="signup")),
    "pred": ("dur", _CHAPTERS.format(kind="purchase")),
    "uni": ("ref", """
SELECT video_id, CAST(nullif(event_id % 6, 0) AS INTEGER) AS unit_no, title,
       printf('%02d:%02d:%02d', start_s // 3600, start_s % 3600 // 60, start_s % 60) AS time, start_s, idx, duration FROM ref"""),
    "units": ("dur", """
SELECT video_id, CAST(u AS INTEGER) AS unit_no, 'unit ' || u AS title, CASE WHEN u = 1 THEN '00:00:00' ELSE '' END AS time
FROM dur, range(1, 8) AS t(u)"""),
    "vec": ("", """
SELECT CAST(label AS VARCHAR) AS video_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
       embedding AS vec FROM embeddings"""),
    "man": ("", """
SELECT source AS team_id, CAST(d.doc_id AS VARCHAR) AS video_id, l.doc_id IS NOT NULL AS has_chunks
FROM documents d LEFT JOIN labels l USING (doc_id)"""),
}
