"""Batch and stream forms of admission, validity, overlapped chunks and the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewise.operators import folds as fo
from cuewise.operators import windows as wi
from cuewise.operators.chapters import absolute, overlapped_chunks, rebase
from cuewise.operators.ordered import density_blocks
from cuewise.plans.registry import query
from cuewise.session import work_dir
from cuewise.streaming import live

ADMIT_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, event_id, 1 AS c, us + 21600000000 AS reset, true AS allowed FROM o WHERE rn = 1
 UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN o.us > f.reset THEN 1 WHEN f.c >= 2 THEN f.c ELSE f.c + 1 END, CASE WHEN o.us > f.reset THEN o.us + 21600000000 ELSE f.reset END, o.us > f.reset OR f.c < 2 FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, event_id, allowed, CAST(CASE WHEN allowed THEN 2 - c ELSE 0 END AS INTEGER) AS remaining, reset AS reset_us FROM f"""


@query("m1_admission_control", "", ADMIT_SQL)
def m1(t):
    """Two requests per six hours, so that denials occur in the test table."""
    rows = t.read("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    out = fo.fold(density_blocks(rows, ["user_id"], "us", tie="event_id"), ["user_id"], ["us", "event_id"], ["event_id", "us"], fo.admission_step(2, 21600e6), "event_id long, allowed boolean, remaining int, reset_us double")
    return out.withColumn("reset_us", F.col("reset_us").cast("long"))


@query("m1_admission_control_stream", "", ADMIT_SQL)
def m1_stream(t):
    stream = live.event_stream(t.spark, t.sf_dir)
    return live.drain(live.admitted(stream, 2, 21600.0), work_dir(t.spark))


@query("m2_age_based_validity", "", """
SELECT event_id, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) <= 24 * 3600000000 AS usable, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) > 48 * 3600000000 AS expired FROM events WHERE ts <= TIMESTAMP '2024-01-20'""")
def m2(t):
    """Usable for 24 h, removed after 48 h, against a given time."""
    now = F.unix_micros(F.lit("2024-01-20 00:00:00").cast("timestamp"))
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = (now - ts) / F.lit(3600e6)
    return t.read("events").where(ts <= now).select("event_id", (hours <= 24).alias("usable"), (hours > 48).alias("expired"))


FRESH_SQL = f"SELECT user_id, event_id FROM ({ADMIT_SQL.replace('21600000000', '86400000000').replace('f.c >= 2', 'f.c >= 1').replace('f.c < 2', 'f.c < 1')}) WHERE allowed"


@query("m2_cache_batch", "", FRESH_SQL)
def m2_batch(t):
    """Requests that the cache can't answer: a user's first, and the first one over 24 h after the last such."""
    rows = t.read("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    out = fo.fold(density_blocks(rows, ["user_id"], "us", tie="event_id"), ["user_id"], ["us", "event_id"], ["event_id", "us"], fo.admission_step(1, 24 * 3600e6), "event_id long, allowed boolean, remaining int, reset_us double")
    return out.where("allowed").select("user_id", "event_id")


@query("m2_cache_stream", "", FRESH_SQL)
def m2_stream(t):
    """The same on a stream, with the end of each user's validity as state."""
    return live.drain(live.not_cached(live.event_stream(t.spark, t.sf_dir), 24), work_dir(t.spark))


# Hours that logs, requests, uploads and cached results are kept; events stand in for them by type.
KEEP = {"error": 2.0, "click": 6.0, "view": 8.0, "purchase": 48.0}
KEEP_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {round(h * 3600)}000000" for k, h in KEEP.items()) + " END"
DROP_SQL = f"""
WITH e AS (SELECT user_id, event_type AS kind, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events WHERE event_type IN ({", ".join(f"'{k}'" for k in KEEP)})),
k AS (SELECT *, us + {KEEP_SQL} AS fin FROM e), w AS (SELECT {{mark}} AS mark FROM events)
SELECT user_id, kind, us AS last_us, fin AS dropped_us FROM k, w WHERE CASE WHEN nxt IS NULL THEN {{fin}} <= mark ELSE nxt > fin END"""


@query("m2_retention", "", DROP_SQL.format(mark="max(epoch_us(ts))", fin="fin"))
def m2_retention(t):
    """Drops up to the last event of all."""
    e = t.read("events").select("user_id", F.col("event_type").alias("kind"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return wi.dropped_after(e, KEEP, e.agg(F.max("us")).scalar())


@query("m2_retention_stream", "", DROP_SQL.format(mark="epoch_us(date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE)", fin="(fin + 999) // 1000 * 1000"))
def m2_retention_stream(t):
    """The same on a stream, up to its watermark."""
    events = live.event_stream(t.spark, t.sf_dir).withColumnRenamed("event_type", "kind")
    return live.drain(live.dropped(events, KEEP), work_dir(t.spark))


@query("m3_overlapped_chunks", "dur evs", """
WITH c AS (SELECT video_id, k, k * 595.0::DOUBLE AS s, least(k * 595.0::DOUBLE + 600, duration) AS e FROM dur, range(400) AS r(k) WHERE k * 595 < duration),
p AS (SELECT c.video_id, c.k, event_id, greatest(v.start_s, c.s) AS a, least(v.end_s, c.e) AS b FROM c JOIN evs v ON v.video_id = c.video_id AND v.start_s < c.e AND (v.end_s > c.s OR v.start_s >= c.s) WHERE c.e > 100 AND c.s < 9000)
SELECT c.video_id, c.k AS chunk_no, c.s AS chunk_start, c.e AS chunk_end, count(event_id) AS n, round(min(a - c.s), 6) AS first_offset, round(max(b - c.s), 6) AS last_offset, round(min(a), 6) AS first_s, round(max(b), 6) AS last_s
FROM c LEFT JOIN p ON p.video_id = c.video_id AND p.k = c.k AND b > 100 AND a < 9000 GROUP BY ALL""")
def m3(t):
    """Chunks of 600 s with 5 s in common; of the signal, the time from 100 s to 9,000 s."""
    chunks = overlapped_chunks(t.dur, 600.0, 5.0)
    inside = absolute(rebase(t.evs.select("video_id", "start_s", "end_s").join(t.dur, "video_id"), 600.0, 5.0, 100.0, 9000.0), 600.0, 5.0)
    per = inside.groupBy("video_id", "chunk_no").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(k) for f, c, k in (
        (F.min, "offset_s", "first_offset"), (F.max, "offset_end_s", "last_offset"), (F.min, "start_s", "first_s"), (F.max, "end_s", "last_s"))])
    values = [F.round(c, 6).alias(c) for c in ("first_offset", "last_offset", "first_s", "last_s")]
    return chunks.join(per, ["video_id", "chunk_no"], "left").select("video_id", "chunk_no", "chunk_start", "chunk_end", F.coalesce("n", F.lit(0)).alias("n"), *values)


@query("m3_chunks_stream", "", """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS end_us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS origin_us FROM events),
w AS (SELECT epoch_us(date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE) AS mark FROM events),
c AS (SELECT *, us - origin_us AS a, end_us - origin_us AS b, unnest(range(greatest(0, (us - origin_us - 21600000000) // 21000000000), (end_us - origin_us) // 21000000000 + 1)) AS k FROM e),
p AS (SELECT *, greatest(a, k * 21000000000) - k * 21000000000 AS first_us, least(b, k * 21000000000 + 21600000000) - k * 21000000000 AS last_us FROM c WHERE a < k * 21000000000 + 21600000000 AND (b > k * 21000000000 OR a >= k * 21000000000))
SELECT user_id, k AS chunk_no, origin_us, count(*) AS n, min(first_us) AS first_us, max(last_us) AS last_us FROM p, w
WHERE k * 21000000000 + last_us > 3600000000 AND k * 21000000000 + 21600000000 > 3600000000 AND k * 21000000000 < 1728000000000 AND k * 21000000000 + first_us < 1728000000000 AND origin_us + k * 21000000000 + 21600000000 <= mark
GROUP BY ALL""")
def m3_stream(t):
    """Chunks of six hours, ten minutes in common, from each user's first event; the time from one hour to 20 days."""
    events = live.event_stream(t.spark, t.sf_dir).withColumn("end_us", F.unix_micros("ts") + F.round(F.col("value") * 1e6).cast("long"))
    return live.drain(live.chunk_parts(events, 21600.0, 600.0, 3600.0, 20 * 86400.0), work_dir(t.spark))


CLOSED_SQL = """
SELECT epoch_us(w) AS window_us, event_type AS endpoint, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS duration
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events){where} GROUP BY ALL"""
ALL_SQL = CLOSED_SQL.format(where="")
CLOSED_SQL = CLOSED_SQL.format(where=" WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)")


@query("m4_request_log_windows", "", ALL_SQL)
def m4(t):
    """Batch form: all windows, the open ones too; the stream form gives those its watermark has closed."""
    e = t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("endpoint")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("duration"))
    return rows.select(F.unix_micros("w.start").alias("window_us"), "endpoint", "requests", "errors", "duration")


@query("m4_request_log_stream", "", CLOSED_SQL)
def m4_stream(t):
    out = live.drain(live.request_windows(live.event_stream(t.spark, t.sf_dir)), work_dir(t.spark))
    return out.select(F.unix_micros("w.start").alias("window_us"), "endpoint", "requests", "errors", "duration")
