"""Admission control, request log windows, cache validity, retention and overlapped chunks on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuewise.operators.folds import admission_step


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Event files of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def admitted(stream: DataFrame, limit: int = 30, window: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """Fixed window per user from the first request after expiry: `(user_id, event_id, allowed, remaining, reset_us)`.

    The state is a count and an end time. Rows of one trigger are put in event order per user; a
    trigger is bounded by the source's rate limit. Rows behind the watermark are dropped: arrival
    order has no such notion, so that is this form's own choice.
    """
    step = admission_step(limit, window * 1e6)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"], kind="stable")
        start = [state.get[0], state.get[1]] if state.exists else None
        out, (count, reset) = step(start, list(zip(rows["event_id"].tolist(), [float(u) for u in rows["us"]])), False)
        state.update((count, reset))
        state.setTimeoutTimestamp(max(int(reset / 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": [o[0] for o in out], "allowed": [o[1] for o in out], "remaining": [o[2] for o in out], "reset_us": [int(o[3]) for o in out]})

    rows = stream.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, allowed boolean, remaining int, reset_us long", "count int, reset double", "append", GroupStateTimeout.EventTimeTimeout)


def request_windows(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests per endpoint and window: count, errors and total time; emitted once a window is closed."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("endpoint")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("duration"))


def not_cached(stream: DataFrame, hours: float = 24.0) -> DataFrame:
    """Requests `(user_id, event_id)` that a result kept for `hours` doesn't answer: one admission per user and window."""
    return admitted(stream, 1, hours * 3600.0).where("allowed").select("user_id", "event_id")


class Retention(StatefulProcessor):
    """When a thing that is touched now and then has lain untouched for longer than its kind may.

    The state is the last touch of each of an owner's kinds, in one value, with one timer at the earliest end of a time to
    live. After its end nothing is kept of a kind, and a later touch starts anew.
    """

    def __init__(self, keep: dict[str, float]):
        self.keep = {kind: round(hours * 3600e6) for kind, hours in keep.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "kinds array<string>, us array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # two short columns of one trigger
        found = [(pdf["kind"].to_numpy(object), pdf["us"].to_numpy()) for pdf in rows]
        kinds, us = (np.concatenate(x) for x in zip(*found))
        held = dict(zip(*self.last.get())) if self.last.exists() else {}
        due, gone = self._due(held), []
        for kind in sorted(set(kinds)):
            times = np.sort(us[kinds == kind])
            if kind in held:
                times = np.concatenate([[held[kind]], times[times >= held[kind]]])
            gone += [(kind, int(t)) for t in times[:-1][np.diff(times) > self.keep[kind]]]
            held[kind] = int(times[-1])
        self._keep(held, due)
        return self._dropped(key, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = dict(zip(*self.last.get()))
        gone = [(kind, us) for kind, us in held.items() if self._ends(kind, us) <= now]
        self._keep({kind: us for kind, us in held.items() if self._ends(kind, us) > now}, None)
        return self._dropped(key, gone)

    def _ends(self, kind: str, us: int) -> int:
        return -(-(us + self.keep[kind]) // 1000)

    def _due(self, held: dict[str, int]) -> int | None:
        return min((self._ends(*x) for x in held.items()), default=None)

    def _keep(self, held: dict[str, int], due: int | None) -> None:
        """`held` as the state, with its timer in place of the one at `due`."""
        if held:
            self.last.update((list(held), list(held.values())))
        else:
            self.last.clear()
        if (then := self._due(held)) != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if then is not None:
                self.handle.registerTimer(then)

    def _dropped(self, key, gone: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if gone:
            yield pd.DataFrame([(key[0], kind, us, us + self.keep[kind]) for kind, us in gone], columns=["user_id", "kind", "last_us", "dropped_us"])


def dropped(stream: DataFrame, keep: dict[str, float], delay: str = "10 minutes") -> DataFrame:
    """Drops `(user_id, kind, last_us, dropped_us)` of things `(user_id, kind, ts)` that are kept for `keep[kind]` hours from their
    last touch. A drop is reported once the watermark has passed it, or with the next touch. Other kinds are kept for good."""
    use_disk_state(stream.sparkSession)
    rows = stream.where(F.col("kind").isin(list(keep))).withWatermark("ts", delay).select("user_id", "kind", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(Retention(keep), "user_id long, kind string, last_us long, dropped_us long", "append", "EventTime")


def use_disk_state(spark: SparkSession) -> None:
    """State with timers is kept by the built-in store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ChunkParts(StatefulProcessor):
    """Counts and reach of the parts of rows in the overlapped chunks of a signal.

    A signal's time starts at its first row, so that instant is kept with it. Of each open chunk three numbers are
    kept. All stand in one value, so a signal costs one read and one write a trigger, however many chunks it has; one
    timer, in event time, stands at the end of its first open chunk, and hands on every chunk that the watermark has passed.
    What a signal keeps is the origin and the chunks that the watermark has not passed.
    """

    def __init__(self, size: int, overlap: int, start: int, end: int | None):
        self.size, self.step, self.start, self.end = size, size - overlap, start, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "us long, chunk_no array<bigint>, n array<bigint>, first_us array<bigint>, last_us array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # two short columns of one trigger
        found = [pdf[["us", "end_us"]].to_numpy(np.int64) for pdf in rows]
        us = np.concatenate(found)
        # the earliest row of the first trigger opens the signal
        origin, *old = self.held.get() if self.held.exists() else (int(us[:, 0].min()), [], [], [], [])
        old = [np.array(x, np.int64) for x in old]
        due = self._closes(origin, int(old[0].min())) if len(old[0]) else None
        self._keep(origin, self._merged(*(np.concatenate(x) for x in zip(old, self._parts(us[:, 0] - origin, us[:, 1] - origin)))), due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        origin, *old = self.held.get()
        old = [np.array(x, np.int64) for x in old]
        closed = self._closes(origin, old[0]) <= now
        self._keep(origin, [x[~closed] for x in old], None)
        no, n, first, last = (x[closed] for x in old)
        if len(no):
            yield pd.DataFrame({"user_id": key[0], "chunk_no": no, "origin_us": origin, "n": n, "first_us": first, "last_us": last})

    def _keep(self, origin: int, chunks: list[np.ndarray], due: int | None) -> None:
        """`chunks` as the state, with their timer in place of the one at `due`."""
        self.held.update((origin, *(x.tolist() for x in chunks)))
        then = self._closes(origin, int(chunks[0].min())) if len(chunks[0]) else None
        if then != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if then is not None:
                self.handle.registerTimer(then)

    def _closes(self, origin: int, no):
        """Milliseconds at which no row can start in the chunk any more."""
        return -(-(origin + no * self.step + self.size) // 1000)

    @staticmethod
    def _merged(no: np.ndarray, n: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """One entry per chunk number."""
        if not len(no):
            return [no, n, first, last]
        order = np.argsort(no, kind="stable")
        no, n, first, last = no[order], n[order], first[order], last[order]
        at = np.flatnonzero(np.diff(no, prepend=no[0] - 1))
        return [no[at], np.add.reduceat(n, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)]

    def _parts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Chunk number, 1, and clipped start and end of each row's part in every chunk. Rows before the origin don't count."""
        a, b = a[a >= 0], b[a >= 0]
        first = np.maximum(0, (a - self.size) // self.step + 1)
        last = np.maximum(a // self.step, -(-b // self.step) - 1)
        many = last - first + 1
        no = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        low = no * self.step
        start, end = np.maximum(np.repeat(a, many), low) - low, np.minimum(np.repeat(b, many), low + self.size) - low
        inside = (low + self.size > self.start) & (low + end > self.start)
        if self.end is not None:
            inside &= (low < self.end) & (low + start < self.end)
        return no[inside], np.ones(inside.sum(), np.int64), start[inside], end[inside]


def chunk_parts(stream: DataFrame, size: float = 600.0, overlap: float = 5.0, start: float = 0.0, end: float | None = None, delay: str = "10 minutes") -> DataFrame:
    """Overlapped chunks of each signal's rows, `(user_id, chunk_no, origin_us, n, first_us, last_us)`, each when it is closed.

    `stream (user_id, ts, end_us)`. Chunks start at the signal's first row, not at an epoch. `first_us` and `last_us`
    are the reach of the parts from the chunk's start; `start` and `end` clip the signal. Chunks without
    parts are not reported. Rows behind the watermark are dropped, as are rows before a signal's first one.
    """
    use_disk_state(stream.sparkSession)
    us = lambda s: None if s is None else round(s * 1e6)
    rows = stream.withWatermark("ts", delay).select("user_id", "ts", F.unix_micros("ts").alias("us"), "end_us")
    return rows.groupBy("user_id").transformWithStateInPandas(
        ChunkParts(us(size), us(overlap), us(start), us(end)), "user_id long, chunk_no long, origin_us long, n long, first_us long, last_us long", "append", "EventTime")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into a new folder and read it back."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
