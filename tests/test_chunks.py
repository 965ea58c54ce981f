"""Overlapped chunks in batch and on streams, and the prediction set as a source and a sink."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cuewise.operators.chapters import absolute, rebase
from cuewise.operators.windows import dropped_after
from cuewise.sources.predictions import read_prediction_set, write_predictions
from cuewise.streaming import live

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain_parts(rows, size, overlap, start, end, duration):
    """Chunk after chunk, as a recogniser would hear them: `(chunk, offset, end offset)`."""
    out, k = [], 0
    while k * (size - overlap) < duration:
        low = k * (size - overlap)
        high = min(low + size, duration)
        if high > start and (end is None or low < end):
            for a, b in rows:
                if a < high and (b > low or a >= low):
                    x, y = max(a, low), min(b, high)
                    if y > start and (end is None or x < end):
                        out.append((k, round(x - low, 6), round(y - low, 6)))
        k += 1
    return sorted(out)


@pytest.mark.parametrize("start, end", [(0.0, None), (33.0, 71.5), (500.0, None)])
def test_parts_of_rows(spark, start, end):
    rng = random.Random(4)
    rows = [(a, a + rng.choice([0.0, 1.5, 4.0, 25.0])) for a in (round(rng.random() * 130, 2) for _ in range(80))] + [(0.0, 0.0), (18.0, 20.0), (20.0, 20.0), (36.0, 40.0)]
    df = spark.createDataFrame([("v", a, b, 120) for a, b in rows], "video_id string, start_s double, end_s double, duration int")
    parts = rebase(df.where("start_s < 120"), 20.0, 2.0, start, end)
    got = sorted((r.chunk_no, round(r.offset_s, 6), round(r.offset_end_s, 6)) for r in parts.collect())
    assert got == plain_parts([r for r in rows if r[0] < 120], 20.0, 2.0, start, end, 120)
    back = absolute(parts.withColumnsRenamed({"start_s": "a", "end_s": "b"}), 20.0, 2.0).collect()
    assert all(r.start_s == pytest.approx(max(r.a, r.chunk_no * 18.0)) and r.end_s <= r.b + 1e-9 for r in back)


def stream_files(spark, folder, rows, files):
    """Events in time order, dealt over files that arrive one after the other."""
    rows = sorted(rows, key=lambda r: r[1])
    n = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * n : (k + 1) * n], "user_id long, ts timestamp, end_us long").coalesce(1)
        part.write.mode("append").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, tmp_path, files):
    """Over one trigger and over several; chunks that the watermark has not passed are not reported."""
    rng = random.Random(2)
    us = lambda t: int(t.timestamp() * 1e6)
    rows = []
    for user in (1, 2, 3):
        origin = START + timedelta(seconds=user * 37)
        for t in [0.0] + [rng.random() * 4000 for _ in range(60)]:
            at = origin + timedelta(seconds=round(t, 3))
            rows.append((user, at, us(at) + rng.choice([0, 500_000, 40_000_000, 700_000_000])))
    size, overlap, start, end = 600.0, 5.0, 100.0, 3000.0
    stream = stream_files(spark, str(tmp_path), rows, files)
    got = {(r.user_id, r.chunk_no): (r.origin_us, r.n, r.first_us, r.last_us) for r in live.drain(live.chunk_parts(stream, size, overlap, start, end, "1 minute"), f"{tmp_path}/out").collect()}
    mark = max(us(r[1]) for r in rows) // 1000 * 1000 - 60_000_000
    want = {}
    for user in (1, 2, 3):
        origin = min(us(r[1]) for r in rows if r[0] == user)
        own = [((us(r[1]) - origin) / 1e6, (r[2] - origin) / 1e6) for r in rows if r[0] == user]
        for k, a, b in plain_parts(own, size, overlap, start, end, 6000):
            if origin + (k * 595 + 600) * 1_000_000 <= mark:
                o, n, f, l = want.get((user, k), (origin, 0, 10**15, 0))
                want[user, k] = (o, n + 1, min(f, round(a * 1e6)), max(l, round(b * 1e6)))
    assert got == want and len(want) > 9


@pytest.mark.parametrize("files", [1, 5])
def test_retention_stream_equals_batch(spark, tmp_path, files):
    """Touches before and after the end, in one trigger and in several."""
    rng = random.Random(8)
    keep = {"short": 0.1, "long": 0.5}
    rows = []
    for user in (1, 2):
        for kind in ("short", "long", "for good"):
            t = 0.0
            for _ in range(25):
                t += rng.choice([1.0, 200.0, 360.0, 360.001, 1700.0, 1800.5, 4000.0])
                rows.append((user, kind, START + timedelta(seconds=t)))
    rows.sort(key=lambda r: r[2])
    n = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * n : (k + 1) * n], "user_id long, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, live.drain(live.dropped(stream, keep, "1 minute"), f"{tmp_path}/out").select("user_id", "kind", "last_us", "dropped_us").collect()))
    us = lambda t: int(t.timestamp() * 1e6)
    mark = us(rows[-1][2]) // 1000 * 1000 - 60_000_000
    batch = spark.createDataFrame([(u, k, i, us(t)) for i, (u, k, t) in enumerate(rows)], "user_id long, kind string, event_id long, us long")
    assert got == sorted(map(tuple, dropped_after(batch, keep, F.lit(mark)).select("user_id", "kind", "last_us", "dropped_us").collect())) and len(got) > 20


def test_prediction_set(spark, tmp_path):
    rows = [(f"v{i:03d}", f"00:00:{k:02d}", f"標題 {i} \"{k}\"") for i in range(70) for k in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "video_id string, stamp string, title string")
    write_predictions(df.repartition(5), f"file://{tmp_path}/set")
    files = sorted((tmp_path / "set").glob("*/*.json"))
    assert len(files) == 70 and json.loads(files[3].read_text())["chapters"] == {s: t for v, s, t in rows if v == "v003"}
    (tmp_path / "set" / "notes.json").write_text("[]")  # not a folder deep, so no prediction
    back = read_prediction_set(spark, f"{tmp_path}/set")
    assert sorted(map(tuple, back.collect())) == rows
    assert back.select(F.spark_partition_id()).distinct().count() == 2
    (tmp_path / "set" / "v0" / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="bad.json holds no chapters"):
        read_prediction_set(spark, f"{tmp_path}/set").collect()
    empty = tmp_path / "none"
    empty.mkdir()
    assert read_prediction_set(spark, str(empty)).count() == 0


def test_no_file_for_such_a_name(spark, tmp_path):
    with pytest.raises(Exception, match="no file can be named"):
        write_predictions(spark.createDataFrame([("a/b", "00:00:00", "x")], "video_id string, stamp string, title string"), str(tmp_path / "s"))
