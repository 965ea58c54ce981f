"""Prediction sets as a data source: one JSON file per video, named after it, in folders below one path.

    df.write.format("prediction_set").mode("append").save(path)       # video_id, stamp, title
    spark.read.format("prediction_set").load(path)
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "video_id string, stamp string, title string"
#: Files that one task reads.
FILES = 64


def opened(path: str):
    """File system and path of a URI or a plain path, as any task can open it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Files(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    """A partition per `files` files; a video's rows in the order of its file. Files that are no predictions fail by name."""

    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def partitions(self) -> list[Files]:
        store, path = opened(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        depth = path.rstrip("/").count("/") + 2
        names = sorted(f.path for f in found if f.is_file and f.extension == "json" and f.path.count("/") == depth)
        return [Files(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [Files([])]

    def read(self, partition: Files):
        store, _ = opened(self.path)
        for name in partition.names:
            with store.open_input_stream(name) as f:
                made = json.loads(f.read())
            if not isinstance(made, dict) or not isinstance(made.get("chapters"), dict):
                raise ValueError(f"{name} holds no chapters")
            video = name.rsplit("/", 1)[1].removesuffix(".json")
            for stamp, title in made["chapters"].items():
                yield video, stamp, title


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceWriter):
    """Rows come grouped by video. A repeated task writes the same files again."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        store, path = opened(self.path)
        names = []
        for video, own in groupby(rows, key=lambda r: r.video_id):
            if not video or "/" in video:
                raise ValueError(f"no file can be named {video!r}")
            folder = f"{path.rstrip('/')}/{video[:2]}"
            store.create_dir(folder, recursive=True)
            names.append(f"{folder}/{video}.json")
            with store.open_output_stream(names[-1]) as f:
                f.write(json.dumps({"chapters": {r.stamp: r.title for r in own}}, ensure_ascii=False).encode())
        return Written(names)

    def commit(self, messages: list) -> None:
        """Files are whole when their stream is closed; two tasks with one video would have overwritten each other."""
        names = [n for m in messages if m is not None for n in m.names]
        if len(set(names)) < len(names):
            raise ValueError("rows of one video came in several parts; use write_predictions")

    def abort(self, messages: list) -> None:
        store, _ = opened(self.path)
        for m in messages:
            for name in m.names if m is not None else []:
                store.delete_file(name)


class PredictionSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prediction_set"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("files", FILES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("prediction sets are appended to")
        return Writer(self.options["path"])


def write_predictions(chapters, path: str) -> None:
    """Chapters `(video_id, stamp, title)` as one file per video; a video's chapters in the order of their stamps."""
    chapters.sparkSession.dataSource.register(PredictionSet)
    rows = chapters.select("video_id", "stamp", "title").repartition("video_id").sortWithinPartitions("video_id", "stamp")
    rows.write.format("prediction_set").mode("append").save(path)


def read_prediction_set(spark, path: str):
    """Chapters `(video_id, stamp, title)` of `path/*/*.json`; the video id is the file's stem."""
    spark.dataSource.register(PredictionSet)
    return spark.read.format("prediction_set").load(path)
