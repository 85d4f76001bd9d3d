"""A priority queue of files as a streaming source: the highest scores first, each file taken once.

A queue is a folder score=<whole number>/<file of JSON lines>, as enqueue() writes it. When Spark asks for what there is to read, the source takes the
files of the highest scores that no earlier plan has, and writes their names down as the next numbered plan; offsets are the numbers of plans.
So a batch that is read again, by a retried task or after a restart, reads the same files. What a stream has committed leaves
the queue: its number is marked as done, then its files and plan go. A plan without that mark is what was taken and not committed: a stream
that goes on from its checkpoint reads on where it stopped, and a new one begins with those plans.

One stream at a time reads a queue. The driver lists names, not rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PLANS, DONE = "_plans", "_done"


def enqueue(items: DataFrame, path: str, score: Column) -> None:
    """Add items to a queue: files of rows of one score each. Null scores are 0."""
    held = items.select(F.coalesce(score.cast("long"), F.lit(0).cast("long")).alias("score"), F.to_json(F.struct(*items.columns)).alias("value"))
    held.repartition("score").write.mode("append").partitionBy("score").text(path)


class PriorityQueue(DataSource):
    """Options: path; files, the number of files that one look takes (1,000). Rows are (score, value JSON)."""

    @classmethod
    def name(cls) -> str:
        return "priority_queue"

    def schema(self) -> str:
        return "score long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


class _File(InputPartition):
    def __init__(self, score: int, path: str):
        super().__init__((score, path))
        self.score, self.path = score, path


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.files = options["path"], int(options.get("files", 1000))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _names(self, fs, folder: str) -> list[str]:
        from pyarrow.fs import FileSelector

        return [i.path for i in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if i.is_file and not i.base_name.startswith((".", "tmp"))]

    def _numbers(self, fs, root: str, kind: str) -> list[int]:
        return sorted(int(n.rpartition("/")[2]) for n in self._names(fs, f"{root}/{kind}"))

    def _put(self, fs, root: str, kind: str, number: int, text: str) -> None:
        """Write a file whole or not at all."""
        fs.create_dir(f"{root}/{kind}", recursive=True)
        at = f"{root}/{kind}/tmp{number:012d}"
        with fs.open_output_stream(at) as f:
            f.write(text.encode())
        fs.move(at, f"{root}/{kind}/{number:012d}")

    def _plan(self, fs, root: str, number: int) -> list[list]:
        with fs.open_input_stream(f"{root}/{PLANS}/{number:012d}") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        fs, root = self._open()
        return {"n": max(self._numbers(fs, root, DONE), default=0)}

    def latestOffset(self) -> dict:
        from pyarrow.fs import FileSelector, FileType

        fs, root = self._open()
        plans, done = self._numbers(fs, root, PLANS), max(self._numbers(fs, root, DONE), default=0)
        last = max([done, *plans])
        taken = {name for n in plans for _, name in self._plan(fs, root, n)}
        levels = {int(i.base_name.removeprefix("score=")): i.path for i in fs.get_file_info(FileSelector(root, allow_not_found=True)) if i.type == FileType.Directory and i.base_name.startswith("score=")}
        chosen: list[list] = []
        for score in sorted(levels, reverse=True):
            names = sorted(n for n in self._names(fs, levels[score]) if n not in taken and not n.rpartition("/")[2].startswith("_"))
            chosen += [[score, n] for n in names[: self.files - len(chosen)]]
            if len(chosen) == self.files:
                break
        if chosen:
            last += 1
            self._put(fs, root, PLANS, last, json.dumps(chosen))
        return {"n": last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        fs, root = self._open()
        held = set(self._numbers(fs, root, PLANS))
        return [_File(score, name) for n in range(start["n"] + 1, end["n"] + 1) if n in held for score, name in self._plan(fs, root, n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = self._open()
        with fs.open_input_stream(partition.path) as f:
            rest = b""
            while piece := f.read(1 << 20):
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    yield partition.score, line.decode()
            if rest:
                yield partition.score, rest.decode()

    def commit(self, end: dict) -> None:
        fs, root = self._open()
        if end["n"] > max(self._numbers(fs, root, DONE), default=0):
            self._put(fs, root, DONE, end["n"], "")
        for n in self._numbers(fs, root, PLANS):
            if n <= end["n"]:
                for _, name in self._plan(fs, root, n):
                    if fs.get_file_info(name).is_file:
                        fs.delete_file(name)
                fs.delete_file(f"{root}/{PLANS}/{n:012d}")
        for n in self._numbers(fs, root, DONE):
            if n < end["n"]:
                fs.delete_file(f"{root}/{DONE}/{n:012d}")


def queue_stream(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """The items of a queue as a stream: score, and the columns of schema."""
    spark.dataSource.register(PriorityQueue)
    rows = spark.readStream.format("priority_queue").option("path", path).option("files", files).load()
    return rows.select("score", F.from_json("value", schema).alias("_item")).select("score", "_item.*")
