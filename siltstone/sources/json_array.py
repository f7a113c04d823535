"""A sink for one JSON array: tasks write parts, the commit joins them in the order of the partitions."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from siltstone.scratch import scratch_path


def local(path: str) -> str:
    """The path of a file in a folder that driver and tasks share."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"json_array writes to shared folders, not to {path}")
    return os.path.abspath(path)


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class JsonArrayWriter(DataSourceArrowWriter):
    """Writes a table of one string column, a JSON value in each row, as an array with a value on each line; a table without rows
    is ``null``. A part is named by task attempt, so a task that runs twice leaves one in the array, and the file
    is put in place when it is whole. A failed write leaves the old file alone."""

    def __init__(self, options: dict) -> None:
        self.path, self.parts = local(options["path"]), local(options["parts"])

    def write(self, iterator: Iterator) -> Part:
        context = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        path, rows = f"{self.parts}/{context.partitionId():08d}-{context.taskAttemptId()}", 0
        with open(path, "wb") as out:
            for batch in iterator:
                values = [v.encode() for v in batch.column(0).to_pylist() if v is not None]
                if values:
                    out.write((b",\n" if rows else b"") + b",\n".join(values))
                rows += len(values)
        return Part(context.partitionId(), path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        full = sorted((m for m in messages if m and m.rows), key=lambda m: m.number)
        with open(f"{self.path}.tmp", "wb") as out:
            for i, part in enumerate(full):
                out.write(b",\n" if i else b"[\n")
                with open(part.path, "rb") as rows:
                    shutil.copyfileobj(rows, out, 1 << 20)
            out.write(b"\n]\n" if full else b"null\n")
        os.replace(f"{self.path}.tmp", self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class JsonArraySink(DataSource):
    """``df.write.format("json_array").mode("overwrite").option("parts", shared folder).save(file)``."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "json string"

    def writer(self, schema, overwrite: bool) -> JsonArrayWriter:
        return JsonArrayWriter(self.options)


def write_array(rows: DataFrame, path: str) -> None:
    """Rows as one JSON array of objects in a file, in the order of their partitions."""
    rows.sparkSession.dataSource.register(JsonArraySink)
    values = rows.select(F.to_json(F.struct("*")).alias("json"))
    values.write.format("json_array").mode("append").option("parts", scratch_path(rows.sparkSession, "json-parts")).save(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such a file, read in splits like any text."""
    lines = spark.read.text(path).where(F.col("value").startswith("{"))
    return lines.select(F.from_json(F.regexp_replace("value", r",\z", ""), schema).alias("v")).select("v.*")
