"""Expansion of large zip containers entry by entry, so that one container is the work of many tasks.

First the central directories are read, which gives a row for each entry; the limits on entries, bytes and
ratio are running sums over those rows. Then the entries that are wanted are dealt to tasks by the bytes
before them, each task opens the container where it lies and reads the ranges of its own entries. A nested
archive is one entry, expanded where it is read; what it adds to the counts is summed in afterwards.

Rows and errors are those of ``archive.expand``, but that nothing behind the first entry over the limit on bytes
is taken, where ``expand`` goes on behind a nested archive that went over it. Paths must be such that
the tasks can open them (a shared folder, or a store that Arrow knows).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scalars import extension
from siltstone.scratch import scratch_path, written

from .archive import NESTED, SLICE, Expander, Limits, _ext, _wanted, looks_binary

#: Zip containers of more bytes are split.
LARGE = 64 << 20
STRETCH = 1 << 20
ENTRIES = "path string, ord long, name string, size long, fit boolean, opened boolean, error string"
UNITS = "path string, ord long, inner long, name string, text string, entries long, bytes long, error string"


def is_large(path: F.Column, length: F.Column, large: int = LARGE) -> F.Column:
    return extension(path).isin(*NESTED) & (length > large)


class Ranges(io.RawIOBase):
    """An Arrow file as Python's own files behave: a place before the start is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        start = {io.SEEK_SET: 0, io.SEEK_CUR: self.file.tell, io.SEEK_END: self.file.size}[whence]
        place = offset + (start if whence == io.SEEK_SET else start())
        if place < 0:
            raise OSError("place before the start of the file")
        self.file.seek(place)
        return place

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(path: str) -> io.BufferedReader:
    """A container as a file that is read in ranges."""
    from pyarrow import fs

    local = re.match(r"(?:file:)?(/.*)", path, re.S)
    if local:
        store, inside = fs.LocalFileSystem(), re.sub("^/+", "/", local[1])
    else:
        store, inside = fs.FileSystem.from_uri(quote(path, safe=":/@?=&"))
    return io.BufferedReader(Ranges(store.open_input_file(inside)), 1 << 20)


def directory(paths: DataFrame, limits: Limits) -> DataFrame:
    """A row of ``ENTRIES`` for each entry of the containers (path) that is a file, in order; one without a name for a container
    that can't be read. Entries beyond one more than the limit are left out."""

    def rows_of(path: str):
        try:
            with opened(path) as file, zipfile.ZipFile(file) as container:
                n = 0
                for info in container.infolist():
                    if info.is_dir():
                        continue
                    if n > limits.entries:
                        return
                    fit = info.file_size <= limits.total_bytes and not (info.compress_size > 0 and info.file_size // info.compress_size > limits.ratio)
                    error = None if fit else f"{info.filename}: skipped by size or ratio"
                    yield path, n, info.filename, info.file_size, fit, fit and (_ext(info.filename) in NESTED or _wanted(info.filename)), error
                    n += 1
        except Exception as e:
            yield path, -1, None, 0, False, False, f"{type(e).__name__}: {e}"

    return _mapped(paths.select("path"), lambda path: rows_of(path), ENTRIES)


def _mapped(rows: DataFrame, run, schema: str, held: int = 10_000) -> DataFrame:
    """``run`` of each row's values gives rows of ``schema``; sent in batches of ``held`` rows or ``SLICE`` bytes of text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wire = to_arrow_schema(T._parse_datatype_string(schema))

    def batches_of(batches):
        import pyarrow as pa

        packed = lambda out: pa.RecordBatch.from_pylist([dict(zip(wire.names, r, strict=True)) for r in out], schema=wire)
        out, size = [], 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in run(*values):
                    out.append(row)
                    size += sum(len(v) for v in row if isinstance(v, str))
                    if len(out) >= held or size >= SLICE:
                        yield packed(out)
                        out, size = [], 0
        if out:
            yield packed(out)

    return rows.mapInArrow(batches_of, schema)


def admitted(entries: DataFrame, limits: Limits) -> DataFrame:
    """Entries with the counts before them; ``over`` names the limit that an entry goes over, by what the directory declares."""
    before = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    counted = entries.where("ord >= 0").withColumn("before", F.coalesce(F.sum(F.when(F.col("fit"), F.col("size"))).over(before), F.lit(0)))
    over = F.when(F.col("ord") >= limits.entries, "too many entries").when(F.col("fit") & (F.col("before") + F.col("size") > limits.total_bytes), "too many bytes")
    return counted.withColumn("over", over)


def dealt(units: DataFrame) -> DataFrame:
    """Entries dealt to tasks, neighbours of about ``STRETCH`` declared bytes together."""
    spark = units.sparkSession
    total = units.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, min(100_000, total // (64 << 20)))
    stretch = F.expr(f"before div {STRETCH}")
    return units.repartition(tasks, "path", stretch).sortWithinPartitions("path", "ord").select("path", "ord", "name")


def units_read(units: DataFrame, limits: Limits) -> DataFrame:
    """Rows of ``UNITS``: each text of the entries (path, ord, name) with what a nested archive had counted when it came, and a row
    without a text that closes the entry."""

    class Reader:
        """The container of the last row, with its files by place."""

        path = container = None

        def read(self, path: str, at: int):
            if path != self.path:
                self.container = zipfile.ZipFile(opened(path))
                self.files = [i for i in self.container.infolist() if not i.is_dir()]
                self.path = path
            info = self.files[at]
            with self.container.open(info) as stream:
                return Expander(limits)._read(stream, info.file_size)

    def rows_of(path: str, at: int, name: str, reader):
        walker, n, error = Expander(limits), 0, None
        try:
            content = reader.read(path, at)
            if _ext(name) in NESTED:
                for inner, data in walker.zip(io.BytesIO(content), 1):
                    yield path, at, n, inner, data.decode("utf-8", "replace"), walker.entries, walker.bytes, None
                    n += 1
            elif not looks_binary(content, limits.sniffed):
                yield path, at, 0, name, content.decode("utf-8", "replace"), 0, 0, None
        except Exception as e:
            walker.errors.append(f"{name}: {e}")
        error = "; ".join(walker.errors) or None
        yield path, at, None, None, None, walker.entries, walker.bytes, error

    reader = Reader()
    return _mapped(dealt(units), lambda path, at, name: rows_of(path, at, name, reader), UNITS)


def expand_split(files: DataFrame, limits: Limits = Limits(), carried: Sequence[str] = (), markers: bool = False) -> DataFrame:
    """(container_path, entry_ord, file_path, text, error, ``carried``) of zip containers (path, ``carried``), as ``expand`` gives
    them; the directories and the texts are written once."""
    spark = files.sparkSession
    entries = written(directory(files.select("path"), limits), scratch_path(spark, "directories"))
    counted = admitted(entries, limits)
    read = written(units_read(counted.where(F.col("opened") & F.col("over").isNull()), limits), scratch_path(spark, "units"))
    closed = read.where("inner is null").select("path", "ord", F.col("entries").alias("more"), F.col("bytes").alias("more_bytes"), F.col("error").alias("unit_error"))
    texts = read.where("inner is not null").groupBy("path", "ord").agg(F.count("*").alias("texts"))
    # Slim rows, one for each entry: what came before it in its container, nested archives included.
    each = counted.join(closed, ["path", "ord"], "left").join(texts, ["path", "ord"], "left")
    earlier = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    each = each.select(
        "path", "ord", "size", "over", "error", "unit_error", "more", "more_bytes",
        (F.col("ord") + 1 + total("more")).alias("n"), (F.col("before") + total("more_bytes")).alias("bytes_before"), total("texts").alias("first"),
    )
    within = (F.col("n") <= limits.entries) & (F.col("bytes_before") + F.col("size") <= limits.total_bytes)
    each = written(each.withColumn("within", within), scratch_path(spark, "entries"))
    rows = read.where("inner is not null").join(each.select("path", "ord", "n", "bytes_before", "size", "first"), ["path", "ord"])
    rows = rows.where((F.col("n") + F.col("entries") <= limits.entries) & (F.col("bytes_before") + F.col("size") + F.col("bytes") <= limits.total_bytes))
    rows = rows.select("path", (F.col("first") + F.col("inner")).cast("int").alias("entry_ord"), F.col("name").alias("file_path"), "text", F.lit(None).cast("string").alias("error"))
    # An entry's own error, that of its reading, and the limit that it, or what is nested in it, goes over.
    inside = F.when(F.col("n") + F.coalesce("more", F.lit(0)) > limits.entries, "too many entries").when(F.col("bytes_before") + F.col("size") + F.coalesce("more_bytes", F.lit(0)) > limits.total_bytes, "too many bytes")
    fit = F.col("error").isNull()
    said = each.withColumn("says", F.when(F.col("n") > limits.entries, "too many entries").when(~fit, F.col("error")).when(~F.col("within"), "too many bytes").otherwise(F.coalesce("unit_error", inside)))
    stop = F.min(F.when((F.col("n") > limits.entries) | (fit & ~F.col("within")), F.col("ord"))).over(Window.partitionBy("path"))
    said = said.withColumn("_stop", stop).where(F.col("says").isNotNull() & (F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))))
    failed = entries.where("ord < 0").select("path", "ord", F.col("error").alias("says"))
    errors = said.select("path", "ord", "says").unionByName(failed).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "says"))), lambda s: s["says"]), "; ").alias("error"))
    count = rows.groupBy("path").agg(F.count("*").cast("int").alias("entry_ord"))
    about = files.select("path", *carried)
    closing = files.select("path").join(errors, "path", "left").join(count, "path", "left").where(F.lit(markers) | F.col("error").isNotNull())
    closing = closing.select("path", F.coalesce("entry_ord", F.lit(0)).alias("entry_ord"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("text"), "error")
    every = rows.unionByName(closing)
    every = every.join(F.broadcast(about) if not carried else about, "path") if carried else every
    return every.select(F.col("path").alias("container_path"), "entry_ord", "file_path", "text", "error", *carried)
