"""Archive expansion: zip and tar containers to text entries, guarded against bombs."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scalars import base_name, extension

# What is scanned inside an archive and the limits of one.
SCANNABLE = (
    ".properties .xml .yml .yaml .json .conf .cfg .ini .config .toml .env .gradle .mvn .npmrc .pem .key .p12 .jks .pfx .crt .cer "
    ".sh .bat .cmd .ps1 .txt .md .rst .java .kt .groovy .scala .dockerfile .policy .bak .orig .old"
).split()
SCANNABLE_NAMES = "dockerfile jenkinsfile license env gitignore npmrc".split()
NESTED = (".jar", ".war", ".ear", ".zip")
# End of fixed values.


@dataclass(frozen=True)
class Limits:
    total_bytes: int = 1 << 30
    entries: int = 50_000
    depth: int = 5
    ratio: int = 100
    sniffed: int = 1024


def is_scannable(path: Column) -> Column:
    """Whether a file's extension, or its name if it has none, is one that is scanned."""
    ext = extension(path)
    return F.when(ext != "", ext.isin(*SCANNABLE)).otherwise(F.lower(base_name(path)).isin(*SCANNABLE_NAMES))


def looks_binary_column(content: Column, sniffed: int = 1024) -> Column:
    """``looks_binary`` on a binary column, by its hexadecimal form."""
    pairs = F.regexp_replace(F.hex(F.substring(content, 1, sniffed)), "(..)", "$1 ")
    size = F.least(F.octet_length(content), F.lit(sniffed))
    control = F.regexp_count(pairs, F.lit("(0[0-8]|0E|0F|1[0-9A-F]) "))
    return F.when(size == 0, False).otherwise((F.regexp_count(pairs, F.lit("00 ")) > 0) | (control / size > 0.3))


CONTROL = bytes(b for b in range(32) if b < 9 or b > 13)


def looks_binary(data: bytes, sniffed: int = 1024) -> bool:
    """A zero byte, or more than three tenths of control characters, among the first bytes."""
    head = data[:sniffed]
    control = len(head) - len(head.translate(None, CONTROL))
    return 0 in head or bool(head) and control / len(head) > 0.3


def _ext(name: str) -> str:
    base = name.rstrip("/").rsplit("/", 1)[-1]
    return "." + base.rsplit(".", 1)[1].lower() if "." in base else ""


def _wanted(name: str) -> bool:
    ext = _ext(name)
    return ext in SCANNABLE if ext else name.rstrip("/").rsplit("/", 1)[-1].lower() in SCANNABLE_NAMES


class Expander:
    """Walks one container; counters are shared with the archives nested in it."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.entries, self.bytes, self.errors = limits, 0, 0, []

    def _read(self, stream, declared: int) -> bytes:
        """At most what was declared, whatever the stream really holds."""
        data = stream.read(declared + 1)
        if len(data) > declared:
            raise ValueError("entry is larger than declared")
        return data

    def zip(self, data, depth: int = 0) -> Iterator[tuple[str, bytes]]:
        lim = self.limits
        with zipfile.ZipFile(data) as container:
            for info in container.infolist():
                if info.is_dir():
                    continue
                if self.entries >= lim.entries:
                    self.errors.append("too many entries")
                    return
                self.entries += 1
                if info.file_size > lim.total_bytes or (info.compress_size > 0 and info.file_size // info.compress_size > lim.ratio):
                    self.errors.append(f"{info.filename}: skipped by size or ratio")
                    continue
                if self.bytes + info.file_size > lim.total_bytes:
                    self.errors.append("too many bytes")
                    return
                self.bytes += info.file_size
                nested = depth < lim.depth and _ext(info.filename) in NESTED
                if not nested and not _wanted(info.filename):
                    continue
                try:
                    with container.open(info) as stream:
                        content = self._read(stream, info.file_size)
                    if nested:
                        yield from self.zip(io.BytesIO(content), depth + 1)
                    elif not looks_binary(content, lim.sniffed):
                        yield info.filename, content
                except Exception as e:  # one bad entry leaves its siblings alone
                    self.errors.append(f"{info.filename}: {e}")

    def tar(self, data, gzipped: bool) -> Iterator[tuple[str, bytes]]:
        lim = self.limits
        try:
            with tarfile.open(fileobj=data, mode="r|gz" if gzipped else "r|") as container:
                for info in container:
                    if not info.isfile():
                        continue
                    if self.entries >= lim.entries:
                        self.errors.append("too many entries")
                        return
                    self.entries += 1
                    if info.size > lim.total_bytes:
                        self.errors.append(f"{info.name}: skipped by size")
                        continue
                    if self.bytes + info.size > lim.total_bytes:
                        self.errors.append("too many bytes")
                        return
                    self.bytes += info.size
                    if not _wanted(info.name):
                        continue
                    content = self._read(container.extractfile(info), info.size)
                    if not looks_binary(content, lim.sniffed):
                        yield info.name, content
        except (tarfile.TarError, OSError, EOFError) as e:  # what came before it stays
            self.errors.append(str(e))


    def open(self, name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        """Entries of a container or plain file. Plain files pass whatever they hold."""
        ext = _ext(name)
        if ext in NESTED:
            return self.zip(io.BytesIO(content))
        if ext == ".tar" or ext in (".gz", ".tgz"):
            return self.tar(io.BytesIO(content), ext != ".tar")
        return iter([(name.rsplit("/", 1)[-1], content)])


def expand_bytes(name: str, content: bytes, limits: Limits = Limits()) -> tuple[list[tuple[str, bytes]], str | None]:
    """(entries, error) of one container or plain file."""
    walker = Expander(limits)
    try:
        found = list(walker.open(name, content))
    except Exception as e:
        return [], f"{type(e).__name__}: {e}"
    return found, "; ".join(walker.errors) or None


#: Bytes of text, and rows, that leave a task at once.
SLICE = 8 << 20
ROWS = 10_000


def expand(files: DataFrame, limits: Limits = Limits(), carried: Sequence[str] = (), markers: bool = False) -> DataFrame:
    """(container_path, entry_ord, file_path, text, error, ``carried``) of (path, content), as ``binaryFile``
    reads them. A container that fails, in part or whole, has a row with its error and no text, behind its
    entries; with ``markers`` every container has one. A file that comes with an ``error`` isn't opened.
    Rows of small containers leave a task together."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    given = F.col("error") if "error" in files.columns else F.lit(None)
    source = files.select("path", "content", given.cast("string").alias("error"), *carried)
    about = source.select(*carried).schema
    schema = T.StructType([*T._parse_datatype_string("container_path string, entry_ord int, file_path string, text string, error string").fields, *about.fields])
    wire = to_arrow_schema(schema)

    def run(batches):
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), wire, strict=True)], schema=wire)

        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                path, content, error, *others = (c[i].as_py() for c in batch.columns)
                walker, n = Expander(limits), 0
                if error is None:
                    try:
                        for name, data in walker.open(path, content or b""):
                            out.append((path, n, name, data.decode("utf-8", "replace"), None, *others))
                            n, held = n + 1, held + len(data)
                            if held >= SLICE or len(out) >= ROWS:
                                yield packed(out)
                                out, held = [], 0
                        error = "; ".join(walker.errors) or None
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                if error or markers:
                    out.append((path, n, None, None, error, *others))
            if out:
                yield packed(out)

    return source.mapInArrow(run, schema)
