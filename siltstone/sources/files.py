"""Artifacts from a mirrored folder in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.listing import ARTIFACTS
from siltstone.operators.split import opened


def read_files(spark: SparkSession, root: str, max_bytes: int = 0, suffixes: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """(path, modificationTime, length, content) of the files under ``root``. The size limit and the
    suffixes are pushed to the listing, so other files are never opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    files = reader.load(root)
    return files.where(F.col("length") <= max_bytes) if max_bytes > 0 else files


def oversize_files(spark: SparkSession, root: str, max_bytes: int, suffixes: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """The files over the limit, as ``read_files`` with an error in place of the content, which is not read."""
    files = read_files(spark, root, 0, suffixes).where(F.col("length") > max_bytes)
    error = F.concat(F.lit("too large: "), F.col("length").cast("string"), F.lit(f" bytes, limit {max_bytes}"))
    return files.select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), error.alias("error"))


def relative(files: DataFrame, root: str, column: str = "rel_path") -> DataFrame:
    """Add the path below ``root``."""
    bare = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    inside = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    return files.withColumn(column, F.regexp_replace(inside, "^.*?" + _quote("/" + bare.lstrip("/")) + "/", ""))


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def with_content(rows: DataFrame) -> DataFrame:
    """Rows of (path, error, ...) with the ``content`` of their files, read where the rows are; a file that can't be read
    has an error instead. Rows that come with an error aren't read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    wire = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                row = batch.slice(i, 1).to_pylist()[0] | {"content": None}
                if row["error"] is None:
                    try:
                        with opened(row["path"]) as file:
                            row["content"] = file.read()
                    except OSError as e:
                        row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=wire)

    return rows.mapInArrow(run, schema)
