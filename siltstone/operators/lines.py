"""Text to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line of this many bytes or more fails its file.
MAX_LINE_BYTES = 1 << 20


def line_array(text: Column) -> Column:
    """Lines of a text: cut at line feeds, one carriage return before a cut dropped, no empty line
    after the last cut, none for the empty text."""
    parts = F.split(text, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(kept)


def split_lines(files: DataFrame, text: str = "text", keep_null: bool = False) -> DataFrame:
    """A row per line: the columns of ``files`` but the text, with line_number (from 1) and line. With
    ``keep_null`` a file without a text has one row without a line."""
    others = [F.col(f"`{c}`") for c in files.columns if c != text]
    every = F.coalesce(line_array(F.col(text)), F.array(F.lit(None).cast("string"))) if keep_null else line_array(F.col(text))
    rows = files.select(*others, F.posexplode(every).alias("_at", "_line"))
    line = F.regexp_replace("_line", "\r\\z", "")
    return rows.withColumn("line_number", F.col("_at") + 1).withColumn("line", line).drop("_at", "_line")


def longest_line(text: Column) -> Column:
    """Bytes of the longest line before carriage returns are dropped."""
    return F.coalesce(F.array_max(F.transform(line_array(text), lambda x: F.octet_length(x))), F.lit(0))


def split_by_line_limit(files: DataFrame, text: str = "text", most: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files to scan, failed files): a file with a line of ``most`` bytes or more fails as a whole."""
    long = longest_line(F.col(text)) >= most
    failed = files.where(long).drop(text).withColumn("error", F.lit("token too long"))
    return files.where(~F.coalesce(long, F.lit(False))), failed
