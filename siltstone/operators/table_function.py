"""Engines as table functions of SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def register_engine(spark: SparkSession, name: str, match: Callable[[str], Iterable[str]], line: str = "line") -> None:
    """Make ``line -> matches`` a table function: ``SELECT ... FROM name(TABLE(lines) PARTITION BY file_path)``.

    It gives the columns of its table but ``line``, with match_ord, from 0 in every line, and match. The schema follows from
    the table's; PARTITION BY deals the rows, and no row waits for others. A null line has no match.
    """

    class Engine:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or line not in table.dataType.fieldNames():
                raise ValueError(f"{name} takes TABLE(...) with a column {line}")
            kept = [f for f in table.dataType.fields if f.name != line]
            return AnalyzeResult(T.StructType([*kept, T.StructField("match_ord", T.IntegerType()), T.StructField("match", T.StringType())]))

        def eval(self, row: Row):
            values = row.asDict(recursive=False)
            text = values.pop(line)
            for i, found in enumerate(match(text) if text is not None else ()):
                yield (*values.values(), i, found)

    spark.udtf.register(name, F.udtf(Engine))
