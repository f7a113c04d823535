"""Documents that try every edge: nulls, empty, long, repeated rows, clashing extra columns."""

DOCS = [
    (7, "One two three four five six.", "en", "a", 28),
    (7, "One two three four five six.", "en", "a", 28),
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (None, "A row without an id", "en", "b", 19),
    (3, " \t\n ", "en", "b", 4),
    (4, "short", "en", "b", 5),
    (5, "un café İstanbul 日本語 \U0001f600 don't x@y.zz", "fr", "c", 40),
    (6, "word " * 30_000, "en", "a", 150_000),
    (9, "One two three four five six!", "en", None, 28),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    for name in ("_pid", "size", "row", "fp", "copies", "target", "node", "part", "value", "features"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
