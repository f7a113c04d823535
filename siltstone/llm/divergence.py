"""How far the sources of a language are apart in their use of terms, by an inverted index of corrections.

A pair of sources would cost one value for each of the language's V terms. Instead it starts at V times
the value of two zero counts. A source's own terms correct that for every partner by the histogram of its
counts (two terms of equal count correct alike); the postings of a term correct it for those pairs alone
that both have the term, by what the two one-sided corrections leave over. All values are whole numbers.

Texts are counted in the tasks that read them, with a bounded table that is emptied when full; sums go by
(lang, source, term), so neither a hot source nor a very common term meets in one task unadded.

Edge cases: null lang, source and text are ''; a group without terms has pairs, but no terms; a language
without kept terms has V = 0 and values of 0; repeated rows count as often as they occur; very long texts
are counted in slices; extra columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Lower case for A-Z and a space for the ASCII signs that no term holds; other bytes are parts of terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def count_terms(batches, most: int = 200_000):
    """(lang, source, term, occurrences, documents) over Arrow batches of (lang, source, text), and a row
    without a term for every group. The table in memory is handed on whenever it has ``most`` entries."""
    import pyarrow as pa

    found, documents, held = defaultdict(Counter), defaultdict(Counter), 0
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def emptied():
        for (lang, source), n in found.items():
            terms = [None, *n]
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                columns = [[lang] * len(part), [source] * len(part), pa.array(part, pa.binary()).cast(pa.string()), [n[t] for t in part], [documents[lang, source][t] for t in part]]
                yield pa.record_batch([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema, strict=True)], schema)
        found.clear()
        documents.clear()

    for batch in batches:
        lang, source, text = (batch.column(i) for i in range(3))
        for at, to in common.byte_slices(text):
            part = lambda column: column.slice(at, to - at)  # noqa: B023, E731
            for la, so, raw in zip(part(lang).to_pylist(), part(source).to_pylist(), part(text).cast(pa.binary()).to_pylist(), strict=True):
                n, seen = found[la, so], set()
                before = len(n)
                for piece in common.byte_chunks(raw.translate(LETTERS)):
                    words = piece.split()
                    n.update(words)
                    seen.update(words)
                documents[la, so].update(seen)
                held += len(n) - before
                if held >= most:
                    yield from emptied()
                    held = 0
    yield from emptied()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row
    without a term for the group itself."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.mapInArrow(common.frugal(count_terms), COUNTED)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rate(n: str, total: str, terms: str) -> Column:
    """The smoothed share of a term in whole billionths; decimals, since products may pass 64 bits."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(19,0))) div cast({total} + 2 * {terms} as decimal(20,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of sources of a language by the sum of values over
    its terms (``part`` pair), and each source's ``top_terms`` terms of higher share than in its language
    (``part`` term). A language keeps the terms that at least ``least_docs`` of its documents hold."""
    counted = common.materialize(counts(docs), "terms")
    of_term = Window.partitionBy("lang", "term")
    held = counted.where("term is not null").withColumn("_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    held = held.withColumn("_first", (F.min("source").over(of_term) == F.col("source")).cast("long"))
    held = common.materialize(held.where(F.col("_docs") >= least_docs).drop("_docs", "docs"), "postings")
    langs = held.groupBy("lang").agg(F.sum("_first").alias("v"), F.sum("n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("v", "lang_total", "total")])
    groups = common.materialize(groups.withColumn("p0", F.when(F.col("v") > 0, rate("0L", "total", "v")).otherwise(1)), "groups")
    shares = held.drop("_first").join(common.small(groups), ["lang", "source"]).withColumn("p", rate("n", "total", "v"))
    return term_ranks(shares, top_terms).unionByName(pair_ranks(groups, shares))


def term_ranks(shares: DataFrame, top_terms: int) -> DataFrame:
    over = shares.withColumn("q", rate("lang_n", "lang_total", "v")).where("p > q").withColumn("value", apart("p", "q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top_terms)  # Spark cuts to this many in every task before the exchange


def pair_ranks(groups: DataFrame, shares: DataFrame) -> DataFrame:
    other = common.small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    differ = F.col("source") != F.col("item")
    pairs = groups.join(other, "lang").where(differ).select("lang", "source", "item", (F.col("v") * apart("p0", "q0")).alias("value"))
    # Terms of the one source against the zero count of the other.
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    one = alike.join(other, "lang").where(differ).select("lang", "source", "item", (F.col("terms") * (apart("p", "q0") - apart("p0", "q0"))).alias("value")).where("value != 0")
    # Terms of both: the postings of a term against each other, each pair once.
    mine = shares.select("lang", "term", "source", "p", "p0")
    theirs = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    left = apart("p", "q") - apart("p", "q0") - apart("p0", "q") + apart("p0", "q0")
    both = mine.join(theirs, ["lang", "term"]).where("source < item").select("lang", "source", "item", left.alias("value")).where("value != 0")
    once = one.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    summed = pairs.unionByName(once).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
