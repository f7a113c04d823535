"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

The lexicon holds the terms whose inverse document frequency over all documents lies in a band. A
document keeps its terms in the lexicon, distinct and sorted, and gets one hash for each of several
random lexicon subsets: the hash of what it has in that subset. Subsets come in levels, from a
quarter of the lexicon down to a 4096th, so short and long texts alike have subsets that hold one or
two of their terms, and these survive an edit that leaves the terms alone. The likeness of two
fingerprints is the share of equal hashes among the subsets that either text has terms in, taken
from the level where it is largest (with at least ``LEAST`` such subsets, else over all levels).

The lexicon is bounded: each of its terms is in at least ``exp(-idf_high)`` of the documents, so
there are at most ``exp(idf_high)`` times the mean number of distinct terms. It is handed to the
tasks as a table of term hashes in buckets, and a Bloom filter of 32 bits a term (two probes) that spares
most other terms the look into the table; the band is kept exactly.

Edge cases: null text is empty text; a text with fewer than ``FEW`` terms in the lexicon keeps all its
terms; a text without terms has the empty fingerprint, like only to itself; repeated rows follow one
another (by text); null ids come last; a single row follows itself; a very long text is a row like others, whose
distinct terms a task holds at once; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import bucket, let

#: (bits that choose the subset, place of these bits in a term's hash, subsets kept)
LEVELS = ((2, 0, 4), (4, 2, 16), (6, 6, 16), (8, 12, 16), (10, 20, 16), (12, 30, 16))
LEAST, FEW = 4, 4


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: lower-case runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, idf_low: float, idf_high: float) -> DataFrame:
    """(h): term hashes whose document frequency is in the band and at least 2."""
    seen = docs.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    n = docs.count()
    low, high = max(2.0, n * math.exp(-idf_high)), max(2.0, n * math.exp(-idf_low))
    return seen.where(F.col("df").between(low, high)).select("h")


def bloom(lex: DataFrame) -> tuple[DataFrame, int]:
    """One row with the filter's bits as an array of longs, and the number of bits."""
    lex = common.materialize(lex, "lexicon")
    return common.materialize(bits_of(lex, bits := filter_size(lex.count())), "bloom"), bits


def filter_size(n: int) -> int:
    return 1 << max(10, math.ceil(math.log2(32 * max(1, n))))


def bits_of(lex: DataFrame, bits: int) -> DataFrame:
    places = lex.select(F.explode(F.array(*probes(F.col("h"), bits))).alias("at"))
    words = places.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
    every = lex.sparkSession.range(bits >> 6).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    whole = words.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))


def lookup(lex: DataFrame) -> tuple[DataFrame, int, int]:
    """One row with the struct ``lex`` of the filter's ``bits`` and the ``table`` of hashes by bucket; the
    numbers of bits and of buckets (about four hashes each)."""
    lex = common.materialize(lex, "lexicon")
    n = lex.count()
    bits, buckets = filter_size(n), 1 << max(0, math.ceil(math.log2(max(1, n) / 4)))
    dealt = lex.select(place(F.col("h"), buckets).alias("w"), "h").groupBy("w").agg(F.collect_list("h").alias("hs"))
    every = lex.sparkSession.range(buckets).select(F.col("id").alias("w"), F.array().cast("array<long>").alias("hs"))
    whole = dealt.unionByName(every).groupBy("w").agg(F.flatten(F.collect_list("hs")).alias("hs"))
    table = whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "hs"))), lambda x: x["hs"]).alias("table"))
    row = bits_of(lex, bits).select(F.struct("bits", table.scalar().alias("table")).alias("lex"))
    return common.materialize(row, "lookup"), bits, buckets


def place(h: Column, buckets: int) -> Column:
    return F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(buckets - 1))


def probes(h: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1)
    return [F.shiftrightunsigned(h, 40).bitwiseXOR(h).bitwiseAND(mask), F.shiftrightunsigned(h, 17).bitwiseXOR(F.shiftrightunsigned(h, 43)).bitwiseAND(mask)]


def fingerprint(text: Column, lex: Column, bits: int, buckets: int) -> Column:
    """array<int>: one 24-bit hash for each subset of each level, 0 where a text has no term."""

    def known(h: Column) -> Column:
        tests = [F.getbit(F.get(lex["bits"], F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in probes(h, bits)]
        return tests[0] & tests[1] & F.array_contains(F.get(lex["table"], place(h, buckets).cast("int")), h)

    def chosen(every: Column) -> Column:
        return let(F.filter(every, known), lambda kept: F.array_sort(F.when(F.size(kept) < FEW, every).otherwise(kept)))

    def hashed(own: Column) -> Column:
        return F.when(F.size(own) == 0, F.lit(0)).otherwise((F.pmod(F.xxhash64(own), F.lit((1 << 24) - 1)) + 1).cast("int"))

    def level(kept: Column, width: int, at: int, subsets: int) -> Column:
        subset = lambda h: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1))
        pool = F.filter(kept, lambda h: subset(h) < subsets) if subsets < 1 << width else kept
        ks = lambda n: F.array(*[F.lit(k).cast("long") for k in range(n)])
        part = lambda p, k: let(F.filter(p, lambda h: subset(h) == k), hashed)
        if subsets < 1 << width or subsets == 4:
            return let(pool, lambda p: F.transform(ks(subsets), lambda k: part(p, k)))
        # A subset of every term: by quarters first, so a term is looked at 4 + subsets / 4 times, not once for every subset.
        quarter = lambda p, q: F.filter(p, lambda h: F.shiftright(subset(h), 2) == q)
        return let(pool, lambda p: F.flatten(F.transform(ks(subsets // 4), lambda q: let(quarter(p, q), lambda own: F.transform(ks(4), lambda k: part(own, q * 4 + k))))))

    return let(let(terms(text), chosen), lambda kept: F.concat(*[level(kept, *x) for x in LEVELS]))


def likeness(a: Column, b: Column) -> Column:
    """Between 0 and 1; 1 for equal fingerprints."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None).cast("int")).otherwise((x == y).cast("int")))

    def by_level(v: Column) -> Column:
        parts, at = [], 1
        for _, _, subsets in LEVELS:
            parts.append(F.filter(F.slice(v, at, subsets), lambda x: x.isNotNull()))
            at += subsets
        parts = F.filter(F.array(*parts, F.filter(v, lambda x: x.isNotNull())), lambda p: F.size(p) > 0)
        share = lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x) / F.size(p)
        large = F.filter(parts, lambda p: F.size(p) >= LEAST)
        return F.array_max(F.transform(F.when(F.size(large) > 0, large).otherwise(parts), share))

    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(let(both, by_level), F.lit(0.0)))


def with_next(docs: DataFrame, mark=None, rows_each: int = 2048, least: int = 512, most: int = 1 << 16) -> DataFrame:
    """(doc_id, text) with next_text of the following row in descending doc_id, the last followed by
    the first; also fp and next_fp if ``mark`` adds a column fp of the text.

    Rows are dealt to buckets of doc_id by approximate quantiles (bounds, so any number of rows per
    bucket is right); each bucket also gets a copy of the next bucket's first row, so one exchange
    and a window inside the buckets do.
    """
    columns = ["text"] + ["fp"] * (mark is not None)
    edges = common.quantile_edges(docs, "doc_id", rows_each, least, most)
    placed = docs.withColumn("_bucket", bucket(F.col("doc_id"), edges))
    heads = placed.groupBy("_bucket").agg(F.max("doc_id").alias("_head"))
    down = Window.orderBy(F.col("_bucket").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = heads.select(F.col("_bucket").alias("_to"), F.coalesce(F.lead(F.struct("_head")).over(down), F.first(F.struct("_head")).over(whole))["_head"].alias("_id"))
    # ``ends`` has at most ``most`` + 1 rows of two numbers.
    both = placed.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    own, copy = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("g"))
    both = both.select("doc_id", "text", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("_at"))
    rows = both.select("doc_id", "text", F.col("_at.b").alias("_bucket"), F.col("_at.g").alias("_ghost"))
    rows = rows if mark is None else mark(rows, "text", "fp")
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "text")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return rows.select("doc_id", "_ghost", *columns, *following).where("_ghost = 0").drop("_ghost")


def written(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def fingerprints(docs: DataFrame, idf_low: float = 2.3, idf_high: float = 7.6) -> DataFrame:
    """Per row of (doc_id, text): n_chars, the fingerprint of the text and of its edited form, and
    their likenesses (see the query's contract)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    row, bits, buckets = lookup(lexicon(docs, idf_low, idf_high))

    def mark(rows: DataFrame, text: str, out: str) -> DataFrame:
        # The lexicon enters as a scalar subquery that the optimizer moves into the expression below,
        # where it is used once; it never is a column of rows that are copied.
        return rows.select("*", row.scalar().alias("_lex")).select(*rows.columns, let(F.col("_lex"), lambda lex: fingerprint(F.col(text), lex, bits, buckets)).alias(out))

    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, mark)
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = mark(rows, "edited", "efp")
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), "efp")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("fp")).alias("fingerprint"), written(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
