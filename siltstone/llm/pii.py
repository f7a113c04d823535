"""Personal data by candidate generation and gradient-boosted selection, in SQL functions only.

Base patterns give spans that always stay. Further generators of high recall propose obfuscated
e-mail and IP addresses, numbers written without a plus sign and card numbers with other separators
or lengths; they may overlap. Boosted trees score each proposal by its form and the words before it;
what passes the kind's calibrated threshold and touches neither a base span nor a better proposal is
added. Everything happens inside a row: no exchange and no Python on the way of the texts.

The trees are fitted on ``FIT_SNIPPETS`` made-up snippets whose candidates and features come from
the same functions. A fifth of them is set aside: on it the scores are calibrated, and each kind's threshold
is the lowest one from which ``PRECISION`` of its proposals are right.

Work is linear in the length of a text, but for a logarithm, however many matches it has: offsets are
running sums in two levels, overlaps are found by bisection in lists of spans that are apart.

Matches are found by marking them (U+0001 around each match), so offsets are counted in code points;
a U+0001 in a text counts as U+0002 while matching, which no pattern tells apart. Patterns are
possessive where nothing is lost, so they take linear time and no deep recursion on long texts.

Edge cases: null text is empty text; an empty text has no spans; repeated rows and null ids are kept
as they are; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import random
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import let, running

KINDS = ("email", "ip", "card", "phone")
FIT_SNIPPETS = 3000
#: Share of right ones among the snippets set aside that a kind's threshold must reach.
PRECISION = 0.98
#: Code points before and behind a match that count as its context, and code points of a text's chunk.
BEFORE, AFTER, CHUNK = 24, 4, 1024
#: A cheap condition that every match of the kind's base pattern fulfils.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSALS = {
    "email": r"(?i)(?<![a-z0-9._%+-])(?:[a-z0-9_%+-]{1,32}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)){0,3}[a-z0-9._%+-]{2,64}+(?:\x20?(?:\(at\)|\[at\]|\{at\}|<at>|@)\x20?|\x20at\x20)[a-z0-9-]{1,63}+(?:(?:\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\x20?|\x20dot\x20)[a-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]|\.)\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00[1-9][0-9\x20().-]{6,18}[0-9]|\([0-9]{2,4}\)\x20?[0-9][0-9\x20.-]{4,11}[0-9]|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])",
}
#: A cheap condition that every text with a match of the kind's generator fulfils.
HINTS = {
    "email": r"(?i)(?:[(\[{<]at[)\]}>]|@|\x20at\x20)\x20?[a-z0-9-]",
    "ip": r"(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\])\x20?[0-9]",
    "card": r"[0-9](?:[\x20.-]?[0-9]){12}",
    "phone": r"[0-9]{3}[\x20.-][0-9]{3}|00[1-9]|\([0-9]{2,4}\)",
}
#: Words before a span that speak for a kind, and words that speak against any.
CONTEXT = {
    "email": r"(?i)(mail|contact|write|reach|correo|courriel)",
    "ip": r"(?i)(\bip\b|host|server|address|gateway|router)",
    "card": r"(?i)(card|visa|master|amex|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|dial|sms)",
}
AGAINST = r"(?i)(order|invoice|isbn|version|serial|ref|item|page|date|lines?|build|sku|id\b|#)"


def find(text: Column, pattern: str, context: bool = False) -> Column:
    """array<struct<s, e, m, before, after>>: start, end and string of every match, and with ``context`` the
    ``BEFORE`` code points before it and the ``AFTER`` behind it. Linear in the length of the text."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\u0001$0\u0001")), "\u0001", -1)

    def spans(parts: Column, at: Column) -> Column:
        # A match has at least six code points, so the parts between this one and the fourth match back hold enough.
        def around(i: Column) -> tuple[Column, Column]:
            left = F.transform(F.slice(parts, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8))), lambda p: F.right(p, F.lit(BEFORE)))
            right = F.transform(F.slice(parts, i + 2, 2), lambda p: F.left(p, F.lit(AFTER)))
            return F.right(F.array_join(left, ""), F.lit(BEFORE)), F.left(F.array_join(right, ""), F.lit(AFTER))

        def span(m: Column, i: Column) -> Column:
            before, after = around(i) if context else (F.lit(""), F.lit(""))
            return F.when(i % 2 == 1, F.struct(F.get(at, i).alias("s"), F.get(at, i + 1).alias("e"), m.alias("m"), before.alias("before"), after.alias("after")))

        return F.filter(F.transform(parts, span), lambda c: c.isNotNull())

    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
    lengths = lambda parts: F.transform(parts, lambda p: F.length(p))
    every = lambda parts: let(running(lengths(parts), lambda a, v: a + v), lambda at: spans(parts, at))
    return let(marked, lambda parts: F.when(F.size(parts) > 1, every(parts)).otherwise(none))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    values = F.transform(places, lambda c, i: F.when(i % 2 == 1, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def octets(m: Column) -> Column:
    """Whether all parts between non-digits are at most 255."""
    parts = F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: F.when(F.length(p) > 3, False).when(p == "", True).otherwise(p.cast("int") <= 255))


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return octets(m)
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


NAMES = ["is_email", "is_ip", "is_card", "is_phone", "digits", "length", "letters", "dots", "dashes", "blanks", "bracket", "luhn", "octets", "tail", "known_tail", "for", "against", "before_word", "after_word", "year", "kinds_of_digit", "plain_at"]


def describe(c: Column) -> Column:
    """array<double> of ``NAMES`` for a proposal struct<k, m, before, after>."""
    m, before, after, d, yes = c["m"], c["before"], c["after"], digits(c["m"]), lambda c: c.cast("double")
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    tail = F.regexp_extract(m, "([A-Za-z]+)$", 1)
    return F.array(
        *[yes(c["k"] == k) for k in range(len(KINDS))],
        F.length(d).cast("double"),
        F.length(m).cast("double"),
        count("[A-Za-z]"),
        count(r"\."),
        count("-"),
        count(r"\x20"),
        yes(m.rlike(r"[\[\](){}<>]")),
        yes(luhn(d)),
        yes(octets(m)),
        F.length(tail).cast("double"),
        yes(tail.isin("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")),
        yes(F.rlike(before, F.get(F.array(*[F.lit(CONTEXT[k]) for k in KINDS]), c["k"]))),
        yes(before.rlike(AGAINST)),
        yes(before.rlike("[A-Za-z0-9_/=-]$")),
        yes(after.rlike("^[A-Za-z0-9_/=-]")),
        yes(m.rlike("^(19|20)[0-9]{2}[^0-9]")),
        F.size(F.array_distinct(F.split(d, ""))).cast("double"),
        yes(m.rlike(r"(?i)[a-z0-9]\x20at\x20") & ~m.rlike(r"(?i)dot")),
    )


def base_spans(text: Column) -> Column:
    """Struct of one array<struct<s, e>> for each kind: the base spans, in order and apart from one another."""

    def of(kind: str) -> Column:
        made = F.transform(F.filter(find(text, BASE[kind]), lambda c: valid(kind, c["m"])), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
        return F.when(text.contains(NEEDS[kind]), made).otherwise(F.array().cast("array<struct<s:int,e:int>>"))

    return F.struct(*[of(kind).alias(kind) for kind in KINDS])


def leading(spans: Column, test) -> Column:
    """How many spans at the start of the array pass a test that the others fail (by bisection)."""
    powers = F.filter(F.array(*[F.lit(1 << i) for i in range(27, -1, -1)]), lambda p: p <= F.size(spans))
    step = lambda at, p: F.when(F.coalesce(test(F.get(spans, at + p - 1)), F.lit(False)), at + p).otherwise(at)
    return F.aggregate(powers, F.lit(0), step)


def touched(spans: Column, c: Column) -> Column:
    """Whether one of the spans, in order and apart from one another, overlaps ``c``."""
    first = F.get(spans, leading(spans, lambda b: b["e"] <= c["s"]))
    return F.when(F.size(spans) == 0, False).otherwise(F.coalesce(first["s"] < c["e"], F.lit(False)))


def proposals(text: Column, base: Column) -> Column:
    """array<struct<k, s, e, x>>: spans of the generators, by kind and start, that no base span overlaps, with their features."""

    def of(k: int, kind: str) -> Column:
        made = F.transform(find(text, PROPOSALS[kind], context=True), lambda c: F.struct(F.lit(k).alias("k"), *[c[n].alias(n) for n in ("s", "e", "m", "before", "after")]))
        return F.when(text.rlike(HINTS[kind]), made).otherwise(F.array().cast("array<struct<k:int,s:int,e:int,m:string,before:string,after:string>>"))

    alone = lambda c: ~reduce(or_, [touched(base[kind], c) for kind in KINDS])
    every = F.filter(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]), alone)
    return F.transform(every, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), describe(c).alias("x")))


def snippets(n: int = FIT_SNIPPETS, seed: int = 11) -> list[tuple[int, str, int, int, int]]:
    """Made-up texts with one span each: (id, text, start, end, kind or -1 if nothing private)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ou", "in", "st", "le"]) for _ in range(r.randint(1, 4)))
    some = lambda: " ".join(word() for _ in range(r.randint(0, 5)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def checked(k: int, good: bool) -> str:
        d = number(k - 1)
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d)))
        return d + str((-total + (0 if good else r.randint(1, 9))) % 10)

    def grouped(d: str, sep: str, k: int = 4) -> str:
        return sep.join(d[i : i + k] for i in range(0, len(d), k))

    found = []
    for i in range(n):
        kind = r.randrange(4)
        good = r.random() < 0.5
        lead = ""
        if kind == 0:
            ends = r.choice(["com", "org", "net", "de", "fr", "es"])
            style = r.choice(["b", "b", "w", "s"]) if good else "p"
            at, dot = {
                "b": (r.choice(["(at)", "[at]", " [at] ", " (at) ", "@"]), r.choice(["[dot]", " [dot] ", "(dot)"] + ["."] * (r.random() < 0.5))), "w": (" at ", " dot "),
                "s": (" @ ", r.choice([".", " . "])), "p": (" at ", r.choice([".", " dot "])),
            }[style]
            if at == "@" and dot == ".":
                dot = "(dot)"
            inner = r.choice(["", "", word() + (" dot " if style == "w" else dot if style == "b" and "dot" in dot else "_")])
            span = inner * good + word() + at + word() + dot + (ends if good else word().capitalize() if dot == "." else word() + "x")
            lead = r.choice(["mail ", "contact ", "write to ", ""]) if good else ""
        elif kind == 1:
            dot = r.choice(["[.]", "(.)", "[dot]", " (dot) ", " . "])
            top = 255 if good else 999
            parts = [r.randint(0, top) for _ in range(4)]
            if not good:
                parts[r.randrange(4)] = r.randint(256, 999)
            span = dot.join(map(str, parts))
            lead = r.choice(["host ", "ip ", ""])
        elif kind == 2:
            size = r.choice([13, 14, 15, 16])
            span = grouped(checked(size, good), r.choice(["", ".", " ", "-"]))
            lead = r.choice(["card ", "visa ", "payment card "]) if good else r.choice(["order ", "isbn ", "serial ", "", "", "id "])
            if good and r.random() < 0.15:
                lead, good = "", False
        else:
            sep = r.choice([" ", "-", "."])
            span = r.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}{sep}{number(3)}{sep}{number(4)}", f"00{r.randint(1, 9)}{number(1)} {number(3)} {number(4)}"])
            if good:
                lead = r.choice(["tel ", "call ", "phone: ", "mobile "])
            else:
                lead = r.choice(["order ", "ref ", "item ", "version ", "", ""])
        before = f"{some()} {lead}".lstrip()
        found.append((i, f"{before}{span} {some()}", len(before), len(before) + len(span), kind if good else -1))
    return found


def cut(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest probability from which at least ``precision`` of the rows are right, halfway to the
    next lower one; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    ends = np.flatnonzero(np.r_[p[1:] < p[:-1], True]) if len(p) else np.empty(0, int)  # equal scores go together
    good = ends[np.cumsum(y)[ends] >= precision * (ends + 1)]
    if not len(good):
        return 2.0
    at = good[-1]
    return float((p[at] + p[at + 1]) / 2 if at + 1 < len(p) else p[at])


@lru_cache(maxsize=1)
def _model(app: str) -> tuple[boosting.Forest, dict[str, float]]:
    spark = SparkSession.active()
    made = spark.createDataFrame(snippets(), "id int, text string, s int, e int, kind int").withColumn("base", base_spans(F.col("text")))
    made = made.withColumn("made", proposals(F.col("text"), F.col("base")))
    rows = made.select("id", "s", "e", "kind", F.explode("made").alias("c")).orderBy("id", "c.k", "c.s").collect()
    x = np.array([r.c.x for r in rows], np.float64)
    y = np.array([float(r.c.k == r.kind and r.c.s < r.e and r.s < r.c.e) for r in rows])
    forest, kinds, aside = boosting.fit(x, y), np.array([r.c.k for r in rows]), boosting.set_aside(len(y))
    p = boosting.predict(forest, x)
    return forest, {kind: cut(p[aside & (kinds == k)], y[aside & (kinds == k)]) for k, kind in enumerate(KINDS)}


def model(spark: SparkSession) -> tuple[boosting.Forest, dict[str, float]]:
    """The fitted trees and each kind's threshold; the same snippets and seed give the same every time."""
    return _model(spark.sparkContext.applicationId)


def chosen(made: Column, forest: boosting.Forest, limits: dict[str, float]) -> Column:
    """array<struct<k, s, e>>: proposals that pass their kind's threshold and overlap no better one."""
    scored = F.transform(made, lambda c: F.struct(boosting.as_column(forest, c["x"]).alias("p"), c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    passing = F.filter(scored, lambda c: c["p"] >= F.get(F.array(*[F.lit(limits[k]) for k in KINDS]), c["k"]))
    better = lambda a, b: (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["s"] < b["s"]) | ((a["s"] == b["s"]) & (a["k"] < b["k"]))))

    def beaten(others: Column, c: Column) -> Column:
        # Spans of one kind are apart, so all kinds' overlapping pairs together are no more than spans.
        first, end = leading(others, lambda d: d["e"] <= c["s"]), leading(others, lambda d: d["s"] < c["e"])
        return F.when(F.size(others) == 0, False).otherwise(F.exists(F.slice(others, first + 1, F.greatest(end - first, F.lit(0))), lambda d: better(d, c)))

    def best(good: Column) -> Column:
        is_of = lambda k: lambda c: c["k"] == k
        by_kind = F.struct(*[F.filter(good, is_of(k)).alias(kind) for k, kind in enumerate(KINDS)])
        kept = lambda of: F.filter(good, lambda c: ~reduce(or_, [beaten(of[kind], c) for kind in KINDS]))
        return F.transform(let(by_kind, kept), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))

    return let(passing, lambda good: F.when(F.size(good) > 1, best(good)).otherwise(F.transform(good, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))))


def spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the struct ``out``: ``base`` and ``all``, each array<struct<k, s, e>> by kind and start."""
    fitted = model(docs.sparkSession)
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "\u0001", "\u0002")

    def both(base: Column, t: Column) -> Column:
        mark = lambda k: lambda c: F.struct(F.lit(k).alias("k"), c["s"].alias("s"), c["e"].alias("e"))
        flat = F.concat(*[F.transform(base[kind], mark(k)) for k, kind in enumerate(KINDS)])
        added = let(proposals(t, base), lambda made: chosen(made, *fitted))
        return let(flat, lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, added)).alias("all")))

    return docs.withColumn(out, let(plain, lambda t: let(base_spans(t), lambda base: both(base, t))))


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"], c["e"])), ",")


def replaced(t: Column, found: Column) -> Column:
    """The text with ``found`` (struct<k, s, e>) replaced; see ``redacted``. Linear in its length."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.transform(F.array_sort(F.transform(found, lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("to"), c["k"].alias("k")))), lambda c: F.struct(c["s"].alias("s"), (-c["to"]).alias("e"), c["k"].alias("k")))

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        tail = F.substring(F.get(chunks, i), a % CHUNK + 1, F.lit(CHUNK))
        head = F.coalesce(F.substring(F.get(chunks, j), F.lit(1), b % CHUNK), F.lit(""))
        far = F.concat(tail, F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), head)
        return F.when(b <= a, "").when(i == j, F.substring(F.get(chunks, i), a % CHUNK + 1, b - a)).otherwise(far)

    def whole(spans: Column, ends: Column, chunks: Column) -> Column:
        # ends[i]: how far the spans before the i-th reach; a span that starts inside them has no tag of its own.
        tags = F.transform(spans, lambda c, i: F.when(c["s"] >= F.get(ends, i), F.concat(piece(chunks, F.get(ends, i), c["s"]), F.get(names, c["k"]))).otherwise(""))
        return F.concat(F.array_join(tags, ""), piece(chunks, F.element_at(ends, -1), F.length(t)))

    chunks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))
    reach = lambda spans: running(F.transform(spans, lambda c: c["e"]), lambda a, v: F.greatest(a, v))
    return let(ordered, lambda spans: let(reach(spans), lambda ends: let(chunks, lambda parts: whole(spans, ends, parts))))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; spans that overlap are
    replaced once, by the kind of the one that starts first (of these the longest). Null texts stay null; columns stay as they are."""
    inner = spans(docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("t")), "t", "pii")
    new = F.when(F.size(F.col("pii")["all"]) > 0, replaced(F.col("t"), F.col("pii")["all"])).otherwise(F.col("t"))
    return inner.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, per row of (doc_id, text)."""
    rows = spans(docs.select("doc_id", "text")).drop("text")
    base = F.col("pii")["base"]
    of = lambda k: F.size(F.filter(base, lambda c: c["k"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")["all"]).alias("spans"))
