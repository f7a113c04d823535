"""Shannon entropy of tokens in sliding windows, as higher-order functions without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Entropy

#: Cuts of a line into tokens; the padding sign is one, so it never is part of a token.
DELIMITERS = r"[ \t=:\"',;<>|]+"
CHARSETS = {"hex": r"\A[\p{Nd}a-fA-F]*\z", "ascii": r"\A[!-~]*\z"}
BASE64 = r"\A[\p{L}\p{Nd}+/=]*\z"


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, DELIMITERS), lambda t: t != "")


def in_charset(text: Column, charset: str) -> Column:
    """Membership; any name but hex and ascii means base64."""
    return text.rlike(CHARSETS.get(charset, BASE64))


def entropy(text: Column) -> Column:
    """Bits per character, 0 for the empty text, rounded to 9 places so that ties are ties."""
    return _bits(F.length(text), repeats(text))


def _bits(n: Column, repeated: Column) -> Column:
    """log2(n) less the mean of log2(count) over the characters; those that occur once add nothing."""
    lost = F.aggregate(repeated, F.lit(0.0), lambda total, r: total + F.length(r) * F.log2(F.length(r)))
    return F.when(n > 0, F.round(F.log2(n) - lost / n, 9)).otherwise(0.0)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def repeats(text: Column) -> Column:
    """The characters that occur more than once, each as a run of all its occurrences."""
    return F.regexp_extract_all(F.array_join(F.sort_array(characters(text)), ""), F.lit(r"(?s)(.)\1+"), F.lit(0))


def distinct(text: Column) -> Column:
    """The characters of a text, each once."""
    return F.array_distinct(characters(text))


#: Starts of windows that are scored together.
STRETCH = 512


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once, however often an expression uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(part: Column, first: Column, width: int, ascii_only: Column) -> Column:
    """All windows of ``width`` bytes of some bytes of a token that are whole characters, as struct<at, win>; the bytes
    start at place ``first`` of the token."""
    starts = F.sequence(F.lit(1), F.octet_length(part) - width + 1)
    text = lambda i: F.substring(part, i, F.lit(width)).cast("string")
    cut = F.transform(starts, lambda i: F.struct((first + i - 1).alias("at"), F.when(ascii_only, text(i)).otherwise(F.try_validate_utf8(text(i))).alias("win")))
    return F.filter(cut, lambda w: w["win"].isNotNull())


def entropy_matches(line: Column, cfg: Entropy, bounds: Callable[[Column], Column]) -> Column:
    """array<struct<value, entropy>>: for each token of a line its window of most entropy (the first
    of equals), if it reaches the threshold; entropy is rounded to three places."""

    # k different characters have log2(k) bits at most, so with fewer than this nothing is computed.
    least = math.ceil(2 ** (cfg.threshold - 1e-6))
    rich = lambda t: F.size(distinct(t)) >= least

    def likeliest(tried: Column, in_set: Column) -> Column:
        # A window of a token within the character set is within it too.
        fit = F.when(in_set, tried).otherwise(F.filter(tried, lambda w: in_charset(w["win"], cfg.charset)))
        counted = F.transform(fit, lambda w: F.struct(w["at"].alias("at"), w["win"].alias("win"), repeats(w["win"]).alias("again")))
        # Different characters: all of them, less the occurrences of one after its first.
        kinds = lambda w: F.length(w["win"]) - F.aggregate(w["again"], F.lit(0), lambda total, r: total + F.length(r) - 1)
        able = F.filter(counted, lambda w: kinds(w) >= least)
        scored = F.transform(able, lambda w: F.struct(_bits(F.length(w["win"]), w["again"]).alias("h"), (-w["at"]).alias("first"), w["win"].alias("win")))
        return F.array_max(scored)

    def by_stretches(token: Column) -> Column:
        # Windows are cut from a stretch's own bytes, which takes the same time wherever it lies, and no more than one
        # stretch's windows are held at a time.
        about = F.struct(token.cast("binary").alias("raw"), (F.octet_length(token) == F.length(token)).alias("ascii"), in_charset(token, cfg.charset).alias("in_set"))
        part = lambda t, first: F.substring(t["raw"], first, F.lit(STRETCH + cfg.window - 1))
        stretch = lambda t, first: once(part(t, first), lambda p: likeliest(windows(p, first, cfg.window, t["ascii"]), t["in_set"]))
        firsts = lambda t: F.sequence(F.lit(1), F.octet_length(t["raw"]) - cfg.window + 1, F.lit(STRETCH))
        return once(about, lambda t: F.array_max(F.transform(firsts(t), lambda first: stretch(t, first))))

    def best(token: Column) -> Column:
        whole = F.array(F.struct(F.lit(1).alias("at"), token.alias("win")))
        return F.when(F.octet_length(token) <= cfg.window, likeliest(whole, in_charset(token, cfg.charset))).otherwise(by_stretches(token))

    long = F.filter(tokens(line), lambda t: (F.octet_length(t) >= cfg.min_length) & bounds(t) & rich(t))
    found = F.filter(F.transform(long, best), lambda b: b.isNotNull() & (b["h"] >= cfg.threshold) & (b["h"] > 0))
    return F.transform(found, lambda b: F.struct(b["win"].alias("value"), F.round(b["h"], 3).alias("entropy")))
