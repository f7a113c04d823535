"""Detection by a table of rules, for more rules than one expression should hold.

A rule needs words without which no pattern of it can match: its keywords, or what its patterns spell out
themselves. One Aho-Corasick automaton over the words of all rules reads each line once and names the rules
that are candidates for it; only those pairs are joined to the table of rules, and there the pattern is a
column. Nothing is shuffled, and the cost of a line doesn't grow with the number of rules. Rules without
such words, and those of other engines, are unrolled as ``detect`` does it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace
from re import _constants as codes
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.regex import group_count, may_be_empty, to_java
from siltstone.functions.scalars import base_name

from .detect import MATCH, about, carried, detect, engine_of, finding, matches, prepared
from .rules import Rule

#: Up to so many rules are unrolled into one expression.
UNROLLED = 200
#: A table of more patterns isn't broadcast.
BROADCAST = 200_000
REPEATS = (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT)
TABLE = (
    "_ord int, pattern_ord int, java string, grp int, hollow boolean, least int, most int, allow_part array<string>, allow_whole array<string>, files array<string>, "
    "t_id string, t_name string, t_severity string, t_description string"
)


def _best(sets: Iterable[set[str] | None]) -> set[str] | None:
    """Of sets of words the one whose shortest word is longest."""
    return max((s for s in sets if s), key=lambda s: min(map(len, s)), default=None)


def _needed(items) -> set[str] | None:
    """Words one of which every match holds, in lower case, if the parsed pattern spells any out."""
    found, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is codes.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        found.append({run} if run else None)
        run = ""
        if op is codes.SUBPATTERN:
            found.append(_needed(arg[3]))
        elif op is codes.ATOMIC_GROUP:
            found.append(_needed(arg))
        elif op in REPEATS and arg[0] > 0:
            found.append(_needed(arg[2]))
        elif op is codes.BRANCH:
            ways = [_needed(way) for way in arg[1]]
            found.append(set().union(*ways) if all(ways) else None)
    return _best(found)


def needed_words(pattern: str, least: int = 2) -> set[str] | None:
    """Words of ``least`` letters or more one of which every match of an RE2 pattern holds; None if that can't be told."""
    try:
        words = _needed(parser.parse(re.sub(r"\(\?[ims]+\)", "", pattern).replace(r"\z", r"\Z")))
    except (re.error, OverflowError):
        return None
    return words if words and min(map(len, words)) >= least else None


def words_of(rule: Rule) -> set[str] | None:
    """The words of a rule for the automaton."""
    if rule.keywords:
        return set(rule.keywords)
    ways = [needed_words(p) for p in rule.patterns]
    return set().union(*ways) if ways and all(ways) else None


def candidates(words: dict[str, tuple[int, ...]]):
    """array<int>: the rules of whose words a line (in lower case) holds one."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, numbers in words.items():
            automaton.add_word(word, numbers)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for line in batch.to_pylist():
                met = {n for _, n in automaton.iter(line)} if line and words else ()
                found.append(sorted({number for numbers in met for number in numbers}))
            yield pa.array(found, pa.list_(pa.int32()))

    return run


def rule_rows(rules: Sequence[tuple[int, Rule]]) -> list[tuple]:
    """A row of ``TABLE`` for each pattern."""
    rows = []
    for number, r in rules:
        low = [e.lower() for e in r.allowlist]
        part, whole = [e for e in low if len(e.encode()) >= 4], [e for e in low if len(e.encode()) < 4]
        files = [to_java(p) for p in r.file_patterns]
        for i, p in enumerate(r.patterns):
            group = r.capture_group if 0 < r.capture_group <= group_count(p) else 0
            rows.append((number, i, to_java(p, r.ignorecase), group, may_be_empty(p), r.min_length, r.max_length, part, whole, files, r.id, r.name, r.severity, r.description))
    return rows


def table_matches() -> Column:
    """Matches of the joined row's pattern on its line, as ``detect.matches`` has them."""
    line, grp = F.col("line"), F.col("grp")
    whole = F.regexp_extract_all(line, F.col("java"), F.lit(0))
    group = F.zip_with(whole, F.regexp_extract_all(line, F.col("java"), grp), lambda a, g: F.when(g == "", a).otherwise(g))
    found = F.when(grp > 0, group).otherwise(whole)
    # An empty match right behind another match does not count.
    full = F.filter(found, lambda v, i: ~((F.get(whole, i) == "") & (i > 0) & (F.get(whole, i - 1) != "")))
    fields = lambda v, i: [F.col("_ord").alias("rule_ord"), F.col("pattern_ord"), i.alias("match_ord"), v.alias("value"), F.lit(None).cast("double").alias("entropy")]
    numbered = F.transform(F.when(F.col("hollow"), full).otherwise(found), lambda v, i: F.struct(*fields(v, i)))

    def wanted(m: Column) -> Column:
        low, n = F.lower(m["value"]), F.octet_length(m["value"])
        listed = F.exists("allow_part", lambda e: F.contains(low, e)) | F.array_contains("allow_whole", low)
        return ~listed & ((F.col("least") <= 0) | (n >= F.col("least"))) & ((F.col("most") <= 0) | (n <= F.col("most")))

    return F.filter(numbered, wanted)


def detect_by_table(lines: DataFrame, rules: Sequence[Rule], engines: dict | None = None, gated: bool = True, keep_null: bool = False) -> DataFrame:
    """What ``detect`` gives, columns included, for any number of rules, in one narrow pass: a line goes on once
    for each candidate pattern, and once (as number -1) for all rules that are unrolled."""
    indexed, rest = {}, {}
    for number, rule in enumerate(rules):
        words = words_of(rule) if rule.enabled and rule.patterns and engine_of(rule, engines)[0] == "regex" else None
        if words:
            indexed[number] = words
        elif rule.enabled:
            rest[number] = rule
    by_word: dict[str, list[int]] = {}
    for number, words in indexed.items():
        for w in words:
            by_word.setdefault(w, []).append(number)
    rows = prepared(lines.drop("_gates"), list(rest.values()), gated).withColumn("_rules", candidates({w: tuple(n) for w, n in by_word.items()})(F.col("_low")))
    if gated:
        rows = rows.withColumn("_base", base_name(F.col("file_path")))
    once = F.array(F.lit(-1)) if rest or keep_null else F.array().cast("array<int>")
    known = rule_rows([(n, rules[n]) for n in indexed])
    table = lines.sparkSession.createDataFrame(known, TABLE)
    rows = rows.withColumn("_ord", F.explode(F.concat(once, "_rules"))).drop("_rules")
    rows = rows.join(F.broadcast(table) if len(known) <= BROADCAST else table, "_ord", "left")
    mine = F.col("_ord") >= 0
    when = mine & ((F.size("files") == 0) | F.exists("files", lambda p: F.regexp_like("_base", p))) if gated else mine
    # Numbers of the unrolled rules are their places in ``rest`` until here.
    numbers = F.array(*map(F.lit, rest)) if rest else F.array().cast("array<int>")
    unrolled = F.transform(matches(list(rest.values()), engines, gated), lambda m: m.withField("rule_ord", F.get(numbers, m["rule_ord"])))
    found = F.when(when, table_matches()).when(~mine, unrolled).otherwise(F.array().cast(MATCH)).cast(MATCH)
    rows = rows.withColumn("_found", (F.explode_outer if keep_null else F.explode)(found))
    if keep_null:
        rows = rows.where(F.col("_found").isNotNull() | (F.col("line").isNull() & ~mine))
    of_rest = F.get(about(list(rest.values()), engines), (F.array_position(numbers, F.col("_found.rule_ord")) - 1).cast("int"))
    of_table = F.struct(F.col("t_id").alias("id"), F.col("t_name").alias("name"), F.col("t_severity").alias("severity"), F.col("t_description").alias("description"), F.lit("regex").alias("engine"))
    return rows.select(*[F.col(f"`{c}`") for c in carried(lines)], *finding(F.when(mine, of_table).otherwise(of_rest)))


def find(lines: DataFrame, rules: Sequence[Rule], engines: dict | None = None, keep_null: bool = False) -> DataFrame:
    """Findings by the unrolled plan, or by the table if there are many rules; the same rows either way."""
    many = sum(r.enabled for r in rules) > UNROLLED
    return (detect_by_table if many else detect)(lines, rules, engines, keep_null=keep_null)
