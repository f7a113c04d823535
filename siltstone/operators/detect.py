"""Line detection: regex and entropy rules unrolled into one projection over the lines.

Every rule becomes an array of matches; the arrays are joined and exploded once, so lines are read once,
nothing is shuffled, and patterns are literals that Spark compiles once. Per rule the line must belong
to a file that the rule is for, and hold one of the rule's keywords, before a pattern is tried.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.regex import group_count, may_be_empty, to_java
from siltstone.functions.scalars import base_name, truncate

from .entropy import entropy_matches
from .rules import Rule, with_defaults

MATCH = "array<struct<rule_ord:int,pattern_ord:int,match_ord:int,value:string,entropy:double>>"
#: An engine adds to a line its matches for one rule: array<struct<value, entropy>>.
Engine = Callable[[Column, Rule], Column]


def allowed(value: Column, allowlist: Sequence[str]) -> Column:
    """Whether a value is on the allowlist: equal but for case, or holding an entry of four bytes or more."""
    low, tests = F.lower(value), F.lit(False)
    for entry in allowlist:
        e = entry.lower()
        tests = tests | ((low.contains(e)) if len(entry.encode()) >= 4 else (low == e))
    return tests


def in_bounds(value: Column, rule: Rule) -> Column:
    """Length limits in bytes; 0 is no limit."""
    n, ok = F.octet_length(value), F.lit(True)
    if rule.min_length > 0:
        ok = ok & (n >= rule.min_length)
    if rule.max_length > 0:
        ok = ok & (n <= rule.max_length)
    return ok


def regex_values(line: Column, pattern: str, rule: Rule) -> Column:
    """array<string>: what one pattern reports, in order, before allowlist and bounds."""
    java = to_java(pattern, rule.ignorecase)
    whole = F.regexp_extract_all(line, F.lit(java), F.lit(0))
    found = whole
    if 0 < rule.capture_group <= group_count(pattern):
        group = F.regexp_extract_all(line, F.lit(java), F.lit(rule.capture_group))
        found = F.zip_with(whole, group, lambda a, g: F.when(g == "", a).otherwise(g))
    if may_be_empty(pattern):
        # An empty match right behind another match does not count.
        found = F.filter(found, lambda v, i: ~((F.get(whole, i) == "") & (i > 0) & (F.get(whole, i - 1) != "")))
    return found


def regex_engine(line: Column, rule: Rule) -> Column:
    def of(number: int, pattern: str) -> Column:
        values = F.transform(regex_values(line, pattern, rule), lambda v, i: F.struct(F.lit(number).alias("pattern_ord"), i.alias("match_ord"), v.alias("value"), F.lit(None).cast("double").alias("entropy")))
        if rule.allowlist or rule.min_length > 0 or rule.max_length > 0:
            values = F.filter(values, lambda m: ~allowed(m["value"], rule.allowlist) & in_bounds(m["value"], rule))
        return values

    parts = [of(i, p) for i, p in enumerate(rule.patterns)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def entropy_engine(line: Column, rule: Rule) -> Column:
    found = entropy_matches(line, with_defaults(rule.entropy), lambda t: in_bounds(t, rule))
    found = F.filter(found, lambda m: ~allowed(m["value"], rule.allowlist))
    return F.transform(found, lambda m, i: F.struct(F.lit(0).alias("pattern_ord"), i.alias("match_ord"), m["value"].alias("value"), m["entropy"].alias("entropy")))


ENGINES: dict[str, Callable[[Column, Rule], Column]] = {"regex": regex_engine, "entropy": entropy_engine}


def engine_of(rule: Rule, engines: dict | None = None) -> tuple[str, Callable]:
    """The rule's engine; an empty or unknown name means regex."""
    known = ENGINES | (engines or {})
    name = rule.engine if rule.engine in known else "regex"
    return name, known[name]


def file_gate(base: Column, file_patterns: Sequence[str]) -> Column:
    """Whether a rule with these file patterns looks at a file of this base name."""
    ok = F.lit(False)
    for p in file_patterns:
        ok = ok | base.rlike(to_java(p))
    return ok if file_patterns else F.lit(True)


def with_gates(files: DataFrame, rules: Sequence[Rule], path: str = "file_path") -> DataFrame:
    """Add ``_gates``: for each distinct set of file patterns, whether the file is meant."""
    kinds = list(dict.fromkeys(r.file_patterns for r in rules if r.enabled))
    base = base_name(F.col(path))
    gates = F.array(*[file_gate(base, k) for k in kinds]) if kinds else F.array().cast("array<boolean>")
    return files.withColumn("_gates", gates)


def any_rule_applies(files: DataFrame, rules: Sequence[Rule], path: str = "file_path") -> DataFrame:
    """Only the files that some enabled rule is for."""
    return with_gates(files, rules, path).where(F.exists("_gates", lambda g: g)).drop("_gates")


def file_kinds(rules: Sequence[Rule]) -> list[tuple[str, ...]]:
    """The distinct sets of file patterns, in the order of ``_gates``."""
    return list(dict.fromkeys(r.file_patterns for r in rules if r.enabled))


def prepared(lines: DataFrame, rules: Sequence[Rule], gated: bool) -> DataFrame:
    """``lines`` with what ``matches`` reads: the gates, and the line in lower case."""
    rows = lines if "_gates" in lines.columns or not gated else with_gates(lines, rules)
    # The long s is the one letter whose lower case hides an ASCII letter from ``contains``.
    return rows.withColumn("_low", F.lower(F.translate("line", "ſ", "s")))


def matches(rules: Sequence[Rule], engines: dict | None = None, gated: bool = True) -> Column:
    """All rules' matches on the columns of ``prepared``, as one array."""
    kinds, line, parts = file_kinds(rules), F.col("line"), []
    for number, rule in enumerate(rules):
        if not rule.enabled or (engine_of(rule, engines)[0] == "regex" and not rule.patterns):
            continue
        name, engine = engine_of(rule, engines)
        made = _numbered(engine(line, rule), number)
        when = F.lit(True)
        if gated and rule.file_patterns:
            when = F.get("_gates", F.lit(kinds.index(rule.file_patterns)))
        if rule.keywords and name == "regex":
            holds = F.lit(False)
            for k in rule.keywords:
                holds = holds | F.col("_low").contains(k)
            when = when & holds
        parts.append(F.when(when, made).otherwise(F.array().cast(MATCH)))
    if not parts:
        parts = [F.array().cast(MATCH)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def about(rules: Sequence[Rule], engines: dict | None = None) -> Column:
    """What findings say of their rule, by its number."""
    if not rules:
        return F.array().cast("array<struct<id:string,name:string,severity:string,description:string,engine:string>>")
    return F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description"), F.lit(engine_of(r, engines)[0]).alias("engine")) for r in rules])


def finding(rule: Column) -> list[Column]:
    """The columns of a finding, from ``_found``, the line and what is said of the rule."""
    return [
        F.col("_found.rule_ord"), F.col("_found.pattern_ord"), F.col("_found.match_ord"),
        rule["id"].alias("rule_id"), rule["name"].alias("rule_name"), rule["severity"].alias("severity"),
        truncate(F.col("line"), 200).alias("line_content"), truncate(F.col("_found.value"), 100).alias("match"),
        rule["description"].alias("description"), rule["engine"].alias("engine_name"), F.col("_found.entropy").alias("entropy"),
    ]


def carried(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c not in ("line", "_gates")]


def detect(lines: DataFrame, rules: Sequence[Rule], engines: dict | None = None, gated: bool = True, keep_null: bool = False) -> DataFrame:
    """Findings of (file_path, line_number, line, ...): the columns of ``lines`` but the line, with
    rule_ord, pattern_ord, match_ord, rule_id, rule_name, severity, line_content, match, description,
    engine_name and entropy. ``gated=False`` leaves file names out of account; with ``keep_null`` a row
    without a line stays, as one without a finding."""
    rules = list(rules)
    rows = prepared(lines, rules, gated).withColumn("_found", (F.explode_outer if keep_null else F.explode)(matches(rules, engines, gated)))
    if keep_null:
        rows = rows.where(F.col("_found").isNotNull() | F.col("line").isNull())
    rule = F.get(about(rules, engines), F.col("_found.rule_ord"))
    return rows.select(*[F.col(f"`{c}`") for c in carried(lines)], *finding(rule))


def _numbered(found: Column, number: int) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(number).alias("rule_ord"), m["pattern_ord"].cast("int").alias("pattern_ord"), m["match_ord"].cast("int").alias("match_ord"), m["value"].alias("value"), m["entropy"].alias("entropy")))


def python_engine(match: Callable[[str], list[str]]) -> Callable[[Column, Rule], Column]:
    """Wrap ``line -> list of matches`` as an engine (an Arrow-batched UDF; the slow way)."""

    @F.pandas_udf("array<string>")
    def run(lines):
        return lines.map(lambda x: list(match(x)) if x is not None else [])

    def engine(line: Column, rule: Rule) -> Column:
        return F.transform(run(line), lambda v, i: F.struct(F.lit(0).alias("pattern_ord"), i.alias("match_ord"), v.alias("value"), F.lit(None).cast("double").alias("entropy")))

    return engine
