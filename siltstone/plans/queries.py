"""Registered queries of the scanning engine, each over whole tables, and the same in DuckDB's SQL.

The history tables of the queries are made from the driver's tables: ``customer`` gives artifacts and
secret lines (see ``operators.corpus``), ``orders`` scan records, ``lineitem`` findings, ``supplier``
tasks, ``part`` cached files.
"""

from __future__ import annotations

import datetime
import functools
import io
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars
from siltstone.operators import archive, batching, detect, entropy, lines, listing, rule_table, rules, split, summary, table_function
from siltstone.operators.corpus import corpus_sql, secret_lines
from siltstone.scratch import scratch_path, written
from siltstone.sources import json_array
from siltstone.streaming import attempts as attempt_stream

from . import report, scan, state, store, tasks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_lines(table(spark, sf_dir, "customer"))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_like(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")" if words else "true"


CORPUS = f"corpus AS ({corpus_sql('VARCHAR')})"


def findings_sql(rule_list, source: str = "corpus", path: str = "file_path", line: str = "line", key: str = "k", gated: bool = True) -> str:
    """Regex findings of ``source`` in RE2, one SELECT for each rule and pattern."""
    parts = []
    for r in rule_list:
        for p in r.patterns:
            gate = " OR ".join(f"regexp_matches({path}, {q(f)})" for f in r.file_patterns) if gated and r.file_patterns else "true"
            p = "(?i)" + p if r.ignorecase and "(?i)" not in p else p
            parts.append(f"SELECT {key}, {q(r.id)} AS rule_id, {q(r.severity)} AS severity, unnest(regexp_extract_all({line}, {q(p)}, 0)) AS m FROM {source} WHERE {gate}")
    return "\nUNION ALL\n".join(parts)


REGEX_ALL = [r for r in rules.builtin("all") if r.engine != "entropy"]
CUT = "CASE WHEN strlen(trim({0})) <= {1} THEN trim({0}) ELSE trim({0})[:{1}] || '...' END"


@query(f"WITH {CORPUS}, f AS ({findings_sql(rules.CORE)}) SELECT k, rule_id, severity, {CUT.format('m', 100)} AS match FROM f")
def findings_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(corpus(spark, sf_dir), rules.CORE).select("k", "rule_id", "severity", "match")


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}) SELECT k, rule_id, severity, {CUT.format('m', 100)} AS match FROM f")
def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(corpus(spark, sf_dir), REGEX_ALL).select("k", "rule_id", "severity", "match")


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL, gated=False)}) SELECT k, rule_id, {CUT.format('m', 100)} AS match FROM f")
def findings_ungated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(corpus(spark, sf_dir), REGEX_ALL, gated=False).select("k", "rule_id", "match")


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}) SELECT k, rule_id, severity, {CUT.format('m', 100)} AS match FROM f")
def findings_by_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all rules, by the automaton and the table of rules."""
    return rule_table.detect_by_table(corpus(spark, sf_dir), REGEX_ALL).select("k", "rule_id", "severity", "match")


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}) SELECT severity, count(*) AS n FROM f GROUP BY severity")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_severity(detect.detect(corpus(spark, sf_dir), REGEX_ALL))


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}) SELECT rule_id, count(*) AS n FROM f GROUP BY rule_id ORDER BY n DESC, rule_id")
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_rule(detect.detect(corpus(spark, sf_dir), REGEX_ALL))


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}) SELECT coalesce(severity, '*') AS severity, coalesce(rule_id, '*') AS rule_id, count(*) AS n FROM f GROUP BY GROUPING SETS ((severity), (rule_id), ())")
def findings_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.by_grouping_sets(detect.detect(corpus(spark, sf_dir), REGEX_ALL))
    return rows.select(F.coalesce("severity", F.lit("*")).alias("severity"), F.coalesce("rule_id", F.lit("*")).alias("rule_id"), "n")


GAV = "concat_ws(':', group_id, artifact_id, version)"


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}), n AS (SELECT k, count(*) AS n FROM f GROUP BY k) SELECT {GAV} AS gav, CAST(sum(coalesce(n, 0)) AS BIGINT) AS findings_count FROM corpus LEFT JOIN n USING (k) GROUP BY 1")
def findings_per_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("gav", scalars.gav(F.col("group_id"), F.col("artifact_id"), F.col("version")))
    return summary.per_artifact(rows.select("gav").distinct(), detect.detect(rows, REGEX_ALL)).select("gav", "findings_count")


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}) SELECT k % 7 AS part, list_sort(list(DISTINCT rule_id)).array_to_string(',') AS rule_matches FROM f GROUP BY 1")
def rule_matches_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(corpus(spark, sf_dir), REGEX_ALL).withColumn("part", F.col("k") % 7)
    return summary.rule_matches(found, "part").withColumn("rule_matches", F.array_join("rule_matches", ","))


@query(
    f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}), r AS (SELECT k, CASE WHEN k % 10 = 0 THEN 'failed' ELSE 'complete' END AS status FROM corpus) "
    "SELECT (SELECT count(*) FROM r) AS total_discovered, (SELECT count(*) FROM r WHERE status = 'complete') AS total_scanned, (SELECT count(*) FROM r WHERE status <> 'complete') AS total_failed, "
    "(SELECT count(*) FROM f) AS total_findings, (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM f GROUP BY severity)) AS by_severity, "
    "(SELECT string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) FROM (SELECT rule_id, count(*) AS n FROM f GROUP BY rule_id)) AS by_rule"
)
def summary_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    results = rows.select(F.when(F.col("k") % 10 == 0, "failed").otherwise("complete").alias("status"))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    one = summary.summary(results, detect.detect(rows, REGEX_ALL))
    return one.select("total_discovered", "total_scanned", "total_failed", "total_findings", text("by_severity").alias("by_severity"), text("by_rule").alias("by_rule"))


# Custom rules over the documents' lines.

DOC_LINES = (
    "doc_lines AS (SELECT doc_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line_number, regexp_replace(unnest(parts), '\\r$', '') AS line FROM (SELECT doc_id, "
    "CASE WHEN text = '' THEN [] WHEN list_last(string_split(text, chr(10))) = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS parts FROM documents WHERE text IS NOT NULL) AS s0)"
)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def custom(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rule = rules.Rule(id="custom", severity="LOW", enabled=True, **options)
    return detect.detect(doc_lines(spark, sf_dir), [rule], gated=False)


EMAIL, LICENSE, TOKEN = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]{2,}", r"licen[sc]e", r'(?i)token\s*=\s*"?([0-9a-f]{40})'


@query(f"WITH {DOC_LINES} SELECT doc_id, line_number, unnest(regexp_extract_all(line, {q(EMAIL)})) AS match FROM doc_lines")
def email_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom(spark, sf_dir, patterns=(EMAIL,)).select("doc_id", "line_number", "match")


@query(f"WITH {DOC_LINES} SELECT doc_id, line_number, unnest(regexp_extract_all(line, {q('(?i)' + LICENSE)})) AS match FROM doc_lines")
def custom_ignorecase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom(spark, sf_dir, patterns=(LICENSE,), ignorecase=True).select("doc_id", "line_number", "match")


@query(f"WITH {DOC_LINES} SELECT doc_id, line_number, unnest(regexp_extract_all(line, {q(TOKEN)}, 1)) AS match FROM doc_lines")
def custom_capture_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom(spark, sf_dir, patterns=(TOKEN,), capture_group=1).select("doc_id", "line_number", "match")


@query(f"WITH {DOC_LINES}, m AS (SELECT doc_id, line_number, unnest(regexp_extract_all(line, {q(EMAIL)})) AS match FROM doc_lines) SELECT * FROM m WHERE NOT (contains(lower(match), 'mail1.') OR lower(match) = 'net' OR contains(lower(match), 'mail3'))")
def custom_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom(spark, sf_dir, patterns=(EMAIL,), allowlist=("MAIL1.", "net", "mail3")).select("doc_id", "line_number", "match")


@query(f"WITH {DOC_LINES}, m AS (SELECT doc_id, line_number, unnest(regexp_extract_all(line, '[^ ]+')) AS match FROM doc_lines) SELECT doc_id, line_number, match FROM m WHERE strlen(match) BETWEEN 20 AND 40")
def custom_length_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom(spark, sf_dir, patterns=("[^ ]+",), min_length=20, max_length=40).select("doc_id", "line_number", "match")


@query(f"WITH {DOC_LINES} SELECT doc_id, line_number, strlen(line) AS line_bytes, md5(line) AS line_md5 FROM doc_lines")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", "line_number", F.octet_length("line").cast("long").alias("line_bytes"), F.md5("line").alias("line_md5"))


@query(f"WITH {DOC_LINES} SELECT doc_id, max(strlen(line)) AS longest, max(strlen(line)) >= 2000 AS failed FROM doc_lines GROUP BY doc_id")
def long_line_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text <> ''")
    ok, failed = lines.split_by_line_limit(docs.withColumn("longest", lines.longest_line(F.col("text"))), most=2000)
    return ok.select("doc_id", F.col("longest").cast("long"), F.lit(False).alias("failed")).unionByName(failed.select("doc_id", F.col("longest").cast("long"), F.lit(True).alias("failed")))


# Entropy.

TOKENS = "tokens AS (SELECT c_custkey AS k, rtrim(to_base64(unhex(md5(CAST(c_custkey AS VARCHAR)) || md5(c_name))), '=') AS tok FROM customer)"
WINDOWS = (
    "w AS (SELECT k, unnest(range(1, greatest(strlen(tok) - {w} + 1, 1) + 1)) AS i, tok FROM tokens WHERE strlen(tok) >= {least}), "
    "x AS (SELECT k, i, CASE WHEN strlen(tok) <= {w} THEN tok ELSE substr(tok, i, {w}) END AS win FROM w), "
    "c AS (SELECT k, i, win, unnest(string_split(win, '')) AS ch FROM x), n AS (SELECT k, i, win, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL), "
    "h AS (SELECT k, i, win, round(-sum(n / strlen(win) * log2(n / strlen(win))), 9) AS h FROM n GROUP BY k, i, win), "
    "b AS (SELECT k, arg_max(win, (h, -i)) AS win, max(h) AS h FROM h WHERE regexp_matches(win, '{charset}') GROUP BY k) "
)


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.base64(F.unhex(F.concat(F.md5(F.col("c_custkey").cast("string")), F.md5("c_name"))))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("x.json/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("file_path"), F.lit(1).alias("line_number"), F.regexp_replace(made, "=+$", "").alias("line"))


@query(f"WITH {TOKENS}, {WINDOWS.format(w=32, least=24, charset='^[A-Za-z0-9+/=]*$')} SELECT k, win AS match, round(h, 3) AS entropy FROM b WHERE h >= 4.5 AND NOT ({any_like('lower(win)', ['example', 'changeme', 'your-', 'placeholder', 'test'])})")
def entropy_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(token_lines(spark, sf_dir), [rules.HIGH_ENTROPY]).select("k", "match", "entropy")


@query(f"WITH tokens AS (SELECT c_custkey AS k, md5(c_name) || md5(CAST(c_custkey AS VARCHAR)) AS tok FROM customer), {WINDOWS.format(w=16, least=20, charset='^[0-9a-fA-F]*$')} SELECT k, win AS match, round(h, 3) AS entropy FROM b WHERE h >= 3.5")
def entropy_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.Rule(id="hex", severity="LOW", enabled=True, engine="entropy", entropy=rules.Entropy(3.5, 16, 20, 0, "hex"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("key="), F.md5("c_name"), F.md5(F.col("c_custkey").cast("string"))).alias("line"))
    return detect.detect(rows, [rule], gated=False).select("k", "match", "entropy")


@query(f"WITH {DOC_LINES} SELECT doc_id, CAST(sum(len(list_filter(regexp_split_to_array(line, {q(entropy.DELIMITERS)}), lambda t: t <> ''))) AS BIGINT) AS tokens FROM doc_lines GROUP BY doc_id")
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.size(entropy.tokens(F.col("line")))).alias("tokens"))


@query(f"WITH {DOC_LINES}, t AS (SELECT doc_id, unnest(list_filter(string_split(line, ' '), lambda t: t <> '')) AS t FROM doc_lines) SELECT doc_id, count(*) FILTER (regexp_matches(t, '^[\\p{{Nd}}a-fA-F]*$')) AS hex, count(*) FILTER (regexp_matches(t, '^[!-~]*$')) AS ascii, count(*) FILTER (regexp_matches(t, '^[\\p{{L}}\\p{{Nd}}+/=]*$')) AS base64 FROM t GROUP BY doc_id")
def charset_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).select("doc_id", F.explode(F.filter(F.split("line", " "), lambda t: t != "")).alias("t"))
    return rows.groupBy("doc_id").agg(*[F.count_if(entropy.in_charset(F.col("t"), c)).alias(c) for c in ("hex", "ascii", "base64")])


# Files and text.


def gate_sql(patterns) -> str:
    return " OR ".join(f"regexp_matches(file_path, {q(p)})" for p in patterns)


@query(f"WITH {CORPUS} SELECT rule_id, count(*) AS files FROM (" + " UNION ALL ".join(f"SELECT {q(r.id)} AS rule_id, k FROM corpus WHERE {gate_sql(r.file_patterns)}" for r in rules.builtin("all")) + ") AS g0 GROUP BY rule_id")
def file_pattern_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, every = corpus(spark, sf_dir), rules.builtin("all")
    kinds = list(dict.fromkeys(r.file_patterns for r in every))
    ids = F.array(*[F.array(*[F.lit(r.id) for r in every if r.file_patterns == k]) for k in kinds])
    gated = detect.with_gates(rows, every).select(F.explode(F.flatten(F.zip_with(ids, "_gates", lambda i, g: F.when(g, i).otherwise(F.array().cast("array<string>"))))).alias("rule_id"))
    return gated.groupBy("rule_id").agg(F.count("*").alias("files"))


NAMES_SQL = "names AS (SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'a/b.XML' WHEN 1 THEN 'Dockerfile' WHEN 2 THEN 'x/.npmrc' WHEN 3 THEN 'c.class' WHEN 4 THEN 'settings.xml.bak' WHEN 5 THEN 'LICENSE' WHEN 6 THEN 'bin/run' WHEN 7 THEN 'k.p12' ELSE 'i.png' END AS name FROM orders)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["a/b.XML", "Dockerfile", "x/.npmrc", "c.class", "settings.xml.bak", "LICENSE", "bin/run", "k.p12", "i.png"]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.get(F.array(*map(F.lit, names)), F.col("o_orderkey") % 9).alias("name"))


@query(f"WITH {NAMES_SQL}, e AS (SELECT k, name, lower(regexp_extract(regexp_extract(name, '[^/]*$'), '[.][^.]*$')) AS ext, lower(regexp_extract(name, '[^/]*$')) AS base FROM names) SELECT k, name, ext, CASE WHEN ext <> '' THEN ext IN ({', '.join(map(q, archive.SCANNABLE))}) ELSE base IN ({', '.join(map(q, archive.SCANNABLE_NAMES))}) END AS scannable FROM e")
def scannable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("k", "name", scalars.extension(F.col("name")).alias("ext"), archive.is_scannable(F.col("name")).alias("scannable"))


@query("WITH b AS (SELECT c_custkey AS k, substr(hex(unhex(md5(c_name))), 1, 2 * (c_custkey % 17)::INT) AS x FROM customer), p AS (SELECT k, strlen(x) // 2 AS n, list_transform(range(0, strlen(x) // 2), lambda i: substr(x, 2 * i + 1, 2)) AS ps FROM b) SELECT k, CASE WHEN n = 0 THEN false ELSE len(list_filter(ps, lambda p: p = '00')) > 0 OR len(list_filter(ps, lambda p: regexp_matches(p, '^(0[0-8EF]|1.)$'))) / n > 0.3 END AS is_binary FROM p")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.substring(F.unhex(F.md5("c_name")), F.lit(1), (F.col("c_custkey") % 17).cast("int")).alias("content"))
    return rows.select("k", archive.looks_binary_column(F.col("content")).alias("is_binary"))


@query("SELECT c_custkey AS k, CASE WHEN strlen(t) <= 40 THEN t ELSE t[:40] || '...' END AS short FROM (SELECT c_custkey, trim('  ' || repeat(c_name, (c_custkey % 4)::INT) || ' ') AS t FROM customer) AS s0")
def truncate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("  "), F.expr("repeat(c_name, cast(c_custkey % 4 as int))"), F.lit(" "))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), scalars.truncate(text, 40).alias("short"))


@query(f"WITH {CORPUS}, f AS ({findings_sql(rules.CORE)}) SELECT k, file_path || ':1 [' || severity || '] ' || rule_id || ': ' || {CUT.format('m', 100)} AS shown FROM f JOIN corpus USING (k)")
def finding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect(corpus(spark, sf_dir), rules.CORE)
    return found.select("k", scalars.finding_text(F.col("file_path"), F.col("line_number"), F.col("severity"), F.col("rule_id"), F.col("match")).alias("shown"))


@query("SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 9 END AS rank FROM customer")
def severity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.when(F.col("c_mktsegment") == "BUILDING", "CRITICAL").when(F.col("c_mktsegment") == "MACHINERY", "HIGH").otherwise("NONE")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.coalesce(scalars.severity_rank(sev), F.lit(9)).alias("rank"))


# Listings and coordinates.

LISTED = f"listed AS (SELECT page_id, url, unnest(regexp_extract_all(html, {q(listing.ANCHOR)}, 1)) AS href, unnest(regexp_extract_all(html, {q(listing.ANCHOR)}, 2)) AS txt FROM pages)"


@query(f"WITH {LISTED} SELECT page_id, regexp_replace(href, '/$', '') AS name, suffix(href, '/') AS is_dir, CASE WHEN suffix(url, '/') THEN url ELSE url || '/' END || href AS entry_url FROM listed WHERE txt NOT IN ('../', '/')")
def listing_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.parse_listings(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "name", "is_dir", "entry_url")


@query("SELECT p_partkey AS k, 2 AS files, 1 AS dirs FROM part")
def listing_dirs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit('<a href="../">../</a><a href="v'), F.col("p_partkey").cast("string"), F.lit('/">v/</a><a href="a%2Bb.jar">a+b.jar</a> 1K <a  href="a.pom" title="x">a.pom</a>'))
    rows = listing.parse_listings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit("http://r").alias("url"), page.alias("html")))
    return rows.groupBy("k").agg(F.count_if(~F.col("is_dir")).cast("int").alias("files"), F.count_if("is_dir").cast("int").alias("dirs"))


FILES_SQL = (
    "files AS (SELECT o_orderkey AS k, concat('org/g', CAST(o_custkey % 50 AS VARCHAR), '/a', CAST(o_orderkey % 40 AS VARCHAR), '/1.', CAST(o_orderkey % 6 AS VARCHAR), '/a', CAST(o_orderkey % 40 AS VARCHAR), "
    "CASE o_orderkey % 8 WHEN 0 THEN '.jar' WHEN 1 THEN '-sources.jar' WHEN 2 THEN '-javadoc.jar' WHEN 3 THEN '.pom' WHEN 4 THEN '.war' WHEN 5 THEN '.jar.sha1' WHEN 6 THEN '.JAR' ELSE '-tests.jar' END) AS path, o_orderstatus AS st FROM orders)"
)


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda e: F.expr(f"cast({e} as string)")
    ends = F.get(F.array(*map(F.lit, [".jar", "-sources.jar", "-javadoc.jar", ".pom", ".war", ".jar.sha1", ".JAR", "-tests.jar"])), F.col("o_orderkey") % 8)
    path = F.concat(F.lit("org/g"), text("o_custkey % 50"), F.lit("/a"), text("o_orderkey % 40"), F.lit("/1."), text("o_orderkey % 6"), F.lit("/a"), text("o_orderkey % 40"), ends)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), path.alias("path"), F.col("o_orderstatus").alias("st"))


ARTIFACT = "regexp_matches(path, '[.](jar|war|ear|pom|xml)$')"
CLASSIFIER = "regexp_matches(path, '-(sources|javadoc|tests)[.]jar$')"
PARTS = "split_part(path, '/', 1) || '.' || split_part(path, '/', 2) AS group_id, split_part(path, '/', 3) AS artifact_id, split_part(path, '/', 4) AS version"


@query(f"WITH {FILES_SQL} SELECT k, path, {ARTIFACT} AS is_artifact FROM files")
def artifact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_files(spark, sf_dir).select("k", "path", listing.is_artifact(F.col("path")).alias("is_artifact"))


@query(f"WITH {FILES_SQL} SELECT k, {ARTIFACT} AND NOT {CLASSIFIER} AS plain, {ARTIFACT} AS with_sources, {ARTIFACT} AND NOT {CLASSIFIER} AND NOT regexp_matches(path, '[.](pom|xml)$') AS without_pom FROM files")
def classifier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return repo_files(spark, sf_dir).select("k", listing.is_wanted(p).alias("plain"), listing.is_wanted(p, True).alias("with_sources"), listing.is_wanted(p, False, True).alias("without_pom"))


@query(f"WITH {FILES_SQL} SELECT k, {PARTS}, regexp_extract(path, '[^/]*$') AS file_name FROM files WHERE {ARTIFACT} AND NOT {CLASSIFIER}")
def gav_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.artifacts(repo_files(spark, sf_dir)).select("k", "group_id", "artifact_id", "version", "file_name")


@query(f"WITH {FILES_SQL} SELECT k, path FROM files WHERE starts_with(path, 'org/g1/')")
def group_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.under_group(repo_files(spark, sf_dir), "org.g1").select("k", "path")


@query(f"WITH {FILES_SQL}, a AS (SELECT DISTINCT path FROM files) SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM a")
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.walk_places(repo_files(spark, sf_dir).select("path").distinct())


@query(
    f"WITH {FILES_SQL}, a AS (SELECT DISTINCT path FROM files), r AS (SELECT CAST(c_custkey AS VARCHAR) AS run, string_split(concat('org/g', c_custkey % 57, '/a', c_custkey % 41, '/1.', c_custkey % 7, '/a', c_custkey % 40, '.jar'), '/')[:1 + c_custkey % 5] AS cursor FROM customer) "
    "SELECT run, count(path) AS files_left, arg_min(path, string_split(path, '/')) AS next_path FROM r LEFT JOIN a ON string_split(a.path, '/') > r.cursor GROUP BY run"
)
def files_left_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of many interrupted runs has left of the files."""
    c = F.col("c_custkey")
    path = F.concat_ws("", F.lit("org/g"), c % 57, F.lit("/a"), c % 41, F.lit("/1."), c % 7, F.lit("/a"), c % 40, F.lit(".jar"))
    runs = table(spark, sf_dir, "customer").select(c.cast("string").alias("run"), F.slice(F.split(path, "/"), F.lit(1), (1 + c % 5).cast("int")).alias("cursor"))
    return state.files_left(repo_files(spark, sf_dir).select("path").distinct(), runs)


@query(f"WITH {FILES_SQL}, a AS (SELECT {PARTS}, regexp_extract(path, '[^/]*$') AS file_name FROM files WHERE {ARTIFACT}) SELECT group_id, artifact_id, version, min(file_name) AS file_name FROM a GROUP BY ALL")
def first_file_per_gav(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.artifacts(repo_files(spark, sf_dir), include_sources=True)
    return listing.first_per_key(rows).select("group_id", "artifact_id", "version", "file_name")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts on artifacts: a purchase is a success, everything else a failure."""
    events = table(spark, sf_dir, "events")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 7).cast("string"))
    return events.select(path.alias("gav_path"), F.col("event_id").alias("attempt"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("error"))


@query(
    "WITH a AS (SELECT concat('u', user_id, '/', event_id % 7) AS gav_path, event_type = 'purchase' AS ok, event_type AS error, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY ts, event_id) AS i FROM events), "
    "f AS (SELECT gav_path, min(i) FILTER (WHERE ok) AS first_ok, count(*) AS n FROM a GROUP BY 1), "
    "s AS (SELECT gav_path, CASE WHEN coalesce(first_ok - 1, n) >= 3 THEN 'given up' WHEN first_ok IS NOT NULL THEN 'complete' ELSE 'failed' END AS status, CAST(least(coalesce(first_ok - 1, n), 3) AS INTEGER) AS retries FROM f) "
    "SELECT s.gav_path, status, retries, CASE WHEN status <> 'complete' THEN a.error END AS error FROM s LEFT JOIN a ON a.gav_path = s.gav_path AND a.i = s.retries"
)
def retry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every artifact, kept by a stream in four batches."""
    kept = scratch_path(spark, "states")
    attempt_stream.keep_states(attempt_stream.replayed(attempts(spark, sf_dir), 4), kept, scratch_path(spark, "states-checkpoint")).awaitTermination()
    return attempt_stream.current_states(spark, kept).select("gav_path", "status", "retries", "error")


BUDGET = 40_000


@query(
    "WITH RECURSIVE p AS (SELECT page_id, coalesce(strlen(html), 0) AS size, row_number() OVER (ORDER BY page_id) AS i FROM pages), "
    f"w AS (SELECT page_id, i, 0::BIGINT AS batch, size AS used FROM p WHERE i = 1 UNION ALL SELECT p.page_id, p.i, CASE WHEN w.used + p.size > {BUDGET} THEN w.batch + 1 ELSE w.batch END, "
    f"CASE WHEN w.used + p.size > {BUDGET} THEN p.size ELSE w.used + p.size END FROM w JOIN p ON p.i = w.i + 1) SELECT page_id, batch FROM w"
)
def byte_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages in batches of at most 40,000 bytes."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    return batching.batches_by_bytes(pages, ("page_id",), F.col("size"), BUDGET).select("page_id", "batch")


# Rules.


@query("SELECT * FROM (VALUES " + ", ".join(f"({q(level)}, {q(r.id)}, {q(r.severity)}, {len(r.file_patterns)})" for level, rs in (("core", rules.CORE), ("extended", rules.EXTENDED)) for r in rs) + ") AS v(level, id, severity, file_kinds)")
def rule_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.level_table(spark).select("level", "id", "severity", F.size("file_patterns").alias("file_kinds"))


@query(
    "WITH b AS (SELECT p_size AS id, min(p_partkey) AS ord FROM part WHERE p_retailprice < 1500 GROUP BY 1), c AS (SELECT p_size AS id, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part WHERE p_retailprice > 1400 GROUP BY 1), "
    "m AS (SELECT id, CASE WHEN b.id IS NOT NULL THEN 0 ELSE 1 END AS late, coalesce(b.ord, c.lo) AS ord, CASE WHEN c.id IS NOT NULL THEN 'custom' ELSE 'builtin' END AS origin, coalesce(c.hi, b.ord) AS src FROM b FULL JOIN c USING (id)) "
    "SELECT CAST(id AS VARCHAR) AS id, origin, src, CAST(row_number() OVER (ORDER BY late, ord) - 1 AS INTEGER) AS rule_ord FROM m"
)
def rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("id"), F.col("p_partkey").alias("src"), F.col("p_partkey").alias("rule_ord"), "p_retailprice")
    base = part.where("p_retailprice < 1500").withColumn("origin", F.lit("builtin"))
    return rules.merge_tables(base, part.where("p_retailprice > 1400").withColumn("origin", F.lit("custom"))).select("id", "origin", "src", "rule_ord")


# State between runs.

DONE = "done AS (SELECT DISTINCT gav_path FROM paths WHERE st = 'P')"
PATHS = f"{FILES_SQL}, paths AS (SELECT k, path, st, regexp_replace(path, '/[^/]*$', '') AS gav_path FROM files)"


def gav_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_files(spark, sf_dir).withColumn("gav_path", F.regexp_replace("path", "/[^/]*$", ""))


@query(f"WITH {PATHS}, {DONE} SELECT k, path FROM paths WHERE gav_path NOT IN (SELECT gav_path FROM done)")
def skip_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gav_paths(spark, sf_dir)
    return state.not_in(rows, rows.where("st = 'P'")).select("k", "path")


@query(f"WITH {PATHS}, d AS (SELECT DISTINCT gav_path AS dir FROM paths WHERE st = 'P' AND path LIKE '%.war' UNION SELECT 'org/g3') SELECT k, path FROM paths WHERE EXISTS (SELECT 1 FROM d WHERE gav_path = dir OR starts_with(gav_path, dir || '/'))")
def revisit_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gav_paths(spark, sf_dir)
    dirs = state.pending(rows.where("st = 'P' and path like '%.war'"), spark.sql("select 'org/g3' as gav_path"))
    return state.revisit(rows, dirs).select("k", "path")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 6 < 3")
def retryable_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 6).alias("retries"))
    return state.retryable(failed, 3).select("k")


@query(f"WITH {PATHS} SELECT gav_path, CAST(count(*) AS INTEGER) AS retries, max(k) AS last FROM paths WHERE st = 'F' GROUP BY gav_path")
def failed_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gav_paths(spark, sf_dir).where("st = 'F'").select("gav_path", F.col("k").cast("string").alias("error"), F.col("k").alias("failed_at"))
    none = rows.limit(0).withColumn("retries", F.lit(0))
    return state.mark_failed(none, rows).select("gav_path", "retries", F.col("error").cast("long").alias("last"))


@query(f"WITH {PATHS}, a AS (SELECT DISTINCT gav_path FROM paths WHERE st = 'F'), b AS (SELECT DISTINCT gav_path FROM paths WHERE st = 'O') SELECT gav_path, 'old' AS origin FROM a UNION ALL SELECT gav_path, 'new' FROM b WHERE gav_path NOT IN (SELECT gav_path FROM a)")
def merge_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gav_paths(spark, sf_dir)
    part = lambda st, name: rows.where(F.col("st") == st).select("gav_path").distinct().withColumn("origin", F.lit(name))
    return state.add_new(part("F", "old"), part("O", "new"))


# History.

RECORDS_SQL = (
    "recs AS (SELECT o_orderkey AS seq, concat('g', CAST(o_custkey % 100 AS VARCHAR)) AS group_id, concat('a', CAST(o_custkey % 30 AS VARCHAR)) AS artifact_id, CAST(o_orderkey % 4 AS VARCHAR) AS version, 'r' AS repo_url, "
    "CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'complete' END AS status, o_orderkey % 5 AS findings_count, o_orderdate AS scan_time FROM orders)"
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda e: F.expr(f"cast({e} as string)")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("g"), text("o_custkey % 100")).alias("group_id"), F.concat(F.lit("a"), text("o_custkey % 30")).alias("artifact_id"), text("o_orderkey % 4").alias("version"),
        F.lit("r").alias("repo_url"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("complete").alias("status"), (F.col("o_orderkey") % 5).alias("findings_count"), F.col("o_orderdate").cast("timestamp").alias("scan_time"),
    )


FOUND_SQL = (
    "found AS (SELECT l_orderkey AS record_id, concat('rule', CAST(l_partkey % 38 AS VARCHAR)) AS rule_id, CASE l_suppkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
    "l_linenumber AS line_number FROM lineitem)"
)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.get(F.array(*map(F.lit, rules.SEVERITIES)), F.col("l_suppkey") % 4)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.concat(F.lit("rule"), F.expr("cast(l_partkey % 38 as string)")).alias("rule_id"), severity.alias("severity"), F.col("l_linenumber").alias("line_number"))


@query(f"WITH {RECORDS_SQL} SELECT group_id, artifact_id, version, arg_max(seq, (scan_time, seq)) AS seq, arg_max(status, (scan_time, seq)) AS status FROM recs GROUP BY 1, 2, 3")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(records(spark, sf_dir), seq="seq").select("group_id", "artifact_id", "version", "seq", "status")


@query(f"WITH {RECORDS_SQL}, n AS (SELECT * FROM recs WHERE status = 'complete'), nl AS (SELECT group_id, artifact_id, version, arg_max(seq, scan_time) AS seq FROM n GROUP BY 1, 2, 3) SELECT group_id, artifact_id, version, max(scan_time) AS scan_time, count(*) AS n FROM n GROUP BY 1, 2, 3 UNION ALL SELECT o.group_id, o.artifact_id, o.version, max(o.scan_time), count(DISTINCT o.version) FROM recs o LEFT JOIN nl USING (group_id, artifact_id, version) WHERE o.status = 'failed' AND nl.seq IS NULL GROUP BY 1, 2, 3")
def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    old = store.latest(rows.where("status = 'failed'"))
    counts = rows.where("status = 'complete'").groupBy("group_id", "artifact_id", "version").agg(F.count("*").alias("n"))
    return store.upsert(old, rows.where("status = 'complete'")).join(counts, ["group_id", "artifact_id", "version"], "left").select("group_id", "artifact_id", "version", "scan_time", F.coalesce("n", F.lit(1)).alias("n"))


@query(f"WITH {FOUND_SQL} SELECT record_id, rule_id, 'old' AS origin FROM found WHERE record_id NOT IN (SELECT record_id FROM found WHERE rule_id = 'rule7') UNION ALL SELECT DISTINCT record_id, 'renewed', 'new' FROM found WHERE rule_id = 'rule7'")
def upsert_findings_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir)
    old = rows.select("record_id", "rule_id", F.lit("old").alias("origin"))
    new = rows.where("rule_id = 'rule7'").select("record_id", F.lit("renewed").alias("rule_id"), F.lit("new").alias("origin")).distinct()
    return store.replace_findings(old, new, new.select(F.col("record_id").alias("id")))


@query(f"WITH {RECORDS_SQL}, {FOUND_SQL} SELECT count(*) AS total_scanned, count(*) FILTER (status = 'complete') AS total_complete, count(*) FILTER (status = 'failed') AS total_failed, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS total_findings, (SELECT count(*) FROM found WHERE severity = 'CRITICAL') AS critical, (SELECT count(*) FROM found WHERE severity = 'HIGH') AS high FROM recs")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(records(spark, sf_dir), found(spark, sf_dir))


@query(f"WITH {FOUND_SQL} SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id")
def history_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_rule(found(spark, sf_dir))


@query(f"WITH {FOUND_SQL} SELECT severity, count(*) AS n FROM found GROUP BY severity")
def history_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_severity(found(spark, sf_dir))


@query("SELECT o_orderkey AS id, o_orderdate AS scan_time FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20")
def recent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent(records(spark, sf_dir)).select("id", "scan_time")


@query(f"WITH {RECORDS_SQL}, {FOUND_SQL} SELECT concat_ws(':', group_id, artifact_id, version) AS gav, rule_id, severity, line_number FROM found JOIN recs ON record_id = seq")
def export_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir).withColumn("file_path", F.lit("f"))
    return store.export(rows, records(spark, sf_dir)).select("gav", "rule_id", "severity", "line_number")


CUTOFF = "1996-06-01"


@query(f"WITH {RECORDS_SQL}, {FOUND_SQL}, kept AS (SELECT seq FROM recs WHERE scan_time >= TIMESTAMP '{CUTOFF}' - INTERVAL 365 DAY) SELECT seq AS id, (SELECT count(*) FROM found WHERE record_id = seq) AS findings FROM kept")
def retention_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, left = store.delete_older(records(spark, sf_dir), found(spark, sf_dir), datetime.datetime.fromisoformat(CUTOFF), 365)
    counts = left.groupBy("record_id").agg(F.count("*").alias("n"))
    return kept.join(counts, F.col("id") == F.col("record_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("findings"))


@query(f"WITH {RECORDS_SQL}, {FOUND_SQL}, kept AS (SELECT seq FROM recs WHERE scan_time >= TIMESTAMP '{CUTOFF}' - INTERVAL 365 DAY) SELECT severity, count(*) AS n FROM found WHERE record_id NOT IN (SELECT seq FROM kept) GROUP BY severity")
def orphan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, left = store.delete_older(records(spark, sf_dir), found(spark, sf_dir), datetime.datetime.fromisoformat(CUTOFF), 365, cascade=False)
    return summary.by_severity(store.orphans(left, kept))


@query(f"WITH {RECORDS_SQL}, w AS (SELECT DISTINCT group_id, artifact_id, version, repo_url FROM recs) SELECT group_id, artifact_id, version FROM w WHERE EXISTS (SELECT 1 FROM recs r WHERE r.status = 'complete' AND r.group_id = w.group_id AND r.artifact_id = w.artifact_id AND r.version = w.version)")
def is_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return store.is_scanned(rows.select(*store.KEY).distinct(), rows).select("group_id", "artifact_id", "version")


# Tasks: one for each supplier, with times from its key.

NOW = "2020-01-02 00:00:00"
TASKS_SQL = (
    "tsk AS (SELECT CAST(s_suppkey AS VARCHAR) AS task_id, CASE s_suppkey % 4 WHEN 0 THEN 'paused' WHEN 1 THEN 'completed' ELSE 'active' END AS status, CASE s_suppkey % 3 WHEN 0 THEN 0 ELSE 60 * (s_suppkey % 90) END AS scan_interval_sec, "
    "TIMESTAMP '2020-01-01 00:00:00' + to_seconds(s_suppkey % 50) AS created_at, CASE WHEN s_suppkey % 5 > 0 THEN TIMESTAMP '2020-01-01 00:00:00' + to_hours(s_suppkey % 48) END AS next_run_at, s_suppkey % 7 AS scan_count FROM supplier)"
)


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, start = F.col("s_suppkey"), F.lit("2020-01-01 00:00:00").cast("timestamp")
    at = lambda seconds: F.timestamp_seconds(F.unix_seconds(start) + seconds)
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), k.cast("string").alias("task_id"), F.when(k % 4 == 0, "paused").when(k % 4 == 1, "completed").otherwise("active").alias("status"), F.when(k % 3 == 0, 0).otherwise(60 * (k % 90)).cast("long").alias("scan_interval_sec"),
        at(k % 50).alias("created_at"), F.when(k % 5 > 0, at(3600 * (k % 48))).alias("next_run_at"), F.lit(None).cast("timestamp").alias("last_run_at"), F.lit("").alias("last_run_status"), (k % 7).alias("scan_count"),
    )


@query(f"WITH {TASKS_SQL} SELECT task_id, row_number() OVER (ORDER BY next_run_at NULLS FIRST, task_id) AS place FROM tsk WHERE status = 'active' AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '{NOW}')")
def tasks_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.due(task_rows(spark, sf_dir), datetime.datetime.fromisoformat(NOW))
    return tasks.placed(rows, F.col("next_run_at").asc_nulls_first(), "task_id").select("task_id", "place")


@query(f"WITH {TASKS_SQL} SELECT task_id, scan_count + 1 AS scan_count, CASE WHEN scan_interval_sec > 0 THEN epoch(TIMESTAMP '{NOW}' + to_seconds(scan_interval_sec))::BIGINT ELSE -1 END AS next_run, CASE WHEN scan_interval_sec > 0 THEN 'active' ELSE 'completed' END AS status FROM tsk")
def tasks_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.after_run(task_rows(spark, sf_dir), datetime.datetime.fromisoformat(NOW), "completed")
    return rows.select("task_id", "scan_count", F.coalesce(F.unix_seconds("next_run_at"), F.lit(-1)).alias("next_run"), "status")


@query(f"WITH {TASKS_SQL} SELECT task_id, created_at, row_number() OVER (ORDER BY created_at DESC, task_id) AS place FROM tsk WHERE status = 'paused'")
def tasks_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.listed(task_rows(spark, sf_dir), "paused")
    return tasks.placed(rows, F.col("created_at").desc(), "task_id").select("task_id", "created_at", "place")


@query("SELECT p_partkey AS k, p_size::BIGINT * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM part")
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, ["B", "kb", "MB ", "gB"])), F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), scalars.size_column(F.concat(F.lit(" "), F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey % 100000 END AS s FROM orders) SELECT k, CASE WHEN s <= 0 THEN 'one-shot' WHEN s >= 3600 THEN concat(s // 3600, 'h', s % 3600 // 60, 'm', s % 60, 's') WHEN s >= 60 THEN concat(s // 60, 'm', s % 60, 's') ELSE concat(s, 's') END AS shown FROM s")
def interval_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(F.col("o_orderkey") % 100000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), scalars.interval_text(seconds).alias("shown"))


@query("WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_size % 13 AS mtime, p_size * 100000 AS length FROM part), r AS (SELECT path, coalesce(sum(length // 1048576) OVER (ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, (SELECT sum(length) // 1048576 FROM f) AS total FROM f) SELECT path FROM r WHERE total - gone > 50")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") % 13).alias("mtime"), (F.col("p_size") * 100000).cast("long").alias("length"))
    return state.evict(files, 50).select("path")


@query("SELECT CAST(sum(length(html)::BIGINT) // 1048576 AS BIGINT) AS mb, count(*) FILTER (strlen(html) <= 4096) AS small FROM pages")
def cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.length("html").cast("long").alias("length"), F.octet_length("html").alias("bytes"))
    small = state.usage(rows.where("bytes <= 4096")).select("files").scalar()
    return state.usage(rows).select("mb", small.alias("small"))


# Queries that SQL can't express; tests hold them against the same rows found without an archive.


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One jar for each 37 customers: their lines as files, half of them in a nested jar."""
    rows = corpus(spark, sf_dir).withColumn("box", F.expr("k div 37")).select("box", F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("/"), F.col("file_path")).alias("name"), "line")

    def build(pdf):
        import pandas as pd

        outer, inner = io.BytesIO(), io.BytesIO()
        ordered = pdf.sort_values("name").reset_index(drop=True)
        with zipfile.ZipFile(outer, "w") as a, zipfile.ZipFile(inner, "w") as b:
            for i, r in ordered.iterrows():
                (a if i % 2 else b).writestr(zipfile.ZipInfo(r["name"]), r["line"] + "\r\n")
            b.close()
            a.writestr(zipfile.ZipInfo("WEB-INF/lib/inner.jar"), inner.getvalue())
        return pd.DataFrame([(f"/repo/box{int(pdf['box'].iloc[0])}.jar", outer.getvalue())], columns=["path", "content"])

    return rows.groupBy("box").applyInPandas(build, "path string, content binary")


@query(f"WITH {CORPUS} SELECT concat('/repo/box', k // 37, '.jar') AS container_path, concat('d', k, '/', file_path) AS file_path, line || chr(13) || chr(10) AS text FROM corpus")
def archive_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.expand(_containers(spark, sf_dir)).select("container_path", "file_path", "text")


@query(f"WITH {CORPUS} SELECT concat('box', k // 37, '.jar') AS container, concat('d', k, '/', file_path) AS file_path, line || chr(13) || chr(10) AS text FROM corpus")
def archive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same containers as files, read entry by entry in tasks of their own."""
    folder = scratch_path(spark, "boxes")

    def save(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            names = [p.rsplit("/", 1)[1] for p in batch.column(0).to_pylist()]
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                store, inside = fs.FileSystem.from_uri(f"{folder}/{name}" if "://" in folder else f"file://{folder}/{name}")
                store.create_dir(inside.rsplit("/", 1)[0])
                with store.open_output_stream(inside) as out:
                    out.write(content)
            yield pa.record_batch({"path": pa.array([f"{folder}/{n}" for n in names])})

    paths = written(_containers(spark, sf_dir).mapInArrow(save, "path string"), scratch_path(spark, "box-paths"))
    found = split.expand_split(paths)
    return found.select(F.element_at(F.split("container_path", "/"), -1).alias("container"), "file_path", "text")


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}) SELECT concat('/repo/box', k // 37, '.jar') AS container_path, concat('d', k, '/', file_path) AS file_path, rule_id, {CUT.format('m', 100)} AS match FROM f JOIN corpus USING (k)")
def nested_archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_files(_containers(spark, sf_dir), REGEX_ALL).findings
    return found.select("container_path", "file_path", "rule_id", "match")


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}), n AS (SELECT k // 37 AS box, count(*) AS n FROM f GROUP BY 1) SELECT concat('/repo/box', box, '.jar') AS container_path, 'complete' AS status, coalesce(n, 0) AS findings_count FROM (SELECT DISTINCT k // 37 AS box FROM corpus) AS b0 LEFT JOIN n USING (box)")
def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_files(_containers(spark, sf_dir), REGEX_ALL).results.select("container_path", "status", "findings_count")


LETTERS18 = "etaoinshrdlucmfgpb"


def letter_rules(n: int = 5000) -> list[rules.Rule]:
    """A rule for each of ``n`` runs of three letters with two more behind; its word is read off the pattern."""
    runs = [a + b + c for a in LETTERS18 for b in LETTERS18 for c in LETTERS18][:n]
    return [rules.Rule(id=f"run-{r}", severity="LOW", enabled=True, patterns=(r + "[a-z]{2}",)) for r in runs]


@query(
    f"WITH {DOC_LINES}, l AS (SELECT i, {q(LETTERS18)}[i + 1] AS c FROM range(18) AS x(i)), "
    "r AS (SELECT a.c || b.c || c.c AS run FROM l a, l b, l c WHERE a.i * 324 + b.i * 18 + c.i < 5000), "
    "g AS (SELECT DISTINCT doc_id, line_number, line, line[s:s + 2] AS run FROM (SELECT *, unnest(range(1, length(line) - 1)) AS s FROM doc_lines)), "
    "m AS (SELECT run, doc_id, line_number, unnest(regexp_extract_all(line, run || '[a-z]{2}')) AS m FROM g JOIN r USING (run)) "
    "SELECT 'run-' || run AS rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs, min(m) AS first, max(m) AS last FROM m GROUP BY run"
)
def findings_of_5000_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_table.detect_by_table(doc_lines(spark, sf_dir), letter_rules(), gated=False)
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("match").alias("first"), F.max("match").alias("last"))


@query(f"WITH {DOC_LINES} SELECT doc_id, line_number, unnest(regexp_extract_all(line, '[A-Z][A-Z]+!!')) AS match FROM doc_lines")
def custom_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shouted(line: str) -> list[str]:
        import re

        return re.findall("[A-Z][A-Z]+!!", line)

    rule = rules.Rule(id="shout", severity="LOW", enabled=True, engine="shout")
    return detect.detect(doc_lines(spark, sf_dir), [rule], {"shout": detect.python_engine(shouted)}, gated=False).select("doc_id", "line_number", "match")


@query(f"WITH {DOC_LINES} SELECT doc_id, line_number, unnest(regexp_extract_all(line, '[A-Z][A-Z]+!!')) AS match FROM doc_lines")
def custom_engine_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine of ``custom_engine`` as a table function of SQL."""

    def shouted(line: str) -> list[str]:
        import re

        return re.findall("[A-Z][A-Z]+!!", line)

    table_function.register_engine(spark, "shouted", shouted)
    doc_lines(spark, sf_dir).select("doc_id", "line_number", "line").createOrReplaceTempView("shouted_lines")
    return spark.sql("SELECT doc_id, line_number, match FROM shouted(TABLE(shouted_lines) PARTITION BY doc_id)")


@query(f"WITH {CORPUS}, f AS ({findings_sql(REGEX_ALL)}) SELECT k, rule_id, {CUT.format('m', 100)} AS match FROM f")
def streaming_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a file stream, scanned in micro-batches into a table."""
    from siltstone.streaming.incremental import detect_stream

    base = scratch_path(spark, "stream")
    rows = corpus(spark, sf_dir).select("k", "file_path", F.col("line").alias("text"))
    rows.repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    out = detect_stream(stream, REGEX_ALL).select("k", "rule_id", "match")
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(f"WITH {CORPUS}, f AS ({findings_sql(rules.CORE)}) SELECT count(*) AS n, md5(string_agg(k || rule_id || {CUT.format('m', 100)}, ',' ORDER BY k, rule_id, {CUT.format('m', 100)})) AS digest FROM f")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings through the sink of the JSON export and back."""
    found = detect.detect(corpus(spark, sf_dir), rules.CORE)
    rows = found.select(F.concat_ws(":", "group_id", "artifact_id", "version").alias("gav"), F.lit("r").alias("repo_url"), "group_id", "artifact_id", "version", "rule_id", "rule_name", "severity", F.concat(F.col("k").cast("string"), F.lit("/"), "file_path").alias("file_path"), "line_number", "line_content", "match")
    path = json_array.local(scratch_path(spark, "report") + ".json")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    report.write_export(rows.repartitionByRange("severity", "file_path").sortWithinPartitions("severity", "file_path"), path)
    back = json_array.read_array(spark, f"file://{path}", "file_path string, rule_id string, match string").select(F.split("file_path", "/")[0].cast("long").alias("k"), "rule_id", "match")
    lines_ = F.sort_array(F.collect_list(F.struct("k", "rule_id", "match")))
    joined = F.array_join(F.transform(lines_, lambda x: F.concat(x["k"].cast("string"), x["rule_id"], x["match"])), ",")
    return back.agg(F.count("*").alias("n"), F.md5(joined).alias("digest"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS task_id, s_suppkey % 90 AS concurrency, CASE WHEN s_suppkey % 2 = 0 THEN 'all' ELSE 'core' END AS rules_level FROM supplier")
def task_config_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("s_suppkey") % 2 == 0, "all").otherwise("core")
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("task_id"), tasks.packed(concurrency=F.col("s_suppkey") % 90, rules_level=level).alias("config"))
    return made.select("task_id", tasks.unpacked(F.col("config")).alias("c")).select("task_id", "c.concurrency", "c.rules_level")


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' ELSE 'complete' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'HTTP 503' WHEN 1 THEN 'BadZipFile' ELSE '' END AS error, CAST(CASE WHEN c_custkey % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS findings_count FROM customer")
def scan_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed downloads and broken archives are failed results beside the others."""
    k = F.col("c_custkey")
    kind = k % 4
    name = F.when(kind == 1, F.lit("x.jar")).otherwise(F.lit("app.properties"))
    content = F.when(kind == 1, F.lit("no archive")).when(kind == 2, F.concat(F.lit("db.password="), F.md5(k.cast("string")))).when(kind == 3, F.lit("port=8080"))
    files = table(spark, sf_dir, "customer").select(F.concat_ws("/", F.lit("/m"), k.cast("string"), name).alias("path"), content.cast("binary").alias("content"), F.when(kind == 0, F.lit("HTTP 503")).alias("error"))
    found = scan.scan_files(files, rules.CORE).results
    return found.select(F.split("container_path", "/")[2].cast("long").alias("k"), "status", F.coalesce(F.regexp_extract("error", "^[^:]*", 0), F.lit("")).alias("error"), "findings_count")


def swelling_jar(n: int) -> bytes:
    """A jar of ``n`` + 2 small files, the second of which swells too much."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.txt", "x")
        z.writestr("swollen.txt", "a" * 60_000)
        for i in range(n):
            z.writestr(f"e{i}.txt", str(i))
    return out.getvalue()


#: Archives that a task builds and reads; the table's file may be a single split.
DEALT = 5000


@query("SELECT p_partkey AS k, CAST(least(p_size, 20) + 1 AS BIGINT) AS entries, p_size > 20 AS cut, 1 AS skipped FROM part")
def archive_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``swelling_jar`` for each part: at most 22 entries are read, the swollen one is skipped.

    A task zips jars of one size once; every part's jar is opened and read.
    """

    def build(batches):
        import pyarrow as pa

        jar = functools.lru_cache(256)(swelling_jar)
        for batch in batches:
            keys, sizes = (c.to_pylist() for c in batch.columns)
            yield pa.record_batch({"path": pa.array([f"/m/{k}.jar" for k in keys]), "content": pa.array([jar(n) for n in sizes], pa.binary())})

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    tasks_ = max(spark.sparkContext.defaultParallelism, parts.count() // DEALT + 1)
    files = parts.repartition(tasks_, "p_partkey").mapInArrow(build, "path string, content binary")
    rows = archive.expand(files, archive.Limits(entries=22))
    # Of numbers and booleans Spark keeps maxima in a hash table; for those of strings it would sort all entries.
    error = F.col("error")
    read = rows.groupBy("container_path").agg(
        F.count("text").alias("entries"), F.max(error.contains("too many entries")).alias("cut"), F.max(F.regexp_count(error, F.lit("skipped by size or ratio"))).alias("skipped")
    )
    return read.select(F.regexp_extract("container_path", "([0-9]+)[.]jar", 1).cast("long").alias("k"), "entries", "cut", "skipped")


@query("SELECT o_custkey AS custkey, count(*) AS findings_count, max(o_orderkey) AS last_order, 'complete' AS status FROM orders GROUP BY o_custkey")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches through the history: of every record the second one's row and findings count."""
    orders = table(spark, sf_dir, "orders")
    keys = [F.lit("g").alias("group_id"), F.col("o_custkey").cast("string").alias("artifact_id"), F.lit("1").alias("version"), F.lit("r").alias("repo_url")]
    history = store.Store(spark, scratch_path(spark, "history"))
    for day, status in ((1, "failed"), (2, "complete")):
        found = orders.select(*keys, "o_orderkey").withColumn("record_id", store.record_id())
        records = found.groupBy(*store.KEY).agg(F.count("*").alias("findings_count"), F.max("o_orderkey").cast("string").alias("error"))
        more = {"status": F.lit(status), "scan_time": F.lit(datetime.datetime(2024, 5, day)), "duration_ms": F.lit(0).cast("long"), "rule_matches": F.array().cast("array<string>"), "file_hash": F.lit("")}
        texts = {c: F.lit("") for c in ("rule_id", "rule_name", "severity", "file_path", "line_content", "match")}
        history.save(records.withColumns(more), found.withColumn("id", F.col("o_orderkey")).withColumns(texts).withColumn("line_number", F.lit(day)))
    last = history.read("findings").groupBy("record_id").agg(F.count("*").alias("n"), F.min("line_number").alias("batch")).where("batch = 2")
    rows = history.read("records").join(last, F.col("id") == F.col("record_id"))
    return rows.select(F.col("artifact_id").cast("long").alias("custkey"), F.col("n").alias("findings_count"), F.col("error").cast("long").alias("last_order"), "status")


@query("SELECT n_nationkey AS k, 'repo/' || lower(n_name) || '/' || n_regionkey AS joined FROM nation")
def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.lit("/repo/"), F.lower("n_name"), F.lit(""), F.concat(F.lit("//"), F.col("n_regionkey").cast("string"), F.lit("/"))]
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), scalars.join_path(*parts).alias("joined"))
