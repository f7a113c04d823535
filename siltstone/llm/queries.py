"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, divergence, embed_dedup, html_extract, imatch, licenses, mixing, packing, pii, quality, simhash, token_blocks, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    return token_blocks.token_index(docs, tokenizer_path())


def captures(pages: DataFrame) -> DataFrame:
    """Two capture records for each page: a full response, and a not-modified answer at another time.

    Times and the presence of validators follow from page_id, so that answers come before and after
    their page, after other captures of the same address, and with both, one or no validator.
    """
    i = F.col("page_id")
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("day "), F.expr("page_id div 7"))
    at, later = 3 * i, 3 * i + (i * 7919) % 2001 - 200
    some = lambda *pairs: F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    full = some(
        F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("etag"), etag,
        F.lit("last-modified"), modified, F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), at.cast("string"),
    )
    short = some(
        F.lit("content-length"), F.lit("0"), F.lit("etag"), F.when(i % 11 > 0, etag), F.lit("last-modified"), F.when(i % 13 > 0, modified),
        F.lit("cache-control"), F.lit("max-age=1200"), F.lit("expires"), (later + 1200).cast("string"), F.lit("date"), later.cast("string"),
    )
    kinds = F.array(
        F.struct((2 * i).alias("record_id"), at.alias("ts"), F.lit("response").alias("kind"), full.alias("headers")),
        F.struct((2 * i + 1).alias("record_id"), later.alias("ts"), F.lit("revisit").alias("kind"), short.alias("headers")),
    )
    return pages.select("url", F.explode(kinds).alias("r")).select("url", "r.*")


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.pick(common.table(spark, sf_dir, "pages"), "page_id", "url", "html")
    found = warc.resolve(captures(pages))
    pairs = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("record_id", "canonical_url", "status", F.coalesce("response_id", F.lit(-1)).alias("response_id"), F.array_join(F.array_sort(pairs), "|").alias("headers"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.pick(common.table(spark, sf_dir, "pages"), "page_id", "url", "html"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = common.pick(common.table(spark, sf_dir, "labels"), "doc_id", "quality")
    return quality.scores(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path())


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(common.pick(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    found = simhash.groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.pick(common.table(spark, sf_dir, "documents"), "doc_id", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.pick(common.table(spark, sf_dir, "documents"), "lang", "text"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.pick(common.table(spark, sf_dir, "documents"), "lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisits": op1_revisits,
    "op2_html_extract": op2_html_extract,
    "op3_quality": op3_quality,
    "op4_token_blocks": op4_token_blocks,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_embed_dedup": op7_embed_dedup,
    "op8_imatch": op8_imatch,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
    "op11_licenses": op11_licenses,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
}

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1) * weight, cap)) AS target FROM l),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT source, CAST(('0x' || substr(md5(coalesce(source, chr(0)) || '/mix'), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS shift FROM s)
SELECT doc_id, size, source_size, target, CAST(least(floor((rank + 1) * each + shift) - floor(rank * each + shift), 3) * size AS BIGINT) AS taken
FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source
"""

OP1_SQL = r"""
WITH r AS (
  SELECT url, 2 * page_id AS record_id, 3 * page_id AS ts, true AS is_full, page_id, '"' || substr(md5(html), 1, 16) || '"' AS etag,
    'day ' || (page_id // 7) AS modified, strlen(html) AS size FROM pages
  UNION ALL
  SELECT url, 2 * page_id + 1, 3 * page_id + (page_id * 7919) % 2001 - 200, false, page_id,
    CASE WHEN page_id % 11 > 0 THEN '"' || substr(md5(html), 1, 16) || '"' END, CASE WHEN page_id % 13 > 0 THEN 'day ' || (page_id // 7) END, 0 FROM pages),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '', 's') AS v FROM r),
b AS (
  SELECT *, regexp_replace(regexp_extract(v, '^[^?]*'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
    regexp_extract(v, '[?](.*)$', 1) AS query FROM u),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/]*')), '^www[.]', ''), ':(80|443)$', '')
      || regexp_replace(regexp_replace(rest, '^[^/]*', ''), '/+$', '') AS page,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p,
      '^(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref|ref_src|phpsessid|jsessionid|sessionid|sid)(=|$)'))), '&') AS kept FROM b),
d AS (SELECT *, page || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url FROM c),
j AS (
  SELECT *, last_value(CASE WHEN is_full THEN struct_pack(id := record_id, etag := etag, modified := modified, size := size, ts := ts) END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM d),
s AS (
  SELECT *, CASE WHEN canonical_url IS NULL OR f IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN etag = f.etag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN modified = f.modified THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'resolved_unverified' END AS status FROM j WHERE NOT is_full)
SELECT record_id, canonical_url, status, CASE WHEN status LIKE 'resolved%' THEN f.id ELSE -1 END AS response_id,
  CASE WHEN status LIKE 'resolved%' THEN array_to_string(list_sort(list_filter([
    'cache-control=max-age=1200', 'content-length=' || f.size, 'content-type=text/html', 'date=' || ts, 'etag=' || coalesce(etag, f.etag),
    'expires=' || (ts + 1200), 'last-modified=' || coalesce(modified, f.modified)], lambda x: x IS NOT NULL)), '|') END AS headers
FROM s
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
p AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w),
g AS (SELECT lang, w[s:s + m - 1] AS p, count(*) AS f FROM p, range(1, 5) AS x(m) WHERE s + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(p) = 1 GROUP BY lang),
c AS (SELECT lang, p, f AS a FROM g WHERE len(p) > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.p, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c) c
  JOIN g l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN g r ON r.lang = c.lang AND r.p = c.p[k + 1:len(c.p)]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, p[s:s + m - 1] AS p, max(a) AS longer FROM c, range(2, 4) AS x(m), range(1, 4) AS y(s) WHERE m < len(p) AND s + m - 1 <= len(p) GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.p = b.p
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT i, lang, source, unnest(words) AS term FROM d),
g AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT DISTINCT i, lang, term FROM w) GROUP BY ALL HAVING count(*) >= 10),
kn AS (SELECT g.lang, g.source, g.term, g.n FROM g JOIN k ON g.lang = k.lang AND g.term = k.term),
gr AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
tot AS (SELECT gr.lang, gr.source, coalesce(sum(n), 0)::HUGEINT AS total FROM gr LEFT JOIN kn ON gr.lang = kn.lang AND gr.source = kn.source GROUP BY ALL),
p AS (  -- every kept term of every group, with zero counts
  SELECT tot.lang, tot.source, k.term, coalesce(kn.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(kn.n, 0) + 2)) // (total + 2 * v.v) AS p
  FROM tot JOIN k ON tot.lang = k.lang JOIN v ON v.lang = tot.lang
  LEFT JOIN kn ON kn.lang = tot.lang AND kn.source = tot.source AND kn.term = k.term),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM kn GROUP BY ALL),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 2)) // (t.total + 2 * v.v) AS q
  FROM l JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM l GROUP BY lang) t ON t.lang = l.lang JOIN v ON v.lang = l.lang),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM terms) WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op1_revisits": OP1_SQL, "op10_mixing": OP10_SQL, "op12_collocations": OP12_SQL, "op13_divergence": OP13_SQL}
