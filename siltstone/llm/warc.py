"""Resolution of not-modified captures against earlier full responses.

A ``revisit`` record says that a resource had not changed. It is joined as of its time to the latest
earlier ``response`` of the same canonical URL; the validators are compared (entity tags if both
records have one, else modification times if both have one), and the stored headers are updated by
those of the revisit that such an answer may change: all but the ones that describe the body or the
connection.

Order is (ts, record_id). Captures are dealt to (URL, time bucket), so one URL with very many captures
is split; what a bucket needs from earlier ones is the last response of each, a row per URL and bucket.

Edge cases: a null URL matches nothing; a null time comes before all others; no earlier response gives
``no_response``, other validators ``validator_mismatch``, none to compare ``resolved_unverified``; null
headers are no headers; repeated rows are resolved each; bodies aren't looked at, so their length doesn't
matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Parameters that do not choose the resource.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref|ref_src|phpsessid|jsessionid|sessionid|sid)(=|$)"
#: Headers of a not-modified answer that never replace stored ones.
FIXED = ("content-length", "content-encoding", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without closing slashes, sorted
    parameters without tracking; no scheme and no fragment."""
    whole = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    rest = F.regexp_replace(F.regexp_extract(whole, r"^[^?]*", 0), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/]*", 0)), r"^www[.]", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/]*", ""), r"/+$", "")
    query = F.regexp_extract(whole, r"[?](.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _validator(headers: Column, name: str) -> Column:
    return F.regexp_replace(F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), F.lit(0))["value"], "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Per revisit of (record_id, url, ts, kind, headers map): record_id, canonical_url, ts, status,
    response_id and the merged headers (null unless resolved)."""
    rows = records.select("record_id", "ts", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), canonical_url(F.col("url")).alias("canonical_url"))
    edges = common.quantile_edges(records, "ts")
    # Rows without a URL are kept apart from one another.
    rows = rows.withColumn("_key", F.coalesce("canonical_url", F.concat(F.lit("\u0000"), F.col("record_id").cast("string"), F.lit("/"), F.coalesce(F.col("ts").cast("string"), F.lit("")))))
    rows = rows.withColumn("_bucket", common.bucket(F.col("ts"), edges))
    full = F.when((F.col("kind") == "response") & F.col("canonical_url").isNotNull(), F.struct(F.col("ts").isNotNull().alias("timed"), "ts", "record_id", "headers"))
    rows = rows.withColumn("_full", full)
    inside = Window.partitionBy("_key", "_bucket").orderBy(F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first())
    near = F.last("_full", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy("_key", "_bucket").orderBy(F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_near", near).withColumn("_last", F.last("_full", ignorenulls=True).over(whole)).withColumn("_nth", F.row_number().over(inside))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.where("_nth = 1").select("_key", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_far"))
    found = rows.where("kind = 'revisit'").join(carried.where("_far is not null"), ["_key", "_bucket"], "left")
    return found.select("record_id", "canonical_url", "ts", "headers", F.coalesce("_near", "_far").alias("f")).select(
        "record_id", "canonical_url", "ts", _status().alias("status"), "f", "headers"
    ).select(
        "record_id", "canonical_url", "ts", "status",
        F.when(F.col("status").startswith("resolved"), F.col("f.record_id")).alias("response_id"),
        F.when(F.col("status").startswith("resolved"), merged(F.col("f.headers"), F.col("headers"))).alias("headers"),
    )


def _status() -> Column:
    def against(name: str) -> tuple[Column, Column]:
        a, b = _validator(F.col("headers"), name), _validator(F.col("f.headers"), name)
        return a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("validator_mismatch")

    (tagged, by_tag), (dated, by_date) = against("etag"), against("last-modified")
    return F.when(F.col("f").isNull(), "no_response").when(tagged, by_tag).when(dated, by_date).otherwise("resolved_unverified")


def merged(stored: Column, answer: Column) -> Column:
    """Stored headers, updated by those of the answer that may change them. Names are lower-cased; of
    names that become equal the last counts."""

    def lowered(m: Column) -> Column:
        entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
        return F.map_from_entries(last)

    new = F.map_filter(lowered(answer), lambda k, _: ~k.isin(*FIXED))
    return F.map_concat(F.map_filter(lowered(stored), lambda k, _: ~F.map_contains_key(new, k)), new)


def with_bodies(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """Resolved rows with the ``body`` of their response, from (record_id, body)."""
    bodies = responses.select(F.col("record_id").alias("response_id"), "body")
    return resolved.join(bodies, "response_id", "left")
