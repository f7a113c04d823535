"""Repository listings: anchors, artifact files, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.regex import to_java
from siltstone.functions.scalars import base_name, gav, gav_path, group_to_path

from .ranges import sums_before

# The anchor form of a listing and the suffixes of artifact files.
ANCHOR = r'<a\s+href="([^"]+)"[^>]*>([^<]+)</a>'
ARTIFACTS = (".jar", ".war", ".ear", ".pom", ".xml")
CLASSIFIERS = ("-sources.jar", "-javadoc.jar", "-tests.jar")
DESCRIPTORS = (".pom", ".xml")
# End of fixed values.


def ends_with_any(name: Column, suffixes: tuple[str, ...]) -> Column:
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | name.endswith(s)
    return ok


def entries(html: Column, base_url: Column, strict: bool = False) -> Column:
    """array<struct<name, is_dir, url>> of one listing page, in page order.

    Links to the parent are known by their text; with ``strict`` by their target too, along with
    absolute, rooted and query links.
    """
    java = to_java(ANCHOR)
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(java), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(java), F.lit(2)).alias("text"))
    kept = F.filter(pairs, lambda p: ~p["text"].isin("../", "/"))
    if strict:
        kept = F.filter(kept, lambda p: ~(p["href"].isin("..", "../") | p["href"].rlike(r"^([/?#]|[A-Za-z][A-Za-z0-9+.-]*:)")))
    root = F.when(base_url.endswith("/"), base_url).otherwise(F.concat(base_url, F.lit("/")))
    return F.transform(kept, lambda p: F.struct(F.regexp_replace(p["href"], r"/\z", "").alias("name"), p["href"].endswith("/").alias("is_dir"), F.concat(root, p["href"]).alias("url")))


def parse_listings(pages: DataFrame, html: str = "html", url: str = "url", strict: bool = False) -> DataFrame:
    """A row per link: the columns of ``pages`` but the html, with entry_ord, name, is_dir, entry_url."""
    others = [F.col(f"`{c}`") for c in pages.columns if c != html]
    rows = pages.select(*others, F.posexplode(entries(F.col(html), F.col(url), strict)).alias("entry_ord", "_e"))
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns if c != html], "entry_ord", F.col("_e.name").alias("name"), F.col("_e.is_dir").alias("is_dir"), F.col("_e.url").alias("entry_url"))


def is_artifact(name: Column) -> Column:
    return ends_with_any(name, ARTIFACTS)


def is_wanted(name: Column, include_sources: bool = False, skip_pom: bool = False) -> Column:
    """Artifact files, less classifier jars unless asked for, less descriptors if unwanted."""
    ok = is_artifact(name)
    if not include_sources:
        ok = ok & ~ends_with_any(name, CLASSIFIERS)
    if skip_pom:
        ok = ok & ~ends_with_any(name, DESCRIPTORS)
    return ok


def coordinates(directory: Column) -> Column:
    """struct<group_id, artifact_id, version> of a directory path; null under three parts."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    n = F.size(parts)
    found = F.struct(F.array_join(F.slice(parts, 1, n - 2), ".").alias("group_id"), F.element_at(parts, -2).alias("artifact_id"), F.element_at(parts, -1).alias("version"))
    return F.when(n >= 3, found)


def artifacts(files: DataFrame, path: str = "path", include_sources: bool = False, skip_pom: bool = False, exclude: str | None = None) -> DataFrame:
    """Wanted artifacts of file paths: their columns with group_id, artifact_id, version, file_name, gav,
    gav_path and is_metadata; paths that are too short are dropped. ``exclude`` is a glob on the path."""
    name = base_name(F.col(path))
    rows = files.withColumn("file_name", name).where(is_wanted(F.col("file_name"), include_sources, skip_pom))
    if exclude:
        import fnmatch

        rows = rows.where(~F.col(path).rlike(fnmatch.translate(exclude).replace(r"\Z", r"\z")))
    rows = rows.withColumn("_c", coordinates(F.regexp_replace(path, r"/?[^/]*\z", ""))).where("_c is not null")
    rows = rows.withColumns({c: F.col(f"_c.{c}") for c in ("group_id", "artifact_id", "version")}).drop("_c")
    keys = [F.col(c) for c in ("group_id", "artifact_id", "version")]
    return rows.withColumn("gav", gav(*keys)).withColumn("gav_path", gav_path(*keys)).withColumn("is_metadata", F.col("file_name").startswith("maven-metadata"))


def under_group(rows: DataFrame, group: str, path: str = "path") -> DataFrame:
    """Rows under the directory of a dotted group prefix."""
    if not group:
        return rows
    start = F.concat(group_to_path(F.lit(group)), F.lit("/"))
    return rows.where(F.regexp_replace(path, "^/+", "").startswith(start))


def walk_order(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows in the order of a depth-first walk whose children are sorted by name."""
    return rows.orderBy(F.split(path, "/"))


def walk_places(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows with their ``place``, from 1, in the order of ``walk_order``."""
    ahead = sums_before(rows.withColumn("_parts", F.split(path, "/")), ("_parts",), F.lit(1).cast("long"), "_ahead")
    return ahead.withColumn("place", F.col("_ahead") + 1).drop("_parts", "_ahead")


def first_per_key(rows: DataFrame, key: str = "gav_path", order: str = "file_name") -> DataFrame:
    """One row per key: the first by ``order`` (one file for each set of coordinates)."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
