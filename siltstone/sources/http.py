"""A Maven-style repository over HTTP: client, tree walk, and a Spark data source.

The walk lists directories level by level; each level is one job with a row per directory, so listing
is distributed and needs no visited set. Downloads run in the partitions of a ``mapInPandas``.
"""

from __future__ import annotations

import base64
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime
from itertools import count
from urllib.error import HTTPError as UrlHTTPError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, SimpleDataSourceStreamReader, StringEndsWith, StringStartsWith

from siltstone.operators.listing import is_wanted, parse_listings
from siltstone.scratch import scratch_path, written


class HttpError(Exception):
    def __init__(self, status: int, url: str, retry_after: str | None = None) -> None:
        super().__init__(f"HTTP {status} for {url}")
        self.status, self.url, self.retry_after = status, url, retry_after


class TooLarge(Exception):
    """A body over the size limit; not worth another try."""


@dataclass(frozen=True)
class Options:
    """How to fetch. The credentials never appear in ``repr`` and so in no plan or log."""

    timeout: float = 30
    retries: int = 3
    qps: float = 0
    max_bytes: int = 0
    agent: str = "siltstone/1"
    header: str = ""
    token: str = ""
    user: str = ""
    password: str = ""

    def __repr__(self) -> str:
        return f"Options(timeout={self.timeout}, retries={self.retries}, qps={self.qps}, max_bytes={self.max_bytes}, credentials={'yes' if self.header or self.token or self.user else 'no'})"

    def headers(self) -> dict[str, str]:
        """Request headers; basic credentials win over a token, and a token over a header of that name."""
        found = {"User-Agent": self.agent}
        if self.header:
            name, _, value = self.header.partition(":")
            found[name.strip()] = value.strip()
        if self.token:
            found["Authorization"] = f"Bearer {self.token}"
        if self.user:
            found["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()
        return found


def is_retryable(error: Exception) -> bool:
    """Server errors, 429 and whatever isn't an HTTP answer."""
    if isinstance(error, TooLarge):
        return False
    return not isinstance(error, HttpError) or error.status >= 500 or error.status == 429


def retry_after_seconds(value: str | None, now: float | None = None) -> float | None:
    """Seconds of a Retry-After header, given as a number or a date, five minutes at most."""
    text = (value or "").strip(" \t")
    if not text:
        return None
    if text.isdigit():
        return min(300.0, float(text))
    try:
        wait = parsedate_to_datetime(text).timestamp() - (time.time() if now is None else now)
    except (TypeError, ValueError):
        return None
    return min(300.0, wait) if wait > 0 else None


def backoff_seconds(attempt: int, error: Exception | None = None, jitter: Callable[[], float] = random.random) -> float:
    """Wait before the next try: 2^attempt seconds, 30 at most, and up to half as much again; what a
    429 asks for comes first."""
    if isinstance(error, HttpError) and error.status == 429 and (asked := retry_after_seconds(error.retry_after)) is not None:
        return asked
    wait = min(30.0, 2.0**attempt)
    return wait + wait * 0.5 * jitter()


class Bucket:
    """A token bucket that holds one second of tokens; no rate means no waiting."""

    def __init__(self, qps: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.qps, self.clock, self.sleep = qps, clock, sleep
        self.tokens, self.at = max(1.0, qps), clock()

    def take(self) -> None:
        if self.qps <= 0:
            return
        now = self.clock()
        self.tokens = min(max(1.0, self.qps), self.tokens + (now - self.at) * self.qps)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.qps)
            self.at, self.tokens = self.clock(), 1.0
        self.tokens -= 1


def fetch(url: str, options: Options) -> bytes:
    """One GET; the size limit holds for the announced length and for the body."""
    try:
        with urlopen(Request(url, headers=options.headers()), timeout=options.timeout) as answer:
            if answer.status != 200:
                raise HttpError(answer.status, url)
            limit, announced = options.max_bytes, int(answer.headers.get("Content-Length") or 0)
            if limit and announced > limit:
                raise TooLarge(f"{url}: {announced} bytes announced")
            body = answer.read(limit + 1) if limit else answer.read()
            if limit and len(body) > limit:
                raise TooLarge(f"{url}: more than {limit} bytes")
            return body
    except UrlHTTPError as e:
        raise HttpError(e.code, url, e.headers.get("Retry-After")) from None


def fetch_with_retries(url: str, options: Options, bucket: Bucket | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """``fetch`` with up to ``retries`` more tries; one token of the bucket for all of them."""
    if bucket:
        bucket.take()
    for attempt in range(options.retries + 1):
        try:
            return fetch(url, options)
        except Exception as e:
            if attempt == options.retries or not is_retryable(e):
                raise
            sleep(backoff_seconds(attempt, e))
    raise AssertionError("unreachable")


def fetch_all(urls: DataFrame, options: Options, partitions: int, url: str = "url") -> DataFrame:
    """The columns of ``urls`` with content and error; each partition has its share of the rate."""
    share = Options(**{**options.__dict__, "qps": options.qps / max(1, partitions)})

    def run(batches) -> Iterator:
        bucket = Bucket(share.qps)
        for pdf in batches:
            bodies, errors = [], []
            for u in pdf[url]:
                try:
                    bodies.append(fetch_with_retries(u, share, bucket))
                    errors.append(None)
                except Exception as e:
                    bodies.append(None)
                    errors.append(str(e))
            yield pdf.assign(content=bodies, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", content binary, error string"
    return urls.repartition(partitions).mapInPandas(run, schema)


def walk(spark: SparkSession, root: str, options: Options = Options(), partitions: int = 8, group: str = "", include_sources: bool = False, skip_pom: bool = False, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, failed directories) below ``root``: (path, url) and (path, url, error).

    A root that can't be listed is an error; other directories that can't are reported. Levels go on until
    one is empty. Each level's pages are written to the scratch folder, so no page is fetched twice.
    """
    root = root.rstrip("/") + "/"
    start = group.strip(".").replace(".", "/")
    level = spark.createDataFrame([(start, root + (start + "/" if start else ""))], "path string, url string")
    files = spark.createDataFrame([], "path string, url string")
    failed = spark.createDataFrame([], "path string, url string, error string")
    for depth in count():
        pages = written(fetch_all(level, options, partitions), scratch_path(spark, "pages"))
        bad = pages.where("error is not null").select("path", "url", "error")
        if depth == 0 and (e := bad.first()):
            raise OSError(f"can't list {root}: {e.error}")
        failed = failed.unionByName(bad)
        rows = parse_listings(pages.where("error is null").select("path", "url", F.col("content").cast("string").alias("html")), strict=strict)
        rows = rows.select(F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("/"), "name")).alias("path"), F.col("entry_url").alias("url"), "is_dir", "name")
        files = files.unionByName(rows.where(~F.col("is_dir") & is_wanted(F.col("name"), include_sources, skip_pom)).select("path", "url"))
        level = rows.where("is_dir").select("path", "url")
        if level.isEmpty():
            break
    return files, failed


class Directory(InputPartition):
    """A directory to list: with all below it, or ``flat`` for its own files."""

    def __init__(self, path: str, flat: bool) -> None:
        self.path, self.flat = path, flat


def list_page(url: str, options: Options) -> list[tuple[str, bool, str]]:
    """(name, is directory, url) of the links of one page, sorted by name."""
    import re

    from siltstone.operators.listing import ANCHOR

    found = []
    for href, text in re.findall(ANCHOR, fetch_with_retries(url, options).decode("utf-8", "replace")):
        if text in ("../", "/") or href in ("..", "../") or re.match(r"[/?#]|[A-Za-z][A-Za-z0-9+.-]*:", href):
            continue
        found.append((href.removesuffix("/"), href.endswith("/"), url.rstrip("/") + "/" + href))
    return sorted(found, key=lambda e: e[0].encode())


class CursorWalk:
    """An ordered depth-first walk that can stop after any file and go on later.

    The cursor is a stack of (directory, next child) pairs, as long as the tree is deep. ``leads`` tells
    which directories are looked into.
    """

    def __init__(self, root: str, options: Options, cursor: list | None = None, leads: Callable[[str], bool] = lambda path: True) -> None:
        self.root, self.options, self.leads = root.rstrip("/") + "/", options, leads
        self.stack = [list(f) for f in cursor] if cursor is not None else [["", 0]]
        self.failed: list[str] = []
        self.errors: dict[str, str] = {}
        self.pages: dict[str, list] = {}

    def _children(self, path: str) -> list:
        if path not in self.pages:
            self.pages[path] = list_page(self.root + (path + "/" if path else ""), self.options)
        return self.pages[path]

    def files(self) -> Iterator[tuple[str, str]]:
        while self.stack:
            path, at = self.stack[-1]
            try:
                children = self._children(path)
            except Exception as e:
                self.failed.append(path)
                self.errors[path] = str(e)
                self.stack.pop()
                continue
            if at >= len(children):
                self.pages.pop(path, None)
                self.stack.pop()
                continue
            self.stack[-1][1] += 1
            name, is_dir, url = children[at]
            below = f"{path}/{name}" if path else name
            if not is_dir:
                yield below, url
            elif self.leads(below):
                self.stack.append([below, 0])


class RepositoryReader(DataSourceReader):
    """Reads (path, url). A directory that can't be listed is an error once the others have been read, or
    with the option ``failures`` set to ``rows`` a row (path, null, error).

    Conditions on the path's start (or the whole path) decide what is listed: nothing outside is asked for, and the walk
    starts at the deepest directory they name. Those on its end leave out files. Directories are split into
    partitions below that start, level by level, until there are ``splits`` of them. Spark looks at every condition
    again. Listings give no sizes, so a condition on size has nothing to be pushed to; ``maxbytes`` holds at download.
    """

    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/") + "/"
        self.options, self.as_rows = http_options(options), failures_as_rows(options)
        self.splits = int({k.lower(): v for k, v in options.items()}.get("splits", 32))
        self.starts: list[str] = []
        self.ends: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(getattr(f, "value", None), str):
                if isinstance(f, StringStartsWith | EqualTo):
                    self.starts.append(f.value)
                if isinstance(f, StringEndsWith | EqualTo):
                    self.ends.append(f.value)
            yield f

    def leads(self, path: str) -> bool:
        """Whether what is below a directory can have the wanted start."""
        below = path + "/" if path else ""
        return all(below.startswith(s) or s.startswith(below) for s in self.starts)

    def wanted(self, path: str) -> bool:
        return all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends))

    def url(self, path: str) -> str:
        return self.root + (path + "/" if path else "")

    def partitions(self) -> list[Directory]:
        start = max(self.starts, key=len, default="").rpartition("/")[0]
        if not self.leads(start):
            return []
        whole, level = [], [start]
        while level and (level == [start] or len(level) < self.splits):
            below = []
            for path in level:
                try:
                    children = list_page(self.url(path), self.options)
                except Exception as e:
                    if path == start and getattr(e, "status", None) == 404 and self.starts:
                        return []  # no such directory, so nothing lies in it
                    if not path:
                        raise
                    below.append((path, False))  # its task reports it
                    continue
                whole.append(Directory(path, True))
                below += [(f"{path}/{name}" if path else name, True) for name, is_dir, _ in children if is_dir]
            whole += [Directory(p, False) for p, listed in below if not listed]
            level = [p for p, listed in below if listed and self.leads(p)]
        return whole + [Directory(p, False) for p in level]

    def read(self, partition: Directory | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads when there are no partitions
            return
        more = (None,) if self.as_rows else ()
        top = partition.path + "/" if partition.path else ""
        if partition.flat:
            pages = ((top + name, url) for name, is_dir, url in list_page(self.url(partition.path), self.options) if not is_dir)
            yield from ((p, url, *more) for p, url in pages if self.wanted(p))
            return
        walk = CursorWalk(self.url(partition.path), self.options, leads=lambda p: self.leads(top + p))
        yield from ((top + p, url, *more) for p, url in walk.files() if self.wanted(top + p))
        bad = [((top + p).rstrip("/"), walk.errors[p]) for p in walk.failed]
        if self.as_rows:
            yield from ((p, None, e) for p, e in bad)
        elif bad:
            raise OSError(f"can't list {len(bad)} directories: " + "; ".join(f"{p} ({e})" for p, e in bad[:20]))


class RepositoryStream(SimpleDataSourceStreamReader):
    """Files in walk order; the offset is the walk's cursor, so a restart goes on where it stopped.

    Directories that can't be listed stay in the offset and are tried again when the walk is through.
    """

    def __init__(self, options: dict) -> None:
        self.root, self.options, self.as_rows = options["path"], http_options(options), failures_as_rows(options)
        self.most = int(options.get("maxfilespertrigger", options.get("maxFilesPerTrigger", 50)))

    def initialOffset(self) -> dict:
        return {"cursor": [["", 0]], "failed": []}

    def _take(self, start: dict, most: int | None, end: dict | None = None) -> tuple[list, dict]:
        before = start.get("failed", [])
        cursor = start["cursor"] or [[p, 0] for p in reversed(before)]
        waiting = before if start["cursor"] else []
        walk, rows = CursorWalk(self.root, self.options, cursor), []
        for row in walk.files():
            rows.append((*row, None) if self.as_rows else row)
            if (most and len(rows) >= most) or (end and walk.stack == end["cursor"]):
                break
        return rows, {"cursor": [list(f) for f in walk.stack], "failed": sorted({*waiting, *walk.failed})}

    def read(self, start: dict):
        rows, end = self._take(start, self.most) if start["cursor"] or start.get("failed") else ([], start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._take(start, None, end)[0] if start["cursor"] or start.get("failed") else [])


def failures_as_rows(options: dict) -> bool:
    return {k.lower(): v for k, v in options.items()}.get("failures", "raise") == "rows"


class RepositorySource(DataSource):
    """``spark.read.format("repository").load(url)``: (path, url) of all files of a repository."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, url string" + ", error string" * failures_as_rows(self.options)

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)

    def simpleStreamReader(self, schema) -> RepositoryStream:
        return RepositoryStream(self.options)


def http_options(options: dict) -> Options:
    get = {k.lower(): v for k, v in options.items()}.get
    return Options(
        float(get("timeout", 30)), int(get("retries", 3)), float(get("qps", 0)), int(get("maxbytes", 0)),
        header=get("authheader", ""), token=get("authtoken", ""), user=get("authuser", ""), password=get("authpass", ""),
    )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepositorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
