"""Quality scores by Bradley-Terry ranking.

Every text gets a short vector of surface statistics. A labelled good text should beat a labelled
bad one: for pairs of them the logistic loss on the difference of their vectors is minimised, which
gives a linear score. The score quantile that leaves as many labelled texts below as are labelled
bad becomes the threshold; scores are shifted so that it stands at ``CUT`` after the logistic curve.

The fit uses all labelled rows that aren't held out. They are dealt by hash to groups of about
``GROUP`` rows of the commoner kind; rows of the other kind go to as many groups as give each group
``RARE`` of them or all. Within a group pairs are drawn, so that a row of the commoner kind meets 40 of
the other kind on average. Each Newton step is a pass over the groups; only sums reach the driver. Means,
deviations and the threshold are exact over all rows.

Edge cases: null and empty texts have the zero vector and are scored like any other; labels that are
null or belong to no document are ignored, contradictory ones count as bad; without both kinds of
label every score is 0.5; repeated rows are scored each, and equal statistics score alike; very long texts are
read whole, one at a time; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GROUP = 2_500
RARE = 200
FIT_PAIRS = 100_000  # that are in memory at a time
CUT = 0.3


def features(text: str | None) -> list[float]:
    """Surface statistics of one text, each of moderate size."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    letters = digits = upper = alone = marked = 0
    chars = sum(map(len, words))
    joined = "".join(words)
    counts = Counter(joined)
    kinds: Counter[str] = Counter()
    for c, k in counts.items():
        if c.isalpha():
            letters += k
            upper += k * c.isupper()
        elif c.isdigit():
            digits += k
        else:
            kinds[c] += k
    plain = kinds["."] + kinds[","]
    for w in words:
        if not w[-1].isalnum():
            marked += 1
            alone += not any(map(str.isalnum, w))
    seen = Counter(words)
    triples = set(zip(words, words[1:], words[2:], strict=False))
    lines = text.split("\n")
    entropy = -sum(k / chars * math.log2(k / chars) for k in counts.values())
    return [
        math.log1p(n),
        chars / n / 10,
        upper / max(1, letters),
        (chars - letters - digits) / chars,
        digits / chars,
        (chars - letters - digits - plain) / chars,
        plain / n,
        marked / n,
        alone / n,
        len(seen) / n,
        max(seen.values()) / n,
        1 - len(triples) / max(1, n - 2) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(v for w, v in seen.items() if len(w) <= 3) / n,
        entropy / 5,
        max(kinds.values(), default=0) / n,
        sum(v for w, v in seen.items() if w[0].isupper()) / n,
    ]


FEATURES = 18


def expand(x: np.ndarray) -> np.ndarray:
    """Vectors with the squares of their parts, so that both extremes of a statistic can be bad."""
    return np.concatenate([x, x * x], axis=1)


def moments(x: np.ndarray, good: np.ndarray) -> tuple:
    """(rows, good rows, means, sums of squared deviations) of expanded vectors."""
    z = expand(x)
    mean = z.mean(axis=0)
    return len(z), int((good == 1).sum()), mean, ((z - mean) ** 2).sum(axis=0)


def merged(parts: list[tuple]) -> tuple:
    """The moments of all rows from those of parts of them."""
    n, ones, mean, squares = 0, 0, np.zeros(2 * FEATURES), np.zeros(2 * FEATURES)
    for m, o, its_mean, its_squares in parts:
        off = its_mean - mean
        squares = squares + its_squares + off**2 * (n * m / (n + m))
        n, ones, mean = n + m, ones + o, mean + off * (m / (n + m))
    scale = np.sqrt(squares / max(1, n))
    return n, ones, mean, np.where(scale > 1e-9, scale, 1.0)


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((expand(x) - mean) / scale, -8, 8)


def pair_sums(z: np.ndarray, good: np.ndarray, w: np.ndarray, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(pairs, gradient, Hessian) of the logistic loss, summed over the pairs drawn from a group."""
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    grad, hess = np.zeros(len(w)), np.zeros((len(w), len(w)))
    if not len(better) or not len(worse):
        return 0, grad, hess
    rng = np.random.default_rng(seed)
    pairs = 40 * max(len(better), len(worse))
    a, b = rng.choice(better, pairs), rng.choice(worse, pairs)
    for at in range(0, pairs, FIT_PAIRS):
        d = z[a[at : at + FIT_PAIRS]] - z[b[at : at + FIT_PAIRS]]
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        grad -= p @ d
        hess += (d * (p * (1 - p))[:, None]).T @ d
    return pairs, grad, hess


def newton(sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], ridge: float = 1e-2) -> np.ndarray:
    """Weights of the least mean loss, from its sums at given weights."""
    w = np.zeros(2 * FEATURES)
    for _ in range(30):
        pairs, grad, hess = sums(w)
        step = np.linalg.solve(hess / pairs + ridge * np.eye(len(w)), grad / pairs + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1e-2, seed: int = 7) -> dict:
    """Weights of the linear score, and its threshold, from the vectors and labels of one group."""
    n, ones, mean, scale = merged([moments(x, good)] if len(x) else [])
    if not 0 < ones < n:
        return {"mean": mean, "scale": scale, "w": np.zeros(2 * FEATURES), "cut": None}
    z = scaled(x, mean, scale)
    w = newton(lambda w: pair_sums(z, good, w, seed), ridge)
    s = np.sort(z @ w)
    return {"mean": mean, "scale": scale, "w": w, "cut": float((s[n - ones - 1] + s[n - ones]) / 2)}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if model["cut"] is None:
        return np.full(len(x), 0.5)
    s = scaled(x, model["mean"], model["scale"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(s - model["cut"] + math.log(CUT / (1 - CUT)), -40, 40)))


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def vectors(texts: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The vectors of a column of texts, and a checksum of each."""
    x, keys = np.empty((len(texts), FEATURES)), []
    for at, to in common.byte_slices(texts):
        for i, t in enumerate(texts.slice(at, to - at).to_pylist(), at):
            x[i] = features(t)
            keys.append(zlib.crc32((t or "").encode()))
    return x, keys


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, nth, x): the vector of each row; key tells rows of one id apart by their text, nth
    rows of one id and key within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, keys = vectors(batch.column(1))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))
            seen: Counter[tuple] = Counter()
            nth = []
            for at in zip(batch.column(0).to_pylist(), keys, strict=True):
                nth.append(seen[at])
                seen[at] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(nth, pa.int64()), rows], names=["doc_id", "key", "nth", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.frugal(run), "doc_id long, key long, nth long, x array<double>")


def trainable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): the labels that a fit may look at, marked for the join that their number allows."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~is_held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return F.broadcast(known) if few(labels) else known.hint("merge")


def few(labels: DataFrame, most_rows: int = 200_000) -> bool:
    return labels.count() <= most_rows


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, FEATURES)


def all_moments(rows: DataFrame) -> tuple:
    """``merged`` of the rows (x, quality)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                n, ones, mean, squares = moments(vectors_of(batch.column(0)), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([ones]), pa.array([mean.tolist()]), pa.array([squares.tolist()])], names=["n", "ones", "mean", "squares"])

    found = rows.select("x", F.col("quality").cast("int")).mapInArrow(common.frugal(run), "n long, ones long, mean array<double>, squares array<double>").collect()
    return merged([(r.n, r.ones, np.array(r.mean), np.array(r.squares)) for r in found])


def grouped(rows: DataFrame, n: int, ones: int, group: int) -> DataFrame:
    """(g, x, quality): the rows dealt to groups; a group's rows follow one another in one file."""
    groups = max(1, -(-max(ones, n - ones) // group))
    rare, few_rows = (1, ones) if 2 * ones < n else (0, n - ones)
    times = min(groups, -(-RARE * groups // few_rows))
    first = F.pmod(F.xxhash64("doc_id", "key", "nth"), F.lit(groups))
    last = F.when(F.col("quality") == rare, times - 1).otherwise(0)
    dealt = rows.withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: (first + i) % groups)))
    files = -(-(n + times * few_rows) // 20_000)  # far from the size at which Parquet splits a file
    return dealt.repartition(files, "g").sortWithinPartitions("g", F.xxhash64("doc_id"), "doc_id", "key").select("g", "x", F.col("quality").cast("int").alias("quality"))


def group_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """``pair_sums`` of all groups of a written ``grouped`` table; a task sends one row."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            g, x, good = batch.column(0).to_numpy(), vectors_of(batch.column(1)), batch.column(2).to_numpy()
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(g)) + 1), len(g)] if len(g) else []):
                if held and g[a] != now:
                    yield int(now), *map(np.concatenate, zip(*held, strict=True))
                    held = []
                now = g[a]
                held.append((x[a:b], good[a:b]))
        if held:
            yield int(now), *map(np.concatenate, zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, pairs, grad, hess = None, 0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for g, x, good in groups(batches):
            some, down, curve = pair_sums(scaled(x, mean, scale), good, w, seed + g)
            least, pairs, grad, hess = g if least is None else min(least, g), pairs + some, grad + down, hess + curve
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([pairs]), pa.array([[*grad, *hess.ravel()]])], names=["g", "pairs", "sums"])

    found = sorted(rows.mapInArrow(common.frugal(run), "g long, pairs long, sums array<double>").collect())
    total = np.sum([r.sums for r in found], axis=0)
    return sum(r.pairs for r in found), total[: len(w)], total[len(w) :].reshape(len(w), len(w))


def at_rank(values: DataFrame, n: int, rank: int, most_rows: int = 100_000) -> float:
    """The value with ``rank`` smaller or equal ones before it in the sorted column ``s`` of ``n`` rows."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while n > most_rows and low < high:
        place = F.least(F.floor((F.col("s") - low) / ((high - low) / 4096)), F.lit(4095))
        for r in sorted(values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            if rank < r.n:
                break
            rank -= r.n
        n, low, high = r.n, r.low, r.high
        values = values.where(F.col("s").between(low, high))
    return low if low == high else sorted(r.s for r in values.collect())[rank]


def train(rows: DataFrame, labels: DataFrame, group: int = GROUP, seed: int = 7) -> dict:
    """Fit on all labelled rows that are not held out. ``rows`` is a feature table."""
    known = common.materialize(rows.join(trainable(labels), "doc_id").select("doc_id", "key", "nth", "x", "quality"), "labelled")
    n, ones, mean, scale = all_moments(known)
    if not 0 < ones < n:
        return {"mean": mean, "scale": scale, "w": np.zeros(2 * FEATURES), "cut": None}
    dealt = common.materialize(grouped(known, n, ones, group), "groups")
    w = newton(lambda w: group_sums(dealt, mean, scale, w, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scaled(vectors_of(batch.column(0)), mean, scale) @ w)], names=["s"])

    values = common.materialize(known.select("x").mapInArrow(common.frugal(run), "s double"), "fit-scores")
    return {"mean": mean, "scale": scale, "w": w, "cut": (at_rank(values, n, n - ones - 1) + at_rank(values, n, n - ones)) / 2}


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, key, held_out, score, predicted) per row of ``docs``. No exchange of texts."""
    rows = common.materialize(feature_table(docs), "features")
    model = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score(vectors_of(batch.column(2)), model))], names=["doc_id", "key", "score"])

    scored = rows.select("doc_id", "key", "x").mapInArrow(common.frugal(run), "doc_id long, key long, score double")
    return scored.select("doc_id", "key", is_held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    model = train(common.materialize(feature_table(labelled(docs, labels)), "features"), labels)

    names = [f"c{i}" for i in range(len(docs.columns))]  # extra columns may clash in name
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(vectors(batch.column(at))[0], model) >= CUT))

    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(names, docs.schema, strict=True)])
    return docs.toDF(*names).mapInArrow(common.frugal(run), schema).toDF(*docs.columns)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At least the documents that a fit may look at; texts aren't exchanged to leave out others."""
    docs = docs.select("doc_id", "text")
    return docs.join(trainable(labels).select("doc_id").hint("broadcast"), "doc_id", "left_semi") if few(labels) else docs
