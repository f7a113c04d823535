"""Phrase collocations by compressed position bitmaps of words, in the manner of SPAM.

A task lays the words of its texts out along one line for each language, an empty place between pieces,
and cuts the line into shards of a bounded number of places. A shard holds for every word a bitmap of its
places: blocks of ``WIDTH`` places with a mask each, blocks without a bit left out. A phrase's bitmap marks
its last words; shifted by one place and ANDed with the bitmaps of words it gives the bitmaps of the longer
phrases, whose set bits are their occurrences, depth-first for a bounded batch of masks at a time. Bits are
counted within a shard, the counts summed over all shards:

1. words over all shards; only those that are frequent enough go on, by a number of their own;
2. pairs of such words;
3. phrases of three and four words whose pairs are all frequent. Tasks know frequent pairs by a bit table of
   at most ``FILTER_BITS`` bits; what it lets through by mistake falls to the exact sums.

A shard takes over the last ``LEAD`` places of the one before, whose bits extend but aren't counted, so
phrases across a cut are counted once and a piece may have any length.

Edge cases: a null text is empty, a null language is ``und``; texts without words give nothing; repeated
rows count each time; very long texts are laid out in slices; extra columns are left behind; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WIDTH = 16  # places in a block, the bits of a mask
LEAD = 3
#: A-Z in lower case, tab as space, signs between pieces as a line feed.
SIGNS = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
FILTER_BITS = 1 << 27
#: A row of a shard's bitmaps has no word; a row of a word has no bitmaps.
SHARDS = "shard long, lang string, word string, local int, n long, lead int, starts binary, blocks binary, masks binary"
COUNTS = "a long, b long, c long, d long, n long"


class Numbers(dict):
    """Words numbered from 1 as they come; the gap is 0, nothing is -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word):
        self[word] = number = len(self) - 1
        return number


class Line:
    """The places of one language in a task, cut into shards of about ``most`` places."""

    def __init__(self, most: int):
        self.most, self.numbers, self.parts, self.size, self.lead = most, Numbers(), [], 0, 0

    def add(self, raw: bytes):
        """Lay out a text; yields the shards that get full."""
        import numpy as np

        for part in common.byte_chunks(raw.translate(SIGNS).replace(b"\n", b" \n ") + b" \n ", most=1 << 18):
            places = np.array(list(map(self.numbers.__getitem__, part.split(b" "))), dtype=np.int32)
            self.parts.append(places[places >= 0])
            self.size += len(self.parts[-1])
            if self.size >= self.most:
                yield self.shard()

    def shard(self) -> tuple:
        """(words, places, lead) so far; the last places lead the next shard."""
        import numpy as np

        words, places, lead = list(self.numbers)[2:], np.concatenate(self.parts), self.lead
        # Numbered in the order of the words, which makes rows of words and of phrases alike their neighbours, hence short.
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.zeros(len(words) + 1, np.int32)
        rank[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1, dtype=np.int32)
        words, places = [words[i] for i in order], rank[places]
        self.numbers = Numbers()
        first = np.array([self.numbers[words[i - 1]] if i else 0 for i in places[-LEAD:]], dtype=np.int32)
        self.parts, self.size, self.lead = [first], len(first), len(first)
        return words, places, lead


def bitmaps(places):
    """(word, block, mask) of the words of a line, by word and block; place p is bit p % WIDTH of block p // WIDTH."""
    import numpy as np

    at = np.flatnonzero(places)
    at = at[np.argsort(places[at], kind="stable")].astype(np.int64)
    key = (places[at].astype(np.int64) << 32) | (at // WIDTH)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    masks = np.bitwise_or.reduceat((1 << (at % WIDTH)).astype(np.uint16), first) if len(at) else np.zeros(0, np.uint16)
    return (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32), masks


def planes(values) -> bytes:
    """Whole numbers byte by byte: all first bytes, all second bytes."""
    import numpy as np

    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def numbers(raw: bytes, kind):
    import numpy as np

    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, len(raw) // kind.itemsize).T).view(kind).ravel()


def squeezed(values) -> bytes:
    """Differences of whole numbers in zstd."""
    import numpy as np
    import zstandard

    return zstandard.compress(planes(np.diff(values, prepend=values.dtype.type(0))), 3)


def unsqueezed(raw: bytes, kind):
    import numpy as np
    import zstandard

    return np.cumsum(numbers(zstandard.decompress(raw), kind), dtype=kind)


def squeezed_masks(masks) -> bytes:
    """The number of each mask's lowest bit, and its other bits, which are few, in zstd."""
    import numpy as np
    import zstandard

    lowest = masks & (~masks + np.uint16(1))
    return zstandard.compress(np.log2(lowest).astype(np.uint8).tobytes() + planes(masks ^ lowest), 3)


def unsqueezed_masks(raw: bytes):
    import numpy as np
    import zstandard

    raw = zstandard.decompress(raw)
    n = len(raw) // 3
    return numbers(raw[n:], np.uint16) | (1 << np.frombuffer(raw[:n], np.uint8).astype(np.uint16)).astype(np.uint16)


def encode(batches, most: int, lines: int = 64):
    """Rows of ``SHARDS`` from Arrow batches of (lang, text, part): a row for each shard, one for each of its words.
    Beyond ``lines`` languages at once the longest line is cut, so memory doesn't grow with languages."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64()), ("lead", pa.int32())] + [(c, pa.binary()) for c in ("starts", "blocks", "masks")])
    open_lines, made, task = {}, 0, 0

    def rows(lang, shard):
        nonlocal made
        words, places, lead = shard
        number, made = (task << 32) | made, made + 1
        counts = np.bincount(places[lead:], minlength=len(words) + 1)[1:]
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            k, nothing = len(part), pa.nulls(len(part), pa.binary())
            columns = [pa.repeat(pa.scalar(number, pa.int64()), k), pa.repeat(pa.scalar(lang), k), pa.array(part, pa.binary()).cast(pa.string()), pa.array(np.arange(at + 1, at + 1 + k, dtype=np.int32))]
            yield pa.record_batch([*columns, pa.array(counts[at : at + k].astype(np.int64)), pa.nulls(k, pa.int32()), nothing, nothing, nothing], schema)
        word, block, mask = bitmaps(places)
        starts = np.searchsorted(word, np.arange(1, len(words) + 2)).astype(np.int32)
        one = [number, lang, None, None, len(places), lead, squeezed(starts), squeezed(block), squeezed_masks(mask)]
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip(one, schema, strict=True)], schema)

    for batch in batches:
        for at, to in common.byte_slices(batch.column(1)):
            langs, texts, tasks = (batch.column(i).slice(at, to - at) for i in range(3))
            for lang, raw, task in zip(langs.to_pylist(), texts.cast(pa.binary()).to_pylist(), tasks.to_pylist(), strict=True):
                line = open_lines.setdefault(lang, Line(most))
                for shard in line.add(raw):
                    yield from rows(lang, shard)
                if len(open_lines) > lines:
                    longest = max(open_lines, key=lambda x: open_lines[x].size)
                    yield from rows(longest, open_lines.pop(longest).shard())
    for lang, line in open_lines.items():
        if line.size > line.lead:
            yield from rows(lang, line.shard())


class Shard:
    """The bitmaps of one shard's frequent words, by block; words are numbered along ``ids``."""

    def __init__(self, row: dict, local, ids):
        import numpy as np

        starts, blocks, masks = unsqueezed(row["starts"], np.int32), unsqueezed(row["blocks"], np.int32), unsqueezed_masks(row["masks"])
        order = np.argsort(local)
        self.ids, kept = ids[order], local[order] - 1
        n = starts[kept + 1] - starts[kept]
        at = np.repeat(starts[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.word, self.block, self.mask = np.repeat(np.arange(len(kept)), n), blocks[at], masks[at]
        by_block = np.argsort(self.block, kind="stable")
        self.at_word, self.at_mask = self.word[by_block], self.mask[by_block]
        self.first = np.searchsorted(self.block[by_block], np.arange(row["n"] // WIDTH + 2))
        self.unled = np.uint16((0xFFFF << row["lead"]) & 0xFFFF)

    def batches(self, phrase, block, mask, most: int):
        """Bitmaps in batches of rows that meet at most about ``most`` masks of words."""
        import numpy as np

        meets = np.cumsum(self.first[block + 1] - self.first[block])
        at = 0
        while at < len(block):
            to = max(at + 1, int(np.searchsorted(meets, (meets[at - 1] if at else 0) + most, "right")))
            yield phrase[at:to], block[at:to], mask[at:to]
            at = to

    def extended(self, phrase, block, mask):
        """(phrase, word, block, mask) of the phrases one word longer: shift by a place, AND with each word's bits."""
        import numpy as np

        over = np.flatnonzero((mask >> (WIDTH - 1)) & (block + 2 < len(self.first)))
        phrase, block = np.r_[phrase, phrase[over]], np.r_[block, block[over] + 1]
        mask = np.r_[(mask << 1).astype(np.uint16), np.ones(len(over), np.uint16)]
        n = self.first[block + 1] - self.first[block]
        row = np.repeat(np.arange(len(block), dtype=np.int32), n)
        at = np.arange(len(row)) + np.repeat(self.first[block] - (np.cumsum(n) - n), n)
        both = mask[row] & self.at_mask[at]
        hit = np.flatnonzero(both)
        row, at = row[hit], at[hit]
        return phrase[row], self.at_word[at], block[row], both[hit]

    def grow(self, phrases, rows, depth: int, allowed, most: int):
        """Depth-first: (phrases, counts) of all extensions up to ``depth`` words; ``allowed`` says of arrays of
        last and next words which may follow. ``phrases`` has a row of word numbers for each phrase of ``rows``."""
        import numpy as np

        for part in self.batches(*rows, most):
            phrase, word, block, mask = self.extended(*part)
            pairs, again = np.unique(phrase.astype(np.int64) * len(self.ids) + word, return_inverse=True)
            longer = np.column_stack([phrases[pairs // len(self.ids)], pairs % len(self.ids)])
            counted = np.where(block == 0, mask & self.unled, mask)
            counts = np.bincount(again, np.bitwise_count(counted), len(pairs)).astype(np.int64)
            if allowed is not None:
                ok = allowed(self.ids[longer[:, -2]], self.ids[longer[:, -1]])
                left = np.flatnonzero(ok[again])
                number = np.cumsum(ok) - 1
                longer, counts, again, block, mask = longer[ok], counts[ok], number[again[left]], block[left], mask[left]
            yield longer, counts
            if longer.shape[1] < depth and len(longer):
                yield from self.grow(longer, (again, block, mask), depth, allowed, most)


def mined(depths: tuple[int, ...], table=None, most: int = 1 << 21):
    """A function over a shard's row and its frequent words (local, id) giving rows of ``COUNTS`` for phrases of these lengths."""

    def run(shards, words):
        import numpy as np
        import pyarrow as pa

        found = {k: [] for k in ("a", "b", "c", "d", "n")}
        if len(shards) and len(words):
            shard = Shard(shards.to_pylist()[0], words.column("local").to_numpy(), words.column("id").to_numpy())
            every = np.arange(len(shard.ids)).reshape(-1, 1)
            allowed = None if table is None else lambda a, b: in_table(table.value, a, b)
            for phrases, counts in shard.grow(every, (shard.word, shard.block, shard.mask), max(depths), allowed, most):
                m = phrases.shape[1]
                if m in depths and len(phrases):
                    for i, k in enumerate("abcd"):
                        found[k].append(pa.array(shard.ids[phrases[:, i]], pa.int64()) if i < m else pa.nulls(len(phrases), pa.int64()))
                    found["n"].append(pa.array(counts))
        common.give_back()
        return pa.table({k: pa.chunked_array(v, pa.int64()) for k, v in found.items()})

    return run


def bits_of(a, b, bits: int):
    """Places of pairs of word numbers in a bit table: a multiplicative hash."""
    import numpy as np

    with np.errstate(over="ignore"):
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(65 - bits.bit_length())


def in_table(table, a, b):
    import numpy as np

    at = bits_of(a, b, len(table) * 64)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_table(pairs: DataFrame, most: int = FILTER_BITS):
    """The pairs (a, b) as a bit table on the driver: 16 bits or more a pair, ``most`` (16 MiB) at most however many they are."""
    import numpy as np

    bits = min(most, 1 << max(10, (16 * pairs.count()).bit_length()))

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            at = bits_of(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            yield pa.record_batch({"word": pa.array((at >> np.uint64(6)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    words = pairs.select("a", "b").mapInArrow(placed, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def phrases(docs: DataFrame, least: int = 30, places: int = 1 << 21) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, candidates, totals): (id, lang, word, n) of the words and (ids, a) of the phrases of two to four words that occur
    ``least`` times or more in their language, and the number of all words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("task"))
    made = common.materialize(rows.mapInArrow(common.frugal(lambda batches: encode(batches, places)), SHARDS), "shards")
    local = made.where("word is not null")
    words = local.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = local.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where(F.col("n") >= least).repartitionByRange("lang", "word").sortWithinPartitions("lang", "word")
    words = common.materialize(words.withColumn("id", F.monotonically_increasing_id()), "words")
    mine = local.select("shard", "lang", "word", "local").join(common.small(words.drop("n")), ["lang", "word"])
    mine = common.materialize(mine.select("shard", "local", "id"), "shard-words").groupBy("shard")
    whole = made.where("word is null").select("shard", "n", "lead", "starts", "blocks", "masks").groupBy("shard")
    often = lambda found, *by: found.groupBy(*by).agg(F.sum("n").alias("a_")).where(F.col("a_") >= least)
    pairs = often(whole.cogroup(mine).applyInArrow(mined((2,)), COUNTS), "a", "b")
    pairs = common.materialize(pairs, "pairs")
    table = spark.sparkContext.broadcast(bit_table(pairs))
    longer = often(whole.cogroup(mine).applyInArrow(mined((3, 4), table), COUNTS), "a", "b", "c", "d")
    longer = longer.select(F.filter(F.array("a", "b", "c", "d"), lambda x: x.isNotNull()).alias("ids"), F.col("a_").alias("a"))
    candidates = pairs.select(F.array("a", "b").alias("ids"), F.col("a_").alias("a")).unionByName(longer)
    return words, common.materialize(candidates, "candidates"), totals


def part_counts(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """(ids, a, k, l, r) for every cut of the candidates after k words: all parts are frequent themselves."""
    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    every = candidates.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    of = lambda part, n: every.select(F.col("ids").alias(part), F.col("a").alias(n))
    cuts = candidates.select("ids", "a", cut).withColumn("first", F.expr("slice(ids, 1, k)")).withColumn("rest", F.expr("slice(ids, k + 1, size(ids) - k)"))
    return cuts.join(of("first", "l"), "first").join(of("rest", "r"), "rest").select("ids", "a", "k", "l", "r")


def inner_counts(candidates: DataFrame) -> DataFrame:
    """(ids, longer): for each phrase inside longer candidates the largest count of one of them."""
    long = candidates.where(F.size("ids") > 2)
    spans = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")
    return long.select(F.explode(spans).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))


def product(factor: int, n: str) -> Column:
    """A product that may pass 64 bits."""
    return F.expr(f"cast({factor} as decimal(10,0)) * cast({n} as decimal(19,0))")


def mine(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, places: int = 1 << 21) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of two to four words.

    A phrase that occurs ``a`` times scores floor(2,000,000 a / (l + r)) by its lowest-scoring cut; one that lies in a longer
    candidate with at least ``inside`` percent of its occurrences is left out.
    """
    words, candidates, totals = phrases(docs, least, places)
    cuts = part_counts(candidates, words).withColumn("score", F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(20,0))"))
    best = cuts.groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("ids", "best.*")
    whole = best.join(inner_counts(candidates), "ids", "left").where(F.col("longer").isNull() | (product(100, "longer") < product(inside, "a")))
    named = whole.select("*", F.posexplode("ids").alias("place", "id")).join(common.small(words.drop("n")), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    named = named.groupBy("ids", "lang", "a", "l", "r", "score").agg(text.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
