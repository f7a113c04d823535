"""Bounded-space online packing of token streams into fixed windows.

Each partition keeps at most ``open_windows`` windows. A document's full windows leave at once; the
rest goes to the open window with the least room that still takes it (best fit), or to a new one.
When none fits and none may be opened, the fullest is emitted: the document's first ids fill its
last places, so it leaves without padding, and what remains is placed again. At the end of a
partition its open windows are merged into full ones and one leftover; leftovers of all partitions
are merged in rounds of ``fan_in`` (each brings less than one window), and the last leftover is cut
into windows whose lengths are powers of two, which need no padding.

Rows: one per piece. Null and empty texts have the end id only; repeated rows are separate
documents; ids of a very long text are looked up in bounded steps and leave window by window; of windows with
equal room the first is taken; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encode_batches, load_definition

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
#: Text encoded at a time, and words kept (first, later): packing comes last in a pipeline, beside a JVM grown large.
SLICE, WORDS = 3 << 20, (100_000, 60_000)
TYPES = [pa.int64()] * 8 + [pa.binary()]
NAMES = [c.split()[0] for c in PIECES.split(", ")]


class Packer:
    """The open windows of one partition. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, size: int, slots: int, first_id: int) -> None:
        self.size, self.slots, self.next_id = size, slots, first_id
        self.windows: list[list] = []  # [room, pieces]
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.done.append((doc, start, len(ids), crc, total, self.next_id, at, None, None))
            at += len(ids)
        self.next_id += 1

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        """Place a piece of a document, in full windows and a rest."""
        while len(ids) >= self.size:
            self._emit([(doc, start, total, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            best = min((w for w in self.windows if w[0] >= len(ids)), key=lambda w: w[0], default=None)
            if best is None and len(self.windows) < self.slots:
                best = [self.size, []]
                self.windows.append(best)
            if best is None:
                best = min(self.windows, key=lambda w: w[0])
            here = ids[: best[0]]
            best[1].append((doc, start, total, here))
            best[0] -= len(here)
            start, ids = start + len(here), ids[len(here) :]
            if not best[0]:
                self.windows.remove(best)
                self._emit(best[1])

    def merge(self) -> None:
        """Join the open windows, fullest first, into full ones and one leftover."""
        windows = sorted(self.windows, key=lambda w: w[0])
        self.windows, self.slots = [], 1
        for _, pieces in windows:
            for piece in pieces:
                self.add(*piece)

    def close(self) -> None:
        """Cut the leftover into windows of a power of two."""
        self.merge()
        pieces = [p for w in self.windows for p in w[1]]
        self.windows = []
        left = sum(len(p[3]) for p in pieces)
        while left:
            take = 1 << (left.bit_length() - 1)
            left -= take
            chosen = []
            while take:
                doc, start, total, ids = pieces.pop(0)
                chosen.append((doc, start, total, ids[:take]))
                if len(ids) > take:
                    pieces.insert(0, (doc, start + take, total, ids[take:]))
                take -= len(chosen[-1][3])
            self._emit(chosen)

    def leftover(self, part: int) -> list[tuple]:
        rows = [(d, s, len(i), None, t, None, None, part, i.astype("<u4").tobytes()) for w in self.windows for d, s, t, i in w[1]]
        self.windows = []
        return rows

    def flush(self, more: list[tuple] = ()) -> pa.RecordBatch:
        rows, self.done = [*self.done, *more], []
        columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, open_windows: int = 16, fan_in: int = 128) -> DataFrame:
    """Pack (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    No shuffle of texts or ids: tokens are packed where the text is read. Each partition's result is
    written before leftovers are looked at, so windows never change afterwards.
    """
    definition = load_definition(tokenizer_path)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = Packer(size, open_windows, part << 32)
        for batch in batches:
            who = batch.column(0).to_pylist()
            for at, flat, counts in encode_batches(batch.column(1), definition, end_id, SLICE, WORDS):
                ends = np.cumsum(counts)
                for doc, end, n in zip(who[at : at + len(counts)], ends.tolist(), counts.tolist(), strict=True):
                    packer.add(doc, 0, n, flat[end - n : end])
                # open windows must not keep whole batches of ids alive
                for w in packer.windows:
                    w[1] = [(d, s, t, i.copy()) for d, s, t, i in w[1]]
                yield packer.flush()
        packer.merge()
        yield packer.flush(packer.leftover(part))

    def merging(level: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packers: dict[int, Packer] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    p = packers.get(r["part"])
                    if p is None:
                        p = packers[r["part"]] = Packer(size, 1, (level << 56) + (r["part"] << 32))
                    p.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4"))
            for part, p in packers.items():
                if last:
                    p.close()
                yield p.flush(p.leftover(part))

        return merge

    texts = docs.select("doc_id", "text")
    packed = common.materialize(texts.mapInArrow(common.frugal(first), PIECES), "packed")
    results, rest, level = [packed.where("ids is null")], packed.where("ids is not null"), 0
    while True:
        level += 1
        top = rest.agg(F.max("part")).first()[0]
        if top is None:
            break
        last = top < fan_in
        grouped = rest.withColumn("part", F.expr(f"part div {fan_in}"))
        ordered = grouped.repartition("part").sortWithinPartitions("part", "doc_id", "start", "ids")
        rest = common.materialize(ordered.mapInArrow(common.frugal(merging(level, last)), PIECES), "leftovers")
        results.append(rest.where("ids is null"))
        rest = rest.where("ids is not null")
        if last:
            break
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.drop("part", "ids")
