"""License scans by voting on diagonals.

Every run of k words of every text is hashed and joined to the runs of the templates' words. A hit votes for
the diagonal ``place in text - place in template``; diagonals of one template that lie close together (words
put in or left out shift them) are merged, and the span of each is compared with the template's words by their
longest common subsequence; of notices at one place the likest stays. A template of fewer than k words is one run of its own length. ``PHRASES`` count by
places where all their words stand, ``NOTICES`` by likeness.

Nothing but hits and a row for each text leaves the first pass, so no text is shuffled there; the texts that have
spans to verify are read a second time. Texts are known by doc_id and a hash of the text, hence rows that repeat
one are verified once.

Edge cases: a null text is empty and has no words, no places and a score of 0; a null doc_id is an id like others;
repeated rows each get their row; very long texts are cut into runs in slices and verified in stretches of
``STRETCH`` words; equal likenesses need no choice, since all labels stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# The phrases and labels of the contract, and wordings of public license notices.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met"""),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software"""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Lower case for A-Z; a space for the ASCII signs that are no part of a word.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
STRETCH = 1 << 18
FACTOR = 0x9E3779B97F4A7C15  # an odd number, so that the order of words counts


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(LETTERS).split()


class WordHashes(dict):
    """XXH64 of words, kept until there are many."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


def rolled(values, size: int):
    """Hashes of all runs of ``size`` values, by their first one's place."""
    import numpy as np

    n = max(0, len(values) - size + 1)
    total = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            total = total * np.uint64(FACTOR) + values[j : j + n]
    return total ^ (total >> np.uint64(32))


def runs(batches, sizes: Sequence[int]):
    """Rows of (row, doc_id, text_hash, n_words, place, hash) from Arrow batches of (row, doc_id, text_hash, text): one for every
    run of each size, and one with place -1 for the text itself, which alone has doc_id, text_hash and n_words."""
    import numpy as np
    import pyarrow as pa

    known, most = WordHashes(), max(sizes) - 1
    names = ("row", "doc_id", "text_hash", "n_words", "place", "hash")
    kinds = None
    parts, held = [], 0

    def made():
        columns = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)]
        nothing = [pa.nulls(len(columns[0]), kinds[i]) for i in (1, 2, 3)]
        return pa.record_batch([columns[0], *nothing, columns[1], columns[2].view(pa.int64())], names=names)

    for batch in batches:
        kinds = [pa.int64(), batch.column(1).type, pa.int64(), pa.int64()]
        lengths = []
        for at, to in common.byte_slices(batch.column(3)):
            rows = batch.column(0).slice(at, to - at).to_pylist()
            for row, raw in zip(rows, batch.column(3).slice(at, to - at).cast(pa.binary()).to_pylist(), strict=True):
                tail, done = np.zeros(0, np.uint64), 0
                for piece in common.byte_chunks(raw.translate(LETTERS)):
                    new = np.fromiter(map(known.__getitem__, piece.split()), np.uint64)
                    values, back = np.concatenate([tail, new]), len(tail)
                    for size in sizes:
                        first = max(0, back - size + 1)  # runs that end before the new words are out already
                        hashes = rolled(values[first:], size)
                        if len(hashes):
                            places = np.arange(done - back + first, done - back + first + len(hashes), dtype=np.int64)
                            parts.append((np.full(len(hashes), row, np.int64), places, hashes))
                            held += len(hashes)
                    done += len(new)
                    tail = values[len(values) - min(most, len(values)) :]
                    if held >= 1 << 17:
                        yield made()
                        parts, held = [], 0
                lengths.append(done)
        k = batch.num_rows
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(lengths, pa.int64()), pa.array(np.full(k, -1)), batch.column(2)], names=names)
    if parts:
        yield made()


def templates(phrases=PHRASES, notices=NOTICES, k: int = 4) -> list[dict]:
    """number, label, words, size of run and kind of each template."""
    found = []
    for exact, entries in ((True, phrases), (False, notices)):
        for label, text in entries:
            words = words_of(text.encode())
            found.append({"template": len(found), "label": label, "words": words, "size": min(k, len(words)), "exact": exact})
    return found


def template_runs(spark, known: list[dict]) -> DataFrame:
    """(hash, template, at, size, length) of every run of the templates."""
    import numpy as np

    hashes, rows = WordHashes(), []
    for t in known:
        values = np.array([hashes[w] for w in t["words"]], np.uint64)
        rows += [(int(h), t["template"], i, t["size"], len(t["words"])) for i, h in enumerate(rolled(values, t["size"]).view(np.int64))]
    return spark.createDataFrame(rows, "hash long, template int, at int, size int, length int")


def hits(docs: DataFrame, known: list[dict]) -> DataFrame:
    """Every run of every text joined to the templates' runs: what meets one, and a row (place -1) for each text."""
    sizes = sorted({t["size"] for t in known})
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    found = rows.mapInArrow(common.frugal(lambda batches: runs(batches, sizes)), f"row long, doc_id {kind}, text_hash long, n_words long, place long, hash long")
    targets = template_runs(docs.sparkSession, known).withColumnRenamed("hash", "of")
    # A text's own row meets nothing, and stays: one reading gives both.
    met = found.join(common.small(targets), (F.col("hash") == F.col("of")) & (F.col("place") >= 0), "left")
    return common.materialize(met.where("place < 0 or template is not null").drop("hash", "of"), "license-hits")


def spans(found: DataFrame, share: float = 0.2, shift: int = 8) -> DataFrame:
    """(doc_id, text_hash, template, start, stop): votes by diagonal, neighbouring diagonals merged, those of too few votes left out."""
    named = found.where("place < 0").select("row", "doc_id", "text_hash")
    votes = found.where("place >= 0").select("row", "template", "place", "at", "size", "length").join(named, "row")
    key = ["doc_id", "text_hash", "template", "size", "length"]
    votes = votes.select(*key, "place", "at").distinct()  # repeated rows vote once
    here = F.struct("place", "at")
    diagonals = votes.groupBy(*key, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min(here).alias("first"), F.max(here).alias("last"))
    # Merged only within a quarter of the template's length, or copies on end would flow together;
    # a template that is a single run stands or doesn't.
    order = Window.partitionBy(*key).orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    breaks = F.when((F.col("size") < F.col("length")) & (step <= F.least(F.lit(shift), F.expr("length div 4"))), 0).otherwise(1)
    merged = diagonals.withColumn("_break", breaks).withColumn("run", F.sum("_break").over(order))
    merged = merged.groupBy(*key, "run").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    enough = merged.where(F.col("votes") >= F.lit(share) * (F.col("length") - F.col("size") + 1))
    # From where the template begins on the first hit's diagonal to where it ends on the last one's.
    start, stop = F.col("first.place") - F.col("first.at"), F.col("last.place") - F.col("last.at") + F.col("length")
    return enough.select("doc_id", "text_hash", "template", F.greatest(start, F.lit(0)).alias("start"), stop.alias("stop"))


def places_of(words: list) -> dict:
    """The places of each word as the bits of a whole number."""
    found = {}
    for i, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << i
    return found


def likest(places: dict, size: int, words: list) -> tuple[float, int]:
    """The largest likeness 2 c / (size + n) of a template of ``size`` words to the first n of ``words``, c being the length of
    their longest common subsequence (its rows of bits are added up a word at a time), and that n, the least of equals."""
    full = row = (1 << size) - 1
    best = (0.0, 0)
    for n, w in enumerate(words, 1):
        held = row & places.get(w, 0)
        row = ((row + held) | (row - held)) & full
        like = 2 * (size - row.bit_count()) / (size + n)
        if like > best[0]:
            best = (like, n)
    return best


def fitted(words: list, start: int, stop: int, template: dict, slack: int = 8) -> tuple[int, int, float]:
    """(start, stop, likeness) of the likest stretch: the end and then the start may move by ``slack`` words, since runs of
    fewer than k words at an end don't vote."""
    m = len(template["words"])
    slack = min(slack, m // 4)
    low = max(0, start - slack)
    _, n = likest(template["places"], m, words[low : stop + slack])
    like, back = likest(template["turned"], m, words[low : low + n][::-1])
    return low + n - back, low + n, like


def best_of(found: list[tuple], known: list[dict]) -> list[tuple]:
    """(template, start, stop, likeness) without the notices that share half of each other's words or more with a liker one:
    wordings of one family differ by a word."""
    found = sorted(found, key=lambda s: s[1])
    beaten = set()
    for i, (a, start, stop, like) in enumerate(found):
        for j in range(i + 1, len(found)):
            b, first, last, other = found[j]
            shared = min(stop, last) - first
            if shared <= 0:
                break
            if 2 * shared >= max(stop - start, last - first) and like != other and not known[a]["exact"] and not known[b]["exact"]:
                beaten.add(i if like < other else j)
    return [s for i, s in enumerate(found) if i not in beaten]


def verified(batches, known: list[dict], likeness: float):
    """(doc_id, text_hash, template, start, likeness) of the spans that hold, from batches of (doc_id, text_hash, text, spans)."""
    import pyarrow as pa

    known = [t | {"places": places_of(t["words"]), "turned": places_of(t["words"][::-1])} for t in known]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            words = words_of(row.column(2).cast(pa.binary())[0].as_py())
            out = []
            for s in row.column(3)[0].as_py():
                t = known[s["template"]]
                if t["exact"]:
                    found = (s["start"], s["stop"], float(words[s["start"] : s["stop"]] == t["words"]))
                else:
                    found = fitted(words, s["start"], s["stop"], t)
                if found[2] >= (1 if t["exact"] else likeness):
                    out.append((t["template"], *found))
            out = [(t, start, like) for t, start, _, like in best_of(out, known)]
            columns = [row.column(j).take(pa.array([0] * len(out), pa.int32())) for j in (0, 1)]
            columns += [pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.float64()))]
            yield pa.record_batch(columns, names=["doc_id", "text_hash", "template", "start", "likeness"])


def places(docs: DataFrame, found: DataFrame, known: list[dict], likeness: float = 0.93) -> DataFrame:
    """doc_id, text_hash, label, exact, start, likeness of every span of a text that is like its template."""
    kind = dict(docs.dtypes)["doc_id"]
    stretch = F.expr(f"start div {STRETCH}").alias("stretch")
    listed = spans(found).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), stretch).agg(F.collect_list(F.struct("template", "start", "stop")).alias("spans"))
    listed = common.materialize(listed.drop("stretch"), "license-spans")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    pairs = texts.join(common.small(listed), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text_hash", "text", "spans")
    checked = pairs.mapInArrow(common.frugal(lambda batches: verified(batches, known, likeness)), f"doc_id {kind}, text_hash long, template int, start long, likeness double")
    about = F.array(*[F.struct(F.lit(t["label"]).alias("label"), F.lit(t["exact"]).alias("exact")) for t in known])
    what = F.get(about, F.col("template"))
    return checked.distinct().select("doc_id", "text_hash", what["label"].alias("label"), what["exact"].alias("exact"), "start", "likeness")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = 4, likeness: float = 0.93) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of (doc_id, text)."""
    known = templates(phrases, notices, k)
    found = hits(docs, known)
    rows = places(docs, found, known, likeness)
    start = F.when(F.col("exact"), F.col("start"))
    joined = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    by_text = rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        joined(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("likeness").alias("score"),
    )
    by_text = common.materialize(by_text, "license-texts")
    every = found.where("place < 0").select("doc_id", "text_hash", "n_words")
    joined_rows = every.join(common.small(by_text), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = lambda name, value: F.coalesce(F.col(name), F.lit(value)).alias(name)
    return joined_rows.select("doc_id", "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))
