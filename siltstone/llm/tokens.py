"""Token ids of whole texts, through a word cache in front of the tokenizers library."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_slices, give_back

#: Words that one Python worker keeps for good, and how many later ones besides.
FIRST_WORDS, MORE_WORDS = 220_000, 150_000
#: Words whose ids are looked up at a time: the places of ids take several times the ids' own memory.
STEP = 1 << 16
#: Where a letter and punctuation meet, the pre-tokenizer cuts in any case; cutting there first
#: makes fewer distinct words.
PUNCTUATION = r"(\pL)([.,;:!?%$&#*])"
#: Stands for the end of a text among the words; white space, so no word of a text is like it.
END = " end "
_LIVE: dict[str, WordTokenizer] = {}


def load_definition(path: str) -> str:
    """The tokenizer's JSON, read on the driver and sent along with the tasks."""
    return Path(path).read_text(encoding="utf-8")


def tokenizer(definition: str, keep: tuple[int, int] = (FIRST_WORDS, MORE_WORDS)) -> WordTokenizer:
    key = hashlib.md5(f"{keep}{definition}".encode()).hexdigest()
    if key not in _LIVE:
        _LIVE[key] = WordTokenizer(definition, keep)
    return _LIVE[key]


class WordTokenizer:
    """Encode texts word by word.

    Valid for tokenizers whose pieces never cross ASCII white space and drop it (the word BPE of
    this project does): the ids of a text are then the ids of its white-space separated words, one
    after another, so each distinct word is encoded once and looked up afterwards.
    """

    def __init__(self, definition: str, keep: tuple[int, int] = (FIRST_WORDS, MORE_WORDS)) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_str(definition)
        self.first_words, self.more_words = keep
        vocabulary = self.inner.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.codes: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = self.count = 0
        self.kept: tuple[int, int] | None = None

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, np.uint32)

    def _trim(self) -> None:
        """Forget all but the words that came first, which are the frequent ones."""
        if self.kept is None:
            self.kept = self.count, self.used
        elif self.count > self.kept[0] + self.more_words:
            self.count, self.used = self.kept
            self.codes = {w: c for w, c in self.codes.items() if c < self.count}

    def _add(self, words: list[str]) -> None:
        """Words of letters are one piece of the pre-tokenizer each, so many can be encoded at once
        and told apart by the pieces that end a word; others are encoded alone."""
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        for at in range(0, len(plain), 200):
            part = plain[at : at + 200]
            ids = self._encode(" ".join(part))
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part):
                self._store(part, ids, np.diff(np.r_[-1, last]))
            else:
                odd += part
        for w in odd:
            ids = self._encode(w)
            self._store([w], ids, np.array([len(ids)]))

    def _gather(self, code: np.ndarray) -> np.ndarray:
        """The ids of words, one after another."""
        size = self.size[code]
        ends = np.cumsum(size)
        at = np.repeat(self.start[code] - ends + size, size)
        at += np.arange(len(at))
        return self.flat[at]

    def _store(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        here = slice(self.count, self.count + len(words))
        self.size[here], self.start[here] = sizes, self.used + np.cumsum(sizes) - sizes
        self.codes.update(zip(words, range(self.count, self.count + len(words)), strict=True))
        self.used, self.count = self.used + len(ids), self.count + len(words)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32 bit) of texts, each followed by ``end``, one after another, and how many
        ids each text has; null counts as empty."""
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, PUNCTUATION, r"\1 \2"))
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        del split
        words = coded.dictionary.to_pylist()
        if self.count > self.first_words:
            self._trim()
        if new := [w for w in words if w not in self.codes]:
            self._add(new)
        known = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        code = known[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        del coded, words, new
        if (mark := self.codes.get(f"{END}{end}")) is None:
            self._store([f"{END}{end}"], np.array([end], np.uint32), np.array([1]))
            mark = self.codes[f"{END}{end}"]
        code = np.insert(code, np.cumsum(counts), mark)
        n_ids = np.add.reduceat(self.size[code], np.cumsum(counts + 1) - counts - 1) if len(counts) else counts
        return np.concatenate([self._gather(code[at : at + STEP]) for at in range(0, max(1, len(code)), STEP)]), n_ids


def encode_batches(texts: pa.Array, definition: str, end: int, most: int = 5 << 20, keep: tuple[int, int] = (FIRST_WORDS, MORE_WORDS)):
    """Encode a column of texts in steps of about ``most`` bytes: (first row, ids, ids of each row).
    What a step leaves free goes back to the system, or a worker keeps several steps' memory."""
    coder = tokenizer(definition, keep)
    for at, to in byte_slices(texts, most):
        yield at, *coder.encode(texts.slice(at, to - at), end)
        give_back()
