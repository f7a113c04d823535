import random
import tracemalloc

import numpy as np
import pyarrow as pa

from siltstone.llm import packing, queries, tokens


def test_places_of_ids_are_made_in_steps():
    definition = tokens.load_definition(queries.tokenizer_path())
    coder = tokens.WordTokenizer(definition)
    texts = pa.array(["ab cd ef " * 100_000] * 3)
    want, counts = coder.encode(texts, 1)  # the words are known from now on
    tracemalloc.start()
    ids, again = coder.encode(texts, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(ids, want) and again.tolist() == counts.tolist()
    assert peak < 45 * len(ids), f"{peak / len(ids):.0f} bytes an id"


def test_steps_and_kept_words_change_no_id(monkeypatch):
    definition = tokens.load_definition(queries.tokenizer_path())
    rng = random.Random(4)
    texts = pa.array([None, "", " \t", *["".join(rng.choices("abcde., \nä", k=rng.randrange(400))) for _ in range(200)]])
    want = [x for _, ids, n in tokens.encode_batches(texts, definition, 1) for x in (ids.tolist(), n.tolist())]
    monkeypatch.setattr(tokens, "STEP", 7)
    ids, counts = [], []
    for _, some, n in tokens.encode_batches(texts, definition, 1, 2000, (50, 20)):
        ids += some.tolist()
        counts += n.tolist()
    assert [ids, counts] == want
    assert tokens.tokenizer(definition, (50, 20)).count < 3000


def test_every_step_gives_its_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(tokens, "give_back", lambda: given.append(1))
    texts = pa.array(["some words " * 1000] * 8)
    steps = list(tokens.encode_batches(texts, tokens.load_definition(queries.tokenizer_path()), 1, 30_000, packing.WORDS))
    assert len(steps) == len(given) == 4
