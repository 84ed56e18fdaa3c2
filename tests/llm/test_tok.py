import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from brindle.llm import tok


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    path = P.path(name)
    rng = random.Random(5)
    parts = ["the", "The", "a", "don't", "x's", "Éa", "ß", "é", "42", "a1b2", "...", ",", ".", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x00", "\x1c", "\x85", "\xa0", "　", "日本", "🙂", "é", "́", "'ll", "'", "word,", "word.", "<|endoftext|>", "|", "ΑΣ", "İ", "ſ"]
    texts = [None, "", " ", "\n", "a", " a", "a ", "x\n y", "x \ny", "\0", "\1a b"]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " ", "\n"]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choice(parts[:14]) for _ in range(40)) for _ in range(300)]
    whole = [np.array(x.ids, "<u4").tobytes() for x in tok.load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    monkeypatch.setattr(tok, "CACHE_ENTRIES", 500)
    got = []
    for at in range(0, len(texts), 50):
        ids, begins = tok.encode(pa.array([None, *texts[at : at + 50]], pa.string()).slice(1), path)
        got += [ids[a:b].astype("<u4").tobytes() for a, b in zip(begins, begins[1:])]
    bad = [t for t, a, b in zip(texts, whole, got, strict=True) if a != b]
    assert not bad, bad[:3]


def test_ends_and_nothing():
    path = P.path("byte_bpe_50k.json")
    ids, begins = tok.encode(pa.array([], pa.string()), path)
    assert len(ids) == 0 and begins.tolist() == [0]
    ids, begins = tok.ended(*tok.encode(pa.array(["a", None, "", "a"], pa.string()), path), 7)
    assert begins.tolist() == [0, 2, 3, 4, 6] and ids[[1, 2, 3, 5]].tolist() == [7] * 4
