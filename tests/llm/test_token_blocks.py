"""Many texts are encoded together and many blocks coded side by side, with the results of each alone."""

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from glyphloom.llm import tokenfile as T


def _ids(texts):
    frame = pd.DataFrame({"part": 0, "doc_id": range(len(texts)), "text": texts})
    out = pd.concat(T._tokenize(T.default_vocabulary(), 2)(iter([frame])))
    assert out["seq"].tolist() == list(range(len(texts)))
    return [np.frombuffer(b, np.uint32).tolist() for b in out["ids"]]


@pytest.mark.parametrize("chars", [1, 7, 40, 1000])
def test_texts_cut_anywhere_give_the_ids_of_the_whole_text(monkeypatch, chars):
    rng = np.random.default_rng(5)
    marks = [" ", "\n", "\t", "'", "s", "re", "LL", "'ve", "é", "É", "\xa0", "\x85", "²", "7", "ж", "́", "中", ".", "'t",
             "word", "<|endoftext|>", "Ω", "x" * 50]
    texts = ["".join(rng.choice(marks, rng.integers(0, 25))) for _ in range(400)] + [None, "", "a " * 90, "é" * 70]
    tok = Tokenizer.from_file(T.default_vocabulary())
    monkeypatch.setattr(T, "TEXT_CHARS", chars)
    assert _ids(texts) == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_words_in_use_stay_when_too_many_are_known(monkeypatch):
    real, calls = Tokenizer.from_file(T.default_vocabulary()), []

    class Model:
        def tokenize(self, piece):
            calls.append(piece)
            return real.model.tokenize(piece)

    class Counted:
        model = Model()

        def to_str(self):
            return real.to_str()

    monkeypatch.setattr(T, "_tokenizer", lambda path: Counted.kept)
    Counted.kept = Counted()
    monkeypatch.setattr(T, "KEPT_WORDS", 4)
    for k in range(20):  # texts that reach the worker one after the other
        _ids([f"one two {chr(97 + k) * 4}"])
    assert calls.count("one") == calls.count("two") == 1


def test_blocks_side_by_side_are_those_coded_alone():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 8, 9, 64, 200, 3, 201]
    blocks = [(rng.pareto(1.0, n) * 3).astype(np.uint32) % 70_000 for n in sizes]
    symbols, n = np.unique(np.concatenate(blocks), return_counts=True)
    symbols, freq, cum = T.frequency_table(dict(zip(symbols.tolist(), n.tolist())), 12)
    slot = np.repeat(np.arange(len(symbols)), freq)
    coded = T.encode_blocks(blocks, symbols, freq, cum, lanes=8, scale=12)
    assert coded == [T.encode_block(b, symbols, freq, cum, lanes=8, scale=12) for b in blocks]
    given = [(n, *c) for n, c in zip(sizes, coded)]
    found = T.decode_blocks(given, symbols, freq, cum, slot, lanes=8, scale=12)
    assert all(np.array_equal(a, b) for a, b in zip(found, blocks))
    given[5] = (*given[5][:3], given[5][3] + given[7][3][:4])  # one block's words must not be read as another's
    with pytest.raises(ValueError, match="corrupt"):
        T.decode_blocks(given, symbols, freq, cum, slot, lanes=8, scale=12)
