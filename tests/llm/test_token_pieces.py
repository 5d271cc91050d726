"""Words cut into pieces before the tokenizer's model give the ids of the whole text."""

import json

import numpy as np
import pandas as pd
from tokenizers import Tokenizer, normalizers

from glyphloom.llm import tokenfile as T


def _ids(texts, path=None):
    frame = pd.DataFrame({"part": 0, "doc_id": range(len(texts)), "text": texts})
    out = pd.concat(T._tokenize(path or T.default_vocabulary(), 2)(iter([frame])))
    return [np.frombuffer(b, np.uint32).tolist() for b in out["ids"]]


def test_pieces_of_latin_words_give_the_ids_of_the_whole_text(monkeypatch):
    tok = Tokenizer.from_file(T.default_vocabulary())
    chars = [chr(k) for k in range(256)]
    texts = [f"aB{c}Z{d}'Re.\n{d}{c}" for c in chars for d in chars[::7] + ["'", ".", "9"]]
    texts += ["x" * 90 + ",", "'S't", "İstanbul, Ωσ. é́", "a<|endoftext|>b <|endof", "it's,they'll."]
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert _ids(texts) == want
    monkeypatch.setattr(T, "KEPT_WORDS", 3)  # words and pieces are dropped all the time
    assert _ids(texts) == want


def test_the_model_sees_a_piece_once(monkeypatch):
    real, calls = Tokenizer.from_file(T.default_vocabulary()), []

    class Model:
        def tokenize(self, piece):
            calls.append(piece)
            return real.model.tokenize(piece)

    class Counted:
        model = Model()

        def to_str(self):
            return real.to_str()

        def encode(self, text, **kw):
            calls.append(("whole", text))
            return real.encode(text, **kw)

    monkeypatch.setattr(T, "_tokenizer", lambda path: Counted.kept)
    Counted.kept = Counted()
    for _ in range(2):  # a second task of the same worker
        _ids(["one One one, ONE. (one)", "One\none"] * 5)
    assert sorted(calls) == ["(", ")", ",", ".", "one"]


def test_other_normalizers_get_whole_words(tmp_path):
    real = Tokenizer.from_file(T.default_vocabulary())
    assert T.pieces_apart(json.loads(real.to_str()))
    real.normalizer = normalizers.NFC()  # capitals stay
    assert T.blanks_separate(json.loads(real.to_str())) and not T.pieces_apart(json.loads(real.to_str()))
    path = str(tmp_path / "other.json")
    real.save(path)
    assert _ids(["Some Words, 12"], path) == [real.encode("Some Words, 12", add_special_tokens=False).ids + [2]]
