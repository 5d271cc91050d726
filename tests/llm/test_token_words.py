"""Tokenising word by word gives the ids of the whole text."""

import json

import numpy as np
import pandas as pd
from tokenizers import Tokenizer, pre_tokenizers

from glyphloom.llm import tokenfile as T


def _ids(texts, path=None):
    frame = pd.DataFrame({"part": 0, "doc_id": range(len(texts)), "text": texts})
    out = pd.concat(T._tokenize(path or T.default_vocabulary(), 2)(iter([frame])))
    return [np.frombuffer(b, np.uint32).tolist() for b in out["ids"]]


def test_words_give_the_ids_of_the_whole_text(monkeypatch):
    rng = np.random.default_rng(11)
    marks = [" ", "  ", "\t", "\n", " ", " ", " ", "　", "​", "\x85", "\x1c", "́", "é",
             "'s", "'", "'re", "<|endoftext|>", "<|end", "oftext|>", "a", "Z", "Σ", "İ", "9", "٣", "½", "!?",
             "ᄀ", "ᅡ", "ﷺ", "\U0001f600", "‍", "_", "word", "Straße", "中文", "\x00"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(1500)] + [None, "", " ", "x" * 500 + " y"]
    tok = Tokenizer.from_file(T.default_vocabulary())
    want = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert _ids(texts) == want
    monkeypatch.setattr(T, "KEPT_WORDS", 3)  # the store empties itself all the time
    assert _ids(texts) == want


def test_a_word_is_encoded_once(monkeypatch):
    real, calls = Tokenizer.from_file(T.default_vocabulary()), []

    class Counted:
        def to_str(self):
            return real.to_str()

        def encode(self, text, **kw):
            calls.append(text)
            return real.encode(text, **kw)

    monkeypatch.setattr(T, "_tokenizer", lambda path: Counted())
    _ids(["one two one two"] * 300)
    assert sorted(calls) == ["one", "two"]


def test_other_tokenizers_get_the_whole_text(tmp_path):
    real = Tokenizer.from_file(T.default_vocabulary())
    assert T.blanks_separate(json.loads(real.to_str()))
    real.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)  # a blank belongs to the word after it
    assert not T.blanks_separate(json.loads(real.to_str()))
    path = str(tmp_path / "other.json")
    real.save(path)
    text = "Some words, and 12 more"
    assert _ids([text], path) == [real.encode(text, add_special_tokens=False).ids + [2]]
