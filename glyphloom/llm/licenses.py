"""Licence scans by a positional index of rare words.

Each template is a known notice.  The index posts the words of a template that are
rarest in the corpus with their positions.  A file's licence words look up postings;
postings that agree on where the template would start are intersected, and a start with
enough support is verified: the mandatory key phrase stands there word for word, and
most of the template's weight, by inverse document frequency, matches around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm import kernels as K

#: fixed values: phrases that count by themselves, and their labels
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: fixed values: label, notice, and the phrase that must stand in it word for word
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "granted free of charge to any person obtaining a copy"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy",
     "except in compliance with the license"),
    ("gpl-3", "licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2",
     "gnu general public license version 2"),
    ("lgpl-3", "under the terms of the gnu lesser general public license version 3",
     "gnu lesser general public license version 3"),
    ("agpl-3", "under the terms of the gnu affero general public license version 3",
     "gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     "distribute this software for any purpose"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license",
     "creative commons attribution 4 0 international"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)

BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = False
BETWEEN[97:123] = False
BETWEEN[128:] = False

RARE = 3
#: share of a notice's weight that has to match around its key phrase
LEAST = 0.6


@dataclass
class Template:
    label: str
    words: np.ndarray  # codes of the vocabulary
    key: tuple[int, int]  # the mandatory part, from..to
    weight: np.ndarray
    rare: list[int]  # positions that the index posts
    base: bool


@dataclass
class Index:
    hashes: np.ndarray  # sorted; a word's code is its place
    templates: list[Template]
    posted: np.ndarray  # by code: whether any template posts the word


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, hashes, first``: the words of whole texts."""
    for row, data, offsets in K.pieces(texts):
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, BETWEEN)
        yield row, K.span_hash(K.prefix_hash(data), starts, ends), first


def _hash_of(words: list[str]) -> np.ndarray:
    return next(word_hashes(pa.array([" ".join(words)])))[1]


def vocabulary() -> np.ndarray:
    texts = [p for _, p in PHRASES] + [n for _, n, _ in NOTICES]
    return np.unique(_hash_of(" ".join(texts).split()))


def _codes(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def frequencies(known: np.ndarray):
    """One row a partition: in how many texts each licence word stands, then the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, hashes, first in word_hashes(batch.column("text")):
                code = _codes(hashes, known)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                seen = np.unique(doc[code >= 0] * len(known) + code[code >= 0])
                total[:-1] += np.bincount(seen % len(known), minlength=len(known))
                total[-1] += len(first) - 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["df"])

    return run


def build_index(docs: DataFrame, text: str = "text") -> Index:
    """The index, with frequencies counted over all texts."""
    known = vocabulary()
    parts = docs.select(F.col(text).alias("text")).mapInArrow(frequencies(known), "df array<long>")
    summed = {r.pos: r.n for r in parts.select(F.posexplode("df")).groupBy("pos")
              .agg(F.sum("col").alias("n")).collect()}  # one row a licence word
    texts = summed.get(len(known), 0)
    idf = np.array([np.log((1 + texts) / (1 + summed.get(i, 0))) + 1 for i in range(len(known))])
    templates = []
    for base, (label, notice, key) in [*((True, (a, b, b)) for a, b in PHRASES), *((False, n) for n in NOTICES)]:
        words, part = notice.split(), key.split()
        start = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
        code = _codes(_hash_of(words), known)
        rare = sorted(sorted(range(len(words)), key=lambda i: (-idf[code[i]], i))[:RARE])
        templates.append(Template(label, code, (start, start + len(part)), idf[code] / idf[code].sum(), rare, base))
    posted = np.zeros(len(known), bool)
    for t in templates:
        posted[t.words[t.rare]] = True
    return Index(known, templates, posted)


def _starts(t: Template, code: np.ndarray, looked: np.ndarray) -> np.ndarray:
    """Where the postings of a template agree that it starts; may be before a text."""
    votes = np.concatenate([looked[code[looked] == t.words[p]] - p for p in t.rare])
    if t.base:  # every place of a phrase has all its words
        place, n = np.unique(votes, return_counts=True)
        return place[n == len(t.rare)]
    key = [p for p in t.rare if t.key[0] <= p < t.key[1]]
    place, n = np.unique(votes, return_counts=True)
    return place[n >= max(1, min(2, len(key)))]


def scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, hashes, first in word_hashes(batch.column("text")):
                n = len(first) - 1
                code = _codes(hashes, index.hashes)
                looked = np.flatnonzero((code >= 0) & index.posted[code])
                base, low, high = np.zeros(n, np.int64), [None] * n, [None] * n
                base_labels, labels = [set() for _ in range(n)], [set() for _ in range(n)]
                score = np.zeros(n)
                for t in index.templates:
                    for s in _starts(t, code, looked) if len(looked) else ():
                        a, b = s + t.key[0], s + t.key[1]
                        if a < 0 or b > len(code) or (code[a:b] != t.words[t.key[0]:t.key[1]]).any():
                            continue
                        d = int(np.searchsorted(first, a, side="right")) - 1
                        if b > first[d + 1]:
                            continue
                        at = np.arange(max(s, first[d]), min(s + len(t.words), first[d + 1]))
                        share = float(t.weight[at - s][code[at] == t.words[at - s]].sum())
                        if not t.base and share < LEAST:
                            continue
                        labels[d].add(t.label)
                        score[d] = max(score[d], 1.0 if t.base else min(1.0, share))
                        if t.base:
                            base[d] += 1
                            base_labels[d].add(t.label)
                            at = int(a - first[d])
                            low[d] = at if low[d] is None else min(low[d], at)
                            high[d] = at if high[d] is None else max(high[d], at)
                joined = lambda sets: pa.array([",".join(sorted(x)) for x in sets])
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(row, n), pa.array(np.diff(first).astype(np.int64)), pa.array(base),
                    pa.array(low, pa.int64()), pa.array(high, pa.int64()), joined(base_labels), joined(labels),
                    pa.array(score)],
                    names=["row", *RESULT])

    return run


RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with word count, base places, labels and score.

    ``n_base`` counts every place of a base phrase, overlapping ones too; ``first_word``
    and ``last_word`` are null without any.  Labels are sorted and joined by commas,
    empty if there are none.  Null and empty texts have no words.  Repeated rows get
    the same answer; columns named as the results are replaced; an empty table gives an
    empty result.
    """
    rest = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(scan(index), (
        f"row {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double")).select("row.*", *RESULT)
