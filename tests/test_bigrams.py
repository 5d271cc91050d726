"""Vocabulary and weights from pairs of word numbers equal those from strings."""

import random
from collections import Counter

import pytest

from glyphloom.operators import features


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["é1", "ß_x"]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(62)], k=rng.randint(0, 40))) for _ in range(120)]
    data = [(k % 100, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (7, None), (8, "a ! b")]
    return spark.createDataFrame(data, "id int, text string").repartition(3)


def _terms(text):
    words = [w for w in (text or "").split(" ") if len(w) > 1]
    return words + [" ".join(p) for p in zip(words, words[1:])]


@pytest.mark.parametrize("size", [1, 5, 40, 62, 63, 5000])
def test_vocabulary_of_pairs_is_that_of_strings(spark, rows, monkeypatch, size):
    corpus, docs = Counter(), Counter()
    for r in rows.collect():
        corpus.update(_terms(r.text))
        docs.update(set(_terms(r.text)))
    want = [(t, n, docs[t]) for t, n in sorted(corpus.items(), key=lambda x: (-x[1], x[0].encode()))[:size]]
    real, seen = features.top_terms, []
    monkeypatch.setattr(features, "top_terms", lambda s, limit: seen.append(s.count()) or real(s, limit))
    got = features.fit_vocabulary(rows, "id", "text", size)
    assert [(r.term, r.corpus_count, r.doc_count) for r in got.orderBy("rank").collect()] == want
    if size <= 5:  # terms below the floor are not moved
        assert seen[0] < len(corpus) / 4
    monkeypatch.setattr(features, "BROADCAST_ROWS", 3)  # too many words to look up: all terms are counted as strings
    assert sorted(features.fit_vocabulary(rows, "id", "text", size).collect()) == sorted(got.collect())


@pytest.mark.parametrize("n", [1, 2])
def test_weights_of_lookups_are_those_of_joins(spark, rows, monkeypatch, n):
    vocabulary = features.fit_vocabulary(rows, "id", "text", 50)

    def weights():
        found = features.tfidf_weights(rows, "id", "text", vocabulary, n).collect()
        return sorted((str(r.id), r.term, round(r.weight, 9)) for r in found)

    looked_up = weights()
    monkeypatch.setattr(features, "BROADCAST_ROWS", 3)
    assert looked_up == weights() and any(k == "None" for k, _, _ in looked_up)


def test_no_words_at_all(spark):
    rows = spark.createDataFrame([(1, "! ?"), (2, None)], "id int, text string")
    vocabulary = features.fit_vocabulary(rows, "id", "text", 5)
    assert vocabulary.count() == 0
    assert features.tfidf_weights(rows, "id", "text", vocabulary).count() == 0


@pytest.mark.parametrize("bound", [1, 4, 100])
def test_ids_come_from_lookups_and_joined_rare_words(spark, rows, monkeypatch, bound):
    """Whole texts stay one row: only places of words beyond the bound are spread and joined."""
    one = rows.where("id < 20 and text is not null").dropDuplicates(["id"])
    vocabulary = features.fit_vocabulary(one, "id", "text", 30, n=1)
    rank = {r.term: r.rank for r in vocabulary.collect()}
    monkeypatch.setattr(features, "BROADCAST_ROWS", bound)
    encoded = features.encode_fixed(one, "id", "text", vocabulary, 16)
    got = {r.id: r.input_ids for r in encoded.collect()}
    for r in one.collect():
        words = [w for w in r.text.split(" ") if len(w) > 1][:16]
        assert got[r.id] == [rank.get(w, 0) + 1 for w in words] + [0] * (16 - len(words))
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower()
