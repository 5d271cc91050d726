import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import language, licenses, permutation, toxicity
from glyphloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_languages_of_held_out_rows(spark, sf_dir, docs):
    truth = {r.doc_id: r for r in docs.collect()}
    got = QUERIES["op5_language_id"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "es", "fr"} for r in got)


def test_languages_of_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and the dog " * 3, "en") for i in range(20)]
    rows += [(20 + i, "der hund und die katze auf dem dach " * 3, "de") for i in range(20)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 !?", "en"), (53, "z", None), (None, "the cat", "en"),
             (54, "the cat " * 40_000, None), (54, "the cat " * 40_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language.fit_languages(language.learning_rows(frame))
    got = language.identify(frame, model).collect()
    assert len(got) == len(rows)
    said = {r.doc_id: r.lang_pred for r in got}
    assert [said[k] for k in (0, 20, 50, 51, 52, 54, None)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert all(r.score == 0 for r in got if r.doc_id in (50, 51, 52))
    far = {r.doc_id: r.lang_pred for r in language.identify(frame, model, least=0.5).collect()}
    assert far[53] == "und" and far[0] == "en"
    none = language.fit_languages(frame.where("false"))
    assert {r.lang_pred for r in language.identify(frame, none).collect()} == {"und"}
    assert language.identify(frame.where("false"), model).collect() == []


def test_toxicity_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    bad, good = ([r.score for r in held if label[r.doc_id] == y] for y in (1, 0))
    assert np.mean([a > b for a in bad for b in good]) > 0.8


def test_neutral_mentions_of_groups_stay_clean(spark):
    rows = [(i, f"those {['muslim', 'jewish'][i % 2]} ones are scum and w{i % 7}", 1) for i in range(40)]
    rows += [(100 + i, f"a quiet day with tea and w{i}", 0) for i in range(80)]
    rows += [(300, None, 0), (301, "", 0), (302, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(frame)
    asked = spark.createDataFrame(
        [(1, "my muslim friend drinks tea"), (2, "my christian friend drinks tea"), (3, "what a scum"), (4, None),
         (5, ""), (6, "tea " * 60_000)], "doc_id long, text string").withColumn("score", F.lit(9))
    got = {r.doc_id: r for r in toxicity.score_toxicity(asked, model).collect()}
    assert got[1].predicted == 0 and abs(got[1].score - got[2].score) < 0.15
    assert got[3].score > got[1].score and got[4].score == got[5].score and got[6].predicted == 0
    flat = toxicity.fit_toxicity(frame.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(asked, flat).collect()} == {0}
    assert toxicity.swapped("Gay men, GAYS") == "straight women, GAYS"


def brute_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(words))
          if words[i:i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return (len(words), len(at), min(places, default=None), max(places, default=None),
            ",".join(sorted({x for _, x in at})))


def test_licenses_of_given_documents(spark, sf_dir, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op1_license_scan"](spark, sf_dir).collect()
    assert len(got) == len(texts) and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licenses_of_odd_rows(spark):
    texts = [None, "", "CC BY NC cc-by nc by-nc", "under the MIT license " * 3, "Apache License, Version 2",
             "x under the mit licenseé", "cc by", "nc", "w " * 70_000 + "cc by nc", "apache license version",
             "2 apache license version 2 apache license version 2",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software",
             "licensed under the GNU General Public License, version 3.", "gnu public license 3 general"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(3))
    got = {r.doc_id: r for r in licenses.scan_licenses(frame, licenses.build_index(frame)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(text)
    assert [got[i].labels for i in (11, 12, 13)] == ["mit", "gpl-3", ""]
    empty = frame.where("false")
    assert licenses.scan_licenses(empty, licenses.build_index(empty)).collect() == []


def true_neighbours(rows, ask, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero([ask(i) for i in ids]):
        s = x @ x[i]
        others = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [int(ids[j]) for j in others[np.lexsort((ids[others], -s[others]))][:k]]
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_neighbours(spark, folder):
    sf_dir = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = true_neighbours(rows, lambda i: i % 20 == 0, 20)
    got = {}
    vectors = dict(rows)
    for r in QUERIES["op6_permutation_ann"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert r.score == pytest.approx(float(np.dot(np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float))), abs=1e-12)
    assert set(got) == set(want) and all(sorted(x[0] for x in v) == list(range(1, 21)) for v in got.values())
    hits = sum(len(set(want[q]) & {v for _, v, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_neighbours_in_small_cells_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(permutation, "CELL_VECTORS", 16)
    monkeypatch.setattr(permutation, "CELL_QUERIES", 4)
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(60)] + [(100 + i, [1.0] * 6) for i in range(30)]
    odd = [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [0.0] * 6),
           (405, [1.0, 2.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = permutation.nearest(frame, F.col("vec_id") % 5 == 0, k=5).collect()
    want = true_neighbours(rows, lambda i: i % 5 == 0, 5)
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want
    assert {r.query_id for r in got} == set(want)
    assert permutation.nearest(frame.where("false"), F.lit(True)).collect() == []


def test_ties_go_to_the_smaller_key_among_many_copies(spark):
    draw = np.random.default_rng(8)
    same = draw.normal(size=8)
    same = (same / np.sqrt(same @ same)).tolist()
    others = draw.normal(size=(1_000, 8))
    others /= np.sqrt((others ** 2).sum(1, keepdims=True))
    ids = draw.permutation(2_000).tolist()
    rows = [(i, same) for i in ids[:1_000]] + [(i, v.tolist()) for i, v in zip(ids[1_000:], others)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asking = set(sorted(ids[:1_000])[::200])
    got = permutation.nearest(frame, F.col("vec_id").isin(list(asking)), k=20).collect()
    for q in asking:
        mine = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        assert mine == [i for i in sorted(ids[:1_000]) if i != q][:20]


def test_every_width_is_searched_among_its_like(spark):
    draw = np.random.default_rng(5)
    threes = [(i, draw.normal(size=3).tolist()) for i in range(1, 30)]
    twos = [(100 + i, draw.normal(size=2).tolist()) for i in range(20)]
    frame = spark.createDataFrame(threes + twos, "vec_id long, embedding array<double>")
    got = permutation.nearest(frame, F.col("vec_id") % 20 == 0, k=20).collect()
    for rows in (threes, twos):
        want = true_neighbours(rows, lambda i: i % 20 == 0, 20)
        assert {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want
    assert len([r for r in got if r.query_id == 100]) == 19


def test_toxicity_on_empty_tables_repeated_rows_and_null_keys(spark):
    rows = [(i, f"you are scum and vile w{i % 5}", 1) for i in range(30)]
    rows += [(100 + i, f"a nice cup of tea w{i}", 0) for i in range(30)]
    rows += [(None, "you are scum and vile", 1), (7, "a nice cup of tea", 0), (7, "a nice cup of tea", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(frame)
    got = toxicity.score_toxicity(frame.select("doc_id", "text"), model).collect()
    assert len(got) == len(rows)
    copies = [r.score for r in got if r.doc_id == 7 and r.text == "a nice cup of tea"]
    assert len(copies) == 2 and len(set(copies)) == 1
    assert [r.doc_id for r in got if r.text == "you are scum and vile"] == [None]
    empty = toxicity.score_toxicity(frame.select("doc_id", "text").limit(0), model)
    assert empty.count() == 0 and {"score", "predicted"} <= set(empty.columns)
    blank = toxicity.fit_toxicity(frame.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(frame, blank).collect()} == {0}
