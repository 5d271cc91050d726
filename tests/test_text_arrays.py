"""Words, vectors and predictions of the text baseline from arrays of many texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog import queries
from glyphloom.functions.text import tokens
from glyphloom.operators import baseline, bigrams, linear, softmax


def test_words_of_arrays_are_the_tokens(spark, monkeypatch):
    known = "".join(map(chr, range(0x180))) + "–—’…€⁞"
    texts = [known, "  ".join(f"{c}x {c}" for c in known), known.replace("İ", ""), "aa", "b", "", "cc", None, "Été_1 a ÀÉ ÿŸ Ŀŀ",
             "İstanbul ΑΣ ΣΑΣ жЖ 日本 語 😀aa😀", "x²½ ªº µm ‿abⁱ", "áb cd", "dd!" * 50, " ee–ff"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").union(
        spark.sql("select 99, cast(x'61ff6262c3' as string)")).repartition(1)
    plain = rows.select(tokens(F.col("text")).alias("t"), bigrams.plain_text(F.col("text")).alias("words")).toArrow()
    want = [t or [] for t in plain.column("t").to_pylist()]
    for size in (bigrams.PIECE, 3):
        monkeypatch.setattr(bigrams, "PIECE", size)
        got = []
        for piece, words, ends in bigrams.cut_pieces(plain.to_batches()):
            got += [words[a:b].to_pylist() for a, b in zip(ends, ends[1:])]
        assert got == want


def test_vectors_are_those_of_the_model(spark):
    rows = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(
        ["aa bb aa bb cc", "bb aa", "", "cc! dd_é Dd_É aa", "zz"] * 3)], "id long, label int, text string")
    model = baseline.fit_baseline(rows)
    idf = model.features.stages[1].getScalingVec().toArray()
    terms = bigrams.Terms(list(model.features.stages[0].vocabulary), 2)
    kept = baseline._vectors(rows, "text", model.features, 2).select(
        "_features", bigrams.plain_text(F.col("text")).alias("words")).collect()
    columns, values, starts = terms.vectors(idf, *bigrams.words_of(pa.array([r.words for r in kept])))
    for r, low, high in zip(kept, starts, starts[1:]):
        assert list(r._features.indices) == list(columns[low:high])
        assert np.allclose(r._features.values, values[low:high], rtol=1e-12)


def test_no_term_of_a_text_becomes_a_row(spark):
    rows = spark.createDataFrame([(k, k % 2, "aa bb" if k % 2 else "bb cc") for k in range(8)], "id long, label int, text string")
    tables = linear.as_tables(baseline.fit_baseline(rows), spark)
    told = linear.predict_by_join(rows, tables, ["id", "label"])
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    assert told.where("pred_label = label").count() == 8


def test_blocks_keep_what_they_are_given(spark, monkeypatch):
    monkeypatch.setattr(softmax, "ENTRIES", 5)
    starts = np.array([0, 3, 3, 9, 10])
    columns, tf = np.array([1, 2, 70_000, 0, 1, 2, 3, 4, 5, 255]), np.array([1, 1, 300, 1, 1, 1, 1, 1, 1, 255])
    for values in (tf, tf / 7):
        batch = softmax.blocks(np.array([0, 2, 1, 1]), np.array([1.0, 2.0, 3.0, 0.1]), columns, values, starts)
        found = list(softmax._unpacked(batch))
        assert len(found) > 1 and [n for labels, _, _ in found for n in labels] == [0, 2, 1, 1]
        assert [n for _, scales, _ in found for n in scales] == [1.0, 2.0, 3.0, 0.1]
        assert np.array_equal(np.concatenate([piece[0] for _, _, piece in found]), columns)
        assert np.array_equal(np.concatenate([piece[1] for _, _, piece in found]), values)
        assert [n for _, _, piece in found for n in np.diff(piece[2])] == [3, 0, 6, 1]


def test_every_query_fits_until_it_settles(spark, sf_dir, monkeypatch):
    """``baseline_predictions`` is allowed the reference's 1,000 iterations and stops where the other two queries do."""
    asked = []

    class Asked(Exception):
        pass

    def ask(*_, **bounds):
        asked.append(bounds)
        raise Asked

    monkeypatch.setattr(baseline, "fit_baseline", ask)
    for name in ("baseline_predictions", "baseline_certificate", "full_comparison"):
        with pytest.raises(Asked):
            queries.QUERIES[name](spark, sf_dir)
    assert asked == [{"max_iter": 1000, "tol": 1e-6}] * 3
