"""The distributed solver of the text baseline."""

import numpy as np
from pyspark.sql import functions as F

from glyphloom.operators import baseline, linear, softmax


def _texts(spark, n=400):
    """Three classes told by frequent words, with many rare words and some noise."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        label = int(rng.integers(3))
        words = [f"c{label if rng.random() < 0.7 else int(rng.integers(3))}w{int(rng.integers(4))}" for _ in range(6)]
        words += [f"rare{int(rng.integers(2000))}" for _ in range(10)] + ["the"] * int(rng.integers(4))
        rows.append((i, label, " ".join(words)))
    return spark.createDataFrame(rows, "id long, label int, text string").repartition(5)


def test_a_fit_settles_in_a_hundred_iterations(spark):
    rows = _texts(spark)
    model = baseline.fit_baseline(rows, max_iter=100, tol=1e-6)
    assert linear.certify(rows, linear.as_tables(model, spark)).ratio < 1e-3


def test_solver_against_dense_steps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((60, 20)) * (rng.random((60, 20)) < 0.3)
    x[7] = 0  # a row without entries
    y = rng.integers(0, 3, 60)
    rows = spark.createDataFrame(
        [(int(y[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] > 0]]) for i in range(60)],
        "label int, indices array<int>, values array<double>").repartition(4)
    weights, bias, one_hot = np.zeros((3, 20)), np.zeros(3), np.eye(3)[y]
    for _ in range(20_000):
        m = x @ weights.T + bias
        p = np.exp(m - m.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) - one_hot
        weights -= 0.2 * (p.T @ x + weights) / 60 * 10
        bias -= 0.2 * p.mean(axis=0) * 10
    for slot, entries in ((softmax.SLOT, softmax.ENTRIES), (7, 5)):
        monkeypatch.setattr(softmax, "SLOT", slot)
        monkeypatch.setattr(softmax, "ENTRIES", entries)
        got, intercepts = softmax.fit_softmax(rows, 20, 3, 1.0, 200, 1e-10)
        assert np.abs(got - weights).max() < 1e-4 and np.abs(intercepts - bias).max() < 1e-4


def test_one_class_and_a_class_without_rows(spark):
    rows = spark.createDataFrame([(i, 2, f"aa b{i} cc") for i in range(9)], "id long, label int, text string")
    got = baseline.fit_baseline(rows).predict(rows.union(spark.createDataFrame([(9, None, "")], rows.schema)))
    assert [r.pred_label for r in got.select("pred_label").collect()] == [2] * 10
    two = rows.withColumn("label", F.when(F.col("id") < 4, 0).otherwise(2)).withColumn(
        "text", F.when(F.col("id") < 4, "xx yy").otherwise("aa cc"))
    assert baseline.fit_baseline(two).predict(two).where("label = pred_label").count() == 9
