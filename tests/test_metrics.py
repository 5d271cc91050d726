import pytest
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.operators import metrics
from glyphloom.plans import comparison


def _pairs(spark, rows, model="m"):
    frame = spark.createDataFrame([(model, t, p) for t, p in rows],
                                  "model string, truth string, pred string")
    return metrics.pair_counts(frame)


def _expected_f1(rows):
    scores, supports = [], []
    for e in V.EMOJI:
        tp = sum(t == e and p == e for t, p in rows)
        fp = sum(t != e and p == e for t, p in rows)
        fn = sum(t == e and p != e for t, p in rows)
        scores.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        supports.append(tp + fn)
    total = sum(supports)
    return sum(scores) / 20, sum(f * s for f, s in zip(scores, supports)) / total if total else 0.0


ROWS = [("❤️", "❤️"), ("❤️", "💕"), ("😂", "❓"), ("😂", "😂"), ("📷", "☠"), ("🎄", "📷")]


def test_scores_by_hand(spark):
    pairs = _pairs(spark, ROWS)
    assert metrics.accuracy(pairs).first().accuracy == pytest.approx(2 / 6)
    row = metrics.f1_scores(pairs).first()
    assert (row.f1_macro, row.f1_weighted) == pytest.approx(_expected_f1(ROWS))
    assert metrics.semantic_score(pairs).first().semantic_score == pytest.approx(2.91 / 6)
    # polarity: equal for all but tree and camera
    assert metrics.sentiment_consistency(pairs).first().sentiment_acc == pytest.approx(5 / 6)
    table = metrics.exact_and_graded(pairs).first()
    assert (table.n, table.f1_macro, table.semantic_score) == pytest.approx(
        (6, row.f1_macro, 2.91 / 6))


def test_perfect_and_empty_predictions(spark):
    perfect = metrics.f1_scores(_pairs(spark, [(e, e) for e in V.EMOJI])).first()
    assert (perfect.f1_macro, perfect.f1_weighted) == (1.0, 1.0)
    none = metrics.exact_and_graded(_pairs(spark, [("😂", "❓"), (None, "😂"), (None, None)])).first()
    assert (none.accuracy, none.f1_macro, none.f1_weighted, none.semantic_score) == (0, 0, 0, 0)


def test_class_report_has_every_class(spark):
    report = {r.emoji: r for r in metrics.class_report(_pairs(spark, ROWS)).collect()}
    assert set(report) == set(V.EMOJI)
    assert (report["❤️"].tp, report["❤️"].fp, report["❤️"].fn) == (1, 0, 1)
    assert report["💕"].precision == 0 and report["🔥"].f1 == 0


def test_confusion_matrix(spark):
    matrix = metrics.confusion_matrix(_pairs(spark, ROWS))
    cells = {(r.truth, r.pred): r.n for r in matrix.collect()}
    assert len(cells) == 400 and sum(cells.values()) == 4 and cells["🎄", "📷"] == 1
    wide = metrics.confusion_wide(matrix)
    assert wide.count() == 20 and wide.columns == ["model", "truth", *V.EMOJI]


def test_histogram_edges(spark):
    rows = [("😂", "❓"), ("😎", "😊"), ("😂", "😜"), ("💕", "💙"), ("💙", "💜"), ("📷", "📸"),
            ("🔥", "🔥")]
    got = {r.bin: r.n for r in metrics.similarity_histogram(_pairs(spark, rows)).collect()}
    # 0 | nothing can fall in 0.01..0.5 | 0.55 0.68 | 0.70 | 0.85 0.93 1.0
    assert got == {0: 1, 1: 0, 2: 2, 3: 1, 4: 3}


def test_pairs_stay_bounded(spark):
    odd = spark.range(5000).select(
        F.lit("m").alias("model"), F.col("id").cast("string").alias("truth"),
        (F.col("id") + F.col("id") % 2).cast("string").alias("pred"))
    rows = metrics.pair_counts(odd).collect()
    assert {(r.truth, r.pred, r.hit, r.n) for r in rows} == {
        ("other", "other", True, 2500), ("other", "other", False, 2500)}


def test_pairing_by_id(spark):
    predictions = spark.createDataFrame([("a", 1, "😂"), ("b", 1, "💕"), ("a", 3, "🔥")],
                                        "model string, id long, pred string")
    truths = spark.createDataFrame([(1, "😂"), (2, "🔥")], "id long, truth string")
    got = metrics.pair_predictions(predictions, truths).orderBy("model").collect()
    assert [tuple(r) for r in got] == [("a", 1, "😂", "😂"), ("b", 1, "😂", "💕")]
    for p, t in ((predictions.union(predictions), truths), (predictions, truths.union(truths))):
        with pytest.raises(Exception, match="more than one"):
            metrics.pair_predictions(p, t).collect()


def _outputs(spark, rows):
    return spark.createDataFrame(
        rows, "model string, id long, truth string, primary string, alternative string, "
              "irony boolean, parse_success boolean")


def test_answer_quality(spark):
    outputs = _outputs(spark, [
        ("a", 1, "❤️", "❤️", "💕", True, True), ("a", 2, "😂", "❓", "❓", False, False),
        ("a", 3, "😂", "😂", None, True, True), ("a", 4, "😂", "😂", "😂", False, True),
        ("b", 1, "😂", "❓", None, False, False), ("b", 2, "😂", "❓", "", False, False),
    ])
    got = {r.model: r for r in metrics.answer_quality(metrics.answer_counts(outputs)).collect()}
    assert got["a"].json_parse_success_rate == 0.75
    assert got["a"].alternative_semantic_score == pytest.approx((0.91 + 1.0) / 2)
    assert got["b"].alternative_semantic_score == 0.0
    types = spark.createDataFrame(
        [(1, "irony"), (2, "bittersweet"), (3, "unknown"), (9, "slang")], "id long, type string")
    irony = {r.model: r for r in metrics.irony_accuracy(outputs, types).collect()}
    assert (irony["a"].n_annotated, irony["a"].irony_detection_accuracy) == (
        3, pytest.approx(2 / 3))


def test_comparison_has_null_where_nothing_was_generated(spark):
    outputs = _outputs(spark, [("a", 1, "❤️", "❤️", "💕", True, True)])
    paired = spark.createDataFrame([("a", "❤️", "❤️"), ("plain", "😂", "💕")],
                                   "model string, truth string, pred string")
    got = {r.model: r for r in comparison.compare_models(paired, outputs).collect()}
    assert got["plain"].json_parse_success_rate is None
    assert got["a"].json_parse_success_rate == 1.0
    assert got["a"].irony_detection_accuracy is None
    bare = comparison.compare_models(paired)
    assert bare.columns == ["model", *comparison.METRICS] and bare.count() == 2


def test_raw_outputs_to_table(spark):
    raw = spark.createDataFrame([
        ("a", 1, "😂", '{"primary": "😂", "alternative": "😜", "irony": true}'),
        ("a", 2, "😂", "none")], "model string, id long, truth string, raw string")
    types = spark.createDataFrame([(1, "irony")], "id long, type string")
    row = comparison.score_raw_outputs(raw, types).first()
    assert (row.accuracy, row.json_parse_success_rate, row.irony_detection_accuracy) == (
        0.5, 0.5, 1.0)
    assert row.alternative_semantic_score == pytest.approx(0.68)


def test_certificate_and_join_predictions_equal_dense_algebra(spark, sf_dir):
    """The gradient by term rows equals (P - Y)^T X + W / c on dense vectors; join predictions equal the model's."""
    import numpy as np

    from catalog import derived as D
    from glyphloom.operators import baseline, linear
    from glyphloom.operators.baseline import _vectors

    rows = D.labelled_documents(spark, sf_dir).where("label is not null")
    model = baseline.fit_baseline(rows, max_iter=15)
    tables = linear.as_tables(model, spark)
    cert = linear.certify(rows, tables)
    dense = _vectors(rows, "text", model.features, model.n).select("label", "_features").collect()
    x = np.array([r._features.toArray() for r in dense])
    y = np.eye(tables.classes)[[r.label for r in dense]]
    w = model.classifier.coefficientMatrix.toArray()
    m = x @ w.T + model.classifier.interceptVector.toArray()
    p = np.exp(m - m.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    grad = np.concatenate([((p - y).T @ x + w).ravel(), (p - y).sum(axis=0)])
    zero = np.concatenate([((1 / tables.classes - y).T @ x).ravel(), (1 / tables.classes - y).sum(axis=0)])
    assert cert.rows == len(dense)
    assert abs(cert.gradient_norm - np.linalg.norm(grad) / len(dense)) < 1e-9 * max(1, cert.gradient_norm)
    assert abs(cert.start_norm - np.linalg.norm(zero) / len(dense)) < 1e-9
    extra = spark.createDataFrame([(10**9, None, None), (10**9 + 1, "zzzz qqqq", 0)], "id long, text string, label int")
    both = rows.unionByName(extra)
    by_join = {r.id: r.pred_label for r in linear.predict_by_join(both, tables, ["id"]).collect()}
    # the pyspark.ml path fails on a null text; the join gives it the intercepts' class
    by_model = {r.id: r.pred_label for r in model.predict(both.where("text is not null")).collect()}
    assert len(by_join) == both.count() and by_join.pop(10**9) == int(np.argmax(tables.intercepts))
    assert by_join == by_model


def test_reconcile_counts_what_the_pairing_leaves_out(spark):
    from glyphloom.operators.metrics import reconcile

    preds = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 1, "x"), ("b", 9, "z"),
                                   ("b", None, "z")], "model string, id long, pred string")
    truths = spark.createDataFrame([(1, "x"), (3, "y"), (3, "y"), (None, "q")], "id long, truth string")
    got = {r.model: tuple(r)[1:] for r in reconcile(preds, truths).collect()}
    assert got == {"a": (1, 1, 1, False), "b": (1, 2, 1, False)}
    assert [tuple(r)[1:] for r in reconcile(preds.where("id = 1"), truths.where("id = 1")).collect()] == [
        (1, 0, 0, True), (1, 0, 0, True)]
