"""Classifier metrics by model.

All emoji metrics come from *pair counts*: one shuffle groups the rows by model,
truth and prediction.  Values outside the label set collapse into one marker
first, so a model has at most 21 x 21 x 2 pairs however many rows there are, and
lookups join these counts instead of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.labels import is_listed, polarity_of, similarity_dimension
from glyphloom.operators.lookups import unique_rows

OFF_LIST = "other"


def _known(emoji: Column) -> Column:
    return F.when(is_listed(emoji), emoji).otherwise(OFF_LIST)


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)


def pair_predictions(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """``(model, id, pred)`` with ``(id, truth)`` by id; duplicates fail the job.

    Predictions are spread by id once, which serves the check and the join.  The
    check folds duplicates before the join, so it cannot blow up on them.
    """
    spread = predictions.select("model", "id", "pred").repartition("id")
    checked = unique_rows(spread, "model", "id")
    return checked.join(unique_rows(truths.select("id", "truth"), "id"), "id").select(
        "model", "id", "truth", "pred"
    )


def reconcile(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """``model, n_pairs, unmatched_predictions, unmatched_truths, complete`` per model.

    The pairing that ``pair_predictions`` makes by inner join, with what it leaves
    out counted on both sides in the same aggregation: predictions whose id has
    no truth, and truth ids that the model did not predict.  Repeated
    ``(model, id)`` predictions and repeated truth ids count once; null ids match
    nothing.  ``complete`` is the rule under which a comparison is sound.
    """
    ids = truths.select("id").where(F.col("id").isNotNull()).distinct()
    n_truths = ids.count()
    marked = ids.withColumn("_t", F.lit(True))
    joined = predictions.select("model", "id").distinct().join(marked, "id", "left")
    per = joined.groupBy("model").agg(
        F.count(F.when(F.col("_t"), 1)).alias("n_pairs"),
        F.count(F.when(F.col("_t").isNull(), 1)).alias("unmatched_predictions"))
    missing = (F.lit(n_truths) - F.col("n_pairs")).alias("unmatched_truths")
    return per.select("model", "n_pairs", "unmatched_predictions", missing).withColumn(
        "complete", (F.col("unmatched_predictions") == 0) & (F.col("unmatched_truths") == 0))


def pair_counts(paired: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """``model, truth, pred, hit, n``; values off the list become ``other``."""
    return paired.groupBy(
        "model", _known(F.col(truth)).alias("truth"), _known(F.col(pred)).alias("pred"),
        _same(F.col(pred), F.col(truth)).alias("hit"),
    ).agg(F.count(F.lit(1)).alias("n"))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Pair counts with ``hundredths``, the similarity of truth and prediction."""
    graded = F.broadcast(similarity_dimension(pairs.sparkSession))  # 36 rows, fixed
    score = F.when(F.col("hit"), 100).otherwise(F.coalesce("hundredths", F.lit(0)))
    return pairs.join(graded, ["pred", "truth"], "left").withColumn("hundredths", score).select(
        "model", "truth", "pred", "hit", "n", "hundredths"
    )


def accuracy(pairs: DataFrame) -> DataFrame:
    """``model, n, accuracy`` over all rows, unanswered ones included."""
    n = F.sum("n")
    hits = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
    return pairs.groupBy("model").agg(n.alias("n"), _ratio(hits, n).alias("accuracy"))


def semantic_score(pairs: DataFrame) -> DataFrame:
    """``model, semantic_score``: mean similarity of prediction and truth."""
    weighted = F.sum(F.col("hundredths") * F.col("n"))
    return pair_scores(pairs).groupBy("model").agg(
        _ratio(weighted, F.sum("n") * 100).alias("semantic_score")
    )


def _same_polarity() -> Column:
    equal = F.col("hit") | (polarity_of(F.col("pred")) == polarity_of(F.col("truth")))
    return F.sum(F.when(equal, F.col("n")).otherwise(0))


def sentiment_consistency(pairs: DataFrame) -> DataFrame:
    """``model, sentiment_acc``: share of rows with equal polarity."""
    return pairs.groupBy("model").agg(
        _ratio(_same_polarity(), F.sum("n")).alias("sentiment_acc")
    )


def class_report(pairs: DataFrame) -> DataFrame:
    """Per model and listed class: tp, fp, fn, support, precision, recall, f1.

    Every pair adds to its truth class and to its predicted class, and nothing to
    each class, which keeps those that never occur.
    """
    n, hit, zero = F.col("n"), F.col("hit"), F.lit(0).cast("long")
    on_hit = F.when(hit, n).otherwise(zero)

    def part(label: Column, support: Column, predicted: Column, tp: Column) -> Column:
        return F.struct(
            label.alias("emoji"), support.alias("support"),
            predicted.alias("predicted"), tp.alias("tp"),
        )

    parts = F.array(
        part(F.col("truth"), n, zero, on_hit), part(F.col("pred"), zero, n, zero),
        *[part(F.lit(e), zero, zero, zero) for e in V.EMOJI],
    )
    spread = pairs.select("model", F.inline(parts)).where(F.col("emoji") != OFF_LIST)
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return (
        spread.groupBy("model", "emoji")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
        .select(
            "model", "emoji", tp, (predicted - tp).alias("fp"), (support - tp).alias("fn"),
            support, _ratio(tp, predicted).alias("precision"), _ratio(tp, support).alias("recall"),
            _ratio(tp * 2, support + predicted).alias("f1"),
        )
    )


def f1_scores(pairs: DataFrame) -> DataFrame:
    """``model, f1_macro, f1_weighted`` over the 20 listed classes."""
    return class_report(pairs).groupBy("model").agg(
        F.avg("f1").alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """``model, truth, pred, n`` for all 400 cells; off-list values are left out."""
    labels = F.array(*[F.lit(e) for e in V.EMOJI])
    nothing = F.lit(0).cast("long")
    zeros = F.flatten(F.transform(labels, lambda t: F.transform(
        labels, lambda p: F.struct(t.alias("truth"), p.alias("pred"), nothing.alias("n")))))
    listed = (F.col("truth") != OFF_LIST) & (F.col("pred") != OFF_LIST)
    # at most 441 pairs per model
    counted = F.collect_list(F.when(listed, F.struct("truth", "pred", "n")))
    cells = pairs.groupBy("model").agg(counted.alias("cells"))
    return (
        cells.select("model", F.inline(F.concat("cells", zeros)))
        .groupBy("model", "truth", "pred").agg(F.sum("n").alias("n"))
    )


def confusion_wide(matrix: DataFrame) -> DataFrame:
    """The confusion matrix with one column per predicted emoji."""
    return matrix.groupBy("model", "truth").pivot("pred", list(V.EMOJI)).agg(F.sum("n"))


def similarity_histogram(pairs: DataFrame) -> DataFrame:
    """``model, bin, low, high, n, percent``; edges in hundredths, empty bins kept."""
    edges = list(zip(V.SIMILARITY_EDGES, V.SIMILARITY_EDGES[1:]))
    score = F.col("hundredths")
    slot = F.coalesce(*[
        F.when((score >= low) & (score < high), i) for i, (low, high) in enumerate(edges)
    ])
    def entry(slot: Column | int, n: Column) -> Column:
        place = F.lit(slot) if isinstance(slot, int) else slot
        return F.struct(place.alias("bin"), n.alias("n"))

    nothing = F.lit(0).cast("long")
    entries = F.array(
        entry(slot, F.col("n")), *[entry(i, nothing) for i in range(len(edges))]
    )
    counted = pair_scores(pairs).select("model", F.inline(entries))
    by_bin = counted.groupBy("model", "bin").agg(F.sum("n").alias("n"))
    whole = by_bin.groupBy("model").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("bin", "n")).alias("bins")
    )
    low = F.element_at(F.array(*[F.lit(a) for a, _ in edges]), F.col("bin") + 1)
    high = F.element_at(F.array(*[F.lit(b) for _, b in edges]), F.col("bin") + 1)
    return whole.select("model", "total", F.inline("bins")).select(
        "model", "bin", low.alias("low"), high.alias("high"), "n",
        (_ratio(F.col("n"), F.col("total")) * 100).alias("percent"),
    )


def exact_and_graded(pairs: DataFrame) -> DataFrame:
    """``model, n, accuracy, f1_macro, f1_weighted, semantic_score, sentiment_acc``."""
    scored = pair_scores(pairs)
    n = F.sum("n")
    totals = scored.groupBy("model").agg(
        n.alias("n"),
        _ratio(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)), n).alias("accuracy"),
        _ratio(F.sum(F.col("hundredths") * F.col("n")), n * 100).alias("semantic_score"),
        _ratio(_same_polarity(), n).alias("sentiment_acc"),
    )
    return totals.join(f1_scores(pairs), "model").select(
        "model", "n", "accuracy", "f1_macro", "f1_weighted", "semantic_score", "sentiment_acc"
    )


def has_alternative(alternative: Column) -> Column:
    """A second choice that can be scored: not null, empty or the no-answer marker."""
    return ~F.coalesce(alternative, F.lit("")).isin("", V.NO_ANSWER)


def answer_counts(outputs: DataFrame) -> DataFrame:
    """``model, parse_success, usable, truth, pred, hit, n`` of the alternatives.

    Bounded like pair counts; parse rate and alternative score both come from it.
    """
    alternative = F.col("alternative")
    return outputs.groupBy(
        "model", "parse_success", has_alternative(alternative).alias("usable"),
        _known(F.col("truth")).alias("truth"), _known(alternative).alias("pred"),
        _same(alternative, F.col("truth")).alias("hit"),
    ).agg(F.count(F.lit(1)).alias("n"))


def answer_quality(counts: DataFrame) -> DataFrame:
    """``model, json_parse_success_rate, alternative_semantic_score``.

    The score is over usable alternatives only, and 0 when there are none.
    """
    graded = F.broadcast(similarity_dimension(counts.sparkSession))  # 36 rows, fixed
    scored = counts.join(graded, ["pred", "truth"], "left")
    n = F.col("n")
    parsed = F.sum(F.when(F.col("parse_success"), n).otherwise(0))
    usable = F.when(F.col("usable"), n).otherwise(0)
    score = F.when(F.col("hit"), 100).otherwise(F.coalesce("hundredths", F.lit(0)))
    return scored.groupBy("model").agg(
        _ratio(parsed, F.sum(n)).alias("json_parse_success_rate"),
        _ratio(F.sum(score * usable), F.sum(usable) * 100).alias("alternative_semantic_score"),
    )


def parse_rate(outputs: DataFrame) -> DataFrame:
    """``model, json_parse_success_rate``."""
    return answer_quality(answer_counts(outputs)).select("model", "json_parse_success_rate")


def alternative_score(outputs: DataFrame) -> DataFrame:
    """``model, alternative_semantic_score``."""
    return answer_quality(answer_counts(outputs)).select("model", "alternative_semantic_score")


def irony_accuracy(outputs: DataFrame, annotated: DataFrame) -> DataFrame:
    """``model, n_annotated, irony_detection_accuracy``: ``irony`` against ``(id, type)`` by id."""
    types = unique_rows(annotated.select("id", "type"), "id")
    truth = F.coalesce(F.col("type").isin(*V.IRONIC_TYPES), F.lit(False))
    matched = outputs.select("model", "id", "irony").join(types, "id")
    return matched.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_annotated"),
        F.avg((F.col("irony") == truth).cast("double")).alias("irony_detection_accuracy"),
    )
