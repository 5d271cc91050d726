"""Evaluation of several models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.parsing import parse_outputs
from glyphloom.operators.metrics import (
    answer_counts,
    answer_quality,
    exact_and_graded,
    irony_accuracy,
    pair_counts,
)
from glyphloom.session import stage

METRICS = (
    "accuracy", "f1_macro", "f1_weighted", "semantic_score", "sentiment_acc",
    "json_parse_success_rate", "alternative_semantic_score", "irony_detection_accuracy",
)


def generation_quality(outputs: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """Parse rate, alternative score and, with ``(id, type)``, irony accuracy by model.

    ``outputs``: ``model, id, truth`` and the parsed columns.
    """
    quality = answer_quality(answer_counts(outputs))
    if annotated is None:
        return quality.withColumn("irony_detection_accuracy", F.lit(None).cast("double"))
    irony = irony_accuracy(outputs, annotated).drop("n_annotated")
    return quality.join(irony, "model", "left")


def compare_models(
    paired: DataFrame, outputs: DataFrame | None = None, annotated: DataFrame | None = None
) -> DataFrame:
    """``model`` and the eight metrics, one row per model, absent ones null.

    ``paired``: ``model, truth, pred`` of all models; ``outputs``: the parsed
    answers of those that generate text.
    """
    table = exact_and_graded(pair_counts(paired)).drop("n")
    if outputs is not None:
        table = table.join(generation_quality(outputs, annotated), "model", "left")
    absent = [m for m in METRICS if m not in table.columns]
    return table.withColumns({m: F.lit(None).cast("double") for m in absent}).select(
        "model", *METRICS
    )


def score_raw_outputs(
    raw: DataFrame, annotated: DataFrame | None = None, staged: bool = True
) -> DataFrame:
    """Raw answers ``model, id, truth, raw`` to the comparison table.

    Parsing is the costly step and its result narrow, so it is staged for the
    passes that count pairs, answers and irony.
    """
    parsed = parse_outputs(raw).select(
        "model", "id", "truth", "primary", "alternative", "irony", "parse_success"
    )
    if staged:
        parsed = stage(parsed)
    paired = parsed.select("model", "truth", F.col("primary").alias("pred"))
    return compare_models(paired, parsed, annotated)


def rounded_report(table: DataFrame, digits: int = 4) -> DataFrame:
    """The comparison table with rounded metrics, for a report file."""
    return table.select("model", *[F.round(m, digits).alias(m) for m in METRICS])
