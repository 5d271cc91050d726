"""Samples out of generated answers that should each be one JSON array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.parsing import (
    allow_duplicate_keys,
    single_value,
    strip_fences,
    wrapped_variant,
)

_FIELDS = ("text", "emoji", "type", "true_sentiment")


def parse_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``accepted`` and ``items``, the array elements as VARIANT.

    An answer is accepted when, without code fences, all of it is one JSON array;
    a bad one only loses itself.
    """
    allow_duplicate_keys(answers.sparkSession)
    kept = answers.columns
    body = answers.select("*", strip_fences(F.coalesce(F.col(answer), F.lit(""))).alias("_body"))
    doc = body.select("*", wrapped_variant(F.col("_body")).alias("_json"))
    whole = F.try_variant_get(F.col("_json"), "$[0]", "variant")
    is_array = F.coalesce(F.schema_of_variant(whole).startswith("ARRAY"), F.lit(False))
    checked = doc.select(
        "*", (single_value(F.col("_body"), F.col("_json")) & is_array).alias("accepted")
    )
    items = F.when(
        F.col("accepted"), F.try_variant_get(F.col("_json"), "$[0]", "array<variant>")
    )
    return checked.select(*kept, "accepted", items.alias("items"))


def answer_samples(parsed: DataFrame, key: str = "batch_id") -> DataFrame:
    """``key, pos, text, emoji, type, true_sentiment``: one row per sample.

    Fields that are missing or no JSON strings are null.
    """
    # From a plain posexplode Spark would derive a filter on the items and parse
    # each answer again for it; the outer form with a check afterwards does not.
    items = parsed.select(key, F.posexplode_outer("items").alias("pos", "_item")).where(
        F.col("pos").isNotNull()
    )

    def field(name: str):
        value = F.try_variant_get(F.col("_item"), f"$.{name}", "variant")
        text = F.try_variant_get(F.col("_item"), f"$.{name}", "string")
        return F.when(F.schema_of_variant(value) == "STRING", text).alias(name)

    return items.select(key, "pos", *[field(name) for name in _FIELDS])


def answer_counts(parsed: DataFrame) -> DataFrame:
    """``answers, accepted, rejected, samples`` of a parsed answer table."""
    ok = F.col("accepted").cast("long")
    return parsed.agg(
        F.count(F.lit(1)).alias("answers"), F.sum(ok).alias("accepted"),
        F.sum(1 - ok).alias("rejected"),
        F.sum(F.when(F.col("accepted"), F.size("items")).otherwise(0)).alias("samples"),
    )
