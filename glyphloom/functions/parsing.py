"""Raw model output to records, with VARIANT as the JSON engine.

Everything is one narrow projection: no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.labels import is_listed
from glyphloom.functions.text import strip

PARSED = ("primary", "alternative", "tone", "irony", "reason", "parse_success")


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Let the last of several equal JSON keys win instead of failing the parse."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strip_think(raw: Column) -> Column:
    """Remove closed ``<think>`` blocks; an unclosed one stays."""
    return strip(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""))


def strip_fences(text: Column) -> Column:
    """Remove Markdown code fence markers, keeping what is between them."""
    return strip(F.regexp_replace(text, "```json|```", ""))


def json_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty string when there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def scan_emoji(text: Column) -> Column:
    """Listed emoji in order of appearance, repeats kept."""
    longest_first = sorted(V.EMOJI, key=len, reverse=True)
    return F.regexp_extract_all(text, F.lit("|".join(longest_first)), F.lit(0))


def wrapped_variant(text: Column) -> Column:
    """``text`` parsed as the only element of a JSON array, else null.

    ``try_parse_json`` ignores what follows the first JSON value.  Inside
    brackets trailing text is an error, apart from ``,`` which shows up as a
    second element; see ``single_value``.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def single_value(text: Column, wrapped: Column) -> Column:
    """True when ``text`` is exactly one JSON value."""
    second = F.try_variant_get(wrapped, "$[1]", "variant")
    return (text != "") & wrapped.isNotNull() & second.isNull()


def _field(wrapped: Column, name: str) -> Column:
    return F.try_variant_get(wrapped, f"$[0].{name}", "variant")


def _string_field(wrapped: Column, name: str) -> Column:
    """The field if it is a JSON string, else null (getters stringify numbers)."""
    kind = F.schema_of_variant(_field(wrapped, name))
    return F.when(kind == "STRING", F.try_variant_get(wrapped, f"$[0].{name}", "string"))


def _text_field(wrapped: Column, name: str) -> Column:
    """The field as text, empty when the key is missing, null for JSON null."""
    missing = _field(wrapped, name).isNull()
    return F.when(missing, "").otherwise(F.try_variant_get(wrapped, f"$[0].{name}", "string"))


def _truthy(wrapped: Column, name: str) -> Column:
    """Python truthiness of a JSON value: zero, empty and missing are false."""
    shown = F.to_json(_field(wrapped, name))
    empty = shown.isin("false", "null", '""', "[]", "{}")
    number = shown.try_cast("double")
    return F.coalesce(~empty & F.coalesce(number != 0, F.lit(True)), F.lit(False))


def parse_outputs(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the ``PARSED`` columns to a frame of raw model answers.

    ``parse_success`` tells whether the JSON span was valid, before the emoji
    are checked.  Without a listed primary the whole answer (thinking removed)
    is scanned: the first emoji found becomes primary, the second, if any,
    replaces the alternative, and with nothing found primary is the no-answer
    marker.  A primary or alternative that is not a JSON string counts as absent.
    """
    allow_duplicate_keys(outputs.sparkSession)
    answer = strip_think(F.coalesce(F.col(raw), F.lit("")))
    kept = outputs.columns
    spanned = outputs.select("*", answer.alias("_answer")).select(
        "*", json_span(strip_fences(F.col("_answer"))).alias("_span")
    )
    parsed = spanned.select("*", wrapped_variant(F.col("_span")).alias("_json")).select(
        "*", single_value(F.col("_span"), F.col("_json")).alias("parse_success")
    )
    ok, doc = F.col("parse_success"), F.col("_json")
    named = parsed.select(
        "*",
        F.when(ok, strip(_string_field(doc, "primary"))).alias("_primary"),
        F.when(ok, strip(_string_field(doc, "alternative"))).alias("_alternative"),
    ).select(
        "*",
        F.when(is_listed(F.col("_primary")), F.col("_primary")).alias("_first"),
        F.when(is_listed(F.col("_alternative")), F.col("_alternative")).alias("_second"),
    ).select(
        "*", F.when(F.col("_first").isNull(), scan_emoji(F.col("_answer"))).alias("_found")
    )
    return named.select(
        *kept,
        F.coalesce("_first", F.get("_found", F.lit(0)), F.lit(V.NO_ANSWER)).alias("primary"),
        F.coalesce(F.get("_found", F.lit(1)), F.col("_second")).alias("alternative"),
        F.when(ok, _text_field(doc, "tone")).otherwise("").alias("tone"),
        (ok & _truthy(doc, "irony")).alias("irony"),
        F.when(ok, _text_field(doc, "reason")).otherwise("").alias("reason"),
        "parse_success",
    )
