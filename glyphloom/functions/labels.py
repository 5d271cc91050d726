"""Lookups over the fixed label set, as expressions and as dimension frames.

The set has 20 entries by definition, so an expression with a literal map never
grows with the data and saves the join.  The frames are for joins against
already aggregated rows.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom import values as V


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def emoji_of(label: Column) -> Column:
    """Class number to emoji; null when the number is not a class."""
    return F.try_element_at(_literal_map(V.EMOJI_BY_LABEL), label.cast("int"))


def label_of(emoji: Column) -> Column:
    """Emoji to class number; -1 when the emoji is not listed."""
    reverse = {e: n for n, e in V.EMOJI_BY_LABEL.items()}
    return F.coalesce(F.try_element_at(_literal_map(reverse), emoji), F.lit(V.UNKNOWN_LABEL))


def alternative_of(emoji: Column) -> Column:
    """Second choice for an emoji, with a default for all others."""
    return F.coalesce(
        F.try_element_at(_literal_map(V.ALTERNATIVE), emoji), F.lit(V.DEFAULT_ALTERNATIVE)
    )


def is_listed(emoji: Column) -> Column:
    """True for one of the 20 listed emoji, false for all else and for null."""
    return F.coalesce(emoji.isin(*V.EMOJI), F.lit(False))


def polarity_of(emoji: Column) -> Column:
    """``positive`` or ``neutral_or_negative``; unlisted values are the latter."""
    return F.when(emoji.isin(*V.POSITIVE_EMOJI), V.POSITIVE).otherwise(V.NOT_POSITIVE_NAME)


def label_dimension(spark: SparkSession) -> DataFrame:
    """``label, emoji, polarity, alternative``: one row per class."""
    rows = [
        (n, e, V.POSITIVE if e in V.POSITIVE_EMOJI else V.NOT_POSITIVE_NAME,
         V.ALTERNATIVE.get(e, V.DEFAULT_ALTERNATIVE))
        for n, e in V.EMOJI_BY_LABEL.items()
    ]
    return spark.createDataFrame(
        rows, "label int, emoji string, polarity string, alternative string"
    )


def similarity_dimension(spark: SparkSession) -> DataFrame:
    """``pred, truth, hundredths``: both directions of each similar pair."""
    rows = [(a, b, s) for (a, b), s in V.SIMILARITY.items()]
    rows += [(b, a, s) for a, b, s in rows]
    return spark.createDataFrame(rows, "pred string, truth string, hundredths int")
