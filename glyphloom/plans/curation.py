"""Curated sample sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.labels import is_listed
from glyphloom.operators.curation import dedupe_first, quality_filter, with_defaults
from glyphloom.operators.lookups import union_widened
from glyphloom.operators.sampling import shuffled

_COLUMNS = ("text", "emoji", "type", "true_sentiment")


def _numbered(samples: tuple[DataFrame, ...], order: tuple[str, ...]) -> DataFrame:
    """Union of frames; earlier frames come first, ``order`` decides inside a frame."""
    frames = []
    for place, frame in enumerate(samples):
        marks = [
            (F.col(c) if c in frame.columns else F.lit(0)).cast("long").alias(c) for c in order
        ]
        fields = [c for c in _COLUMNS if c in frame.columns]
        frames.append(frame.select(F.lit(place).alias("origin"), *marks, *fields))
    return union_widened(*frames)


def curate(*samples: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``origin, <order>, text, emoji, type, true_sentiment`` without bad or repeated samples.

    Filters come before the keep-first choice: a sample that fails them never
    hides a later one with the same text.
    """
    good = quality_filter(_numbered(samples, order))
    return dedupe_first(good, F.lower("text"), "origin", *order)


def curated_in_random_order(*samples: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The curated set, shuffled."""
    return shuffled(curate(*samples, **options), "text", seed)


def curation_counts(*samples: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``stage, n``: samples read, long enough, with a listed emoji, and not repeated."""
    filled = with_defaults(_numbered(samples, order))
    long_enough = F.length("text") >= V.MIN_CHARS
    good = long_enough & is_listed(F.col("emoji"))
    # one row per text: how many samples had it, and how many of them were good
    texts = filled.groupBy(F.lower("text").alias("key")).agg(
        F.count(F.lit(1)).alias("read"), F.count_if(long_enough).alias("long_enough"),
        F.count_if(good).alias("listed"), F.max(good.cast("long")).alias("unique"),
    )
    names = ("read", "long_enough", "listed", "unique")
    totals = texts.agg(*[F.sum(c).alias(c) for c in names])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("stage"), F.coalesce(F.col(c), F.lit(0)).alias("n"))
        for c in names
    ])))
