"""Quality filters and keep-first de-duplication of text/emoji samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.labels import is_listed
from glyphloom.functions.text import strip


def with_defaults(samples: DataFrame) -> DataFrame:
    """Trim text and emoji, fill what is missing (also whole columns)."""
    def column(name: str) -> Column:
        return F.col(name) if name in samples.columns else F.lit(None).cast("string")

    return samples.withColumns({
        "text": strip(F.coalesce(column("text"), F.lit(""))),
        "emoji": strip(F.coalesce(column("emoji"), F.lit(""))),
        "type": F.coalesce(column("type"), F.lit(V.UNKNOWN)),
        "true_sentiment": F.coalesce(column("true_sentiment"), F.lit(V.UNKNOWN)),
    })


def usable(text: Column, emoji: Column) -> Column:
    """Long enough (trimmed) and with a listed emoji."""
    return (F.length(text) >= V.MIN_CHARS) & is_listed(emoji)


def quality_filter(samples: DataFrame) -> DataFrame:
    """Samples that pass the length and emoji checks, with defaults filled."""
    return with_defaults(samples).where(usable(F.col("text"), F.col("emoji")))


def dedupe_first(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row by ``order`` for each key.

    The minimum of a struct is combined before the shuffle, so each task sends
    one row per key and a text that fills a third of the table stays cheap.
    """
    rest = [c for c in rows.columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_row")
    return (
        rows.groupBy(key.alias("_key")).agg(first)
        .select(*[F.col("_row").getField(c).alias(c) for c in rows.columns])
    )


def type_distribution(samples: DataFrame) -> DataFrame:
    """``type, n``."""
    return samples.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
