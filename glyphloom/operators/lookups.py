"""Key-aligned tables and label usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.labels import emoji_of, label_dimension, label_of


def unique_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, failing the job if two of them share their keys.

    Duplicates are folded before the shuffle, so a join behind this cannot blow
    up on a key that fills much of the table.  The check is a filter, which runs
    whichever columns are used later.
    """
    rest = [c for c in rows.columns if c not in keys]
    message = F.concat(
        F.lit(f"more than one row for {', '.join(keys)} = "),
        F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]),
    )
    folded = rows.groupBy(*keys).agg(
        F.min(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_n")
    )
    once = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return folded.where(once).select(
        *[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in rows.columns]
    )


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with ``in_left`` and ``in_right`` marks; keys must be unique."""
    a = unique_rows(left, key).withColumn("_l", F.lit(True))
    b = unique_rows(right, key).withColumn("_r", F.lit(True))
    return a.join(b, key, "full_outer").withColumns({
        "in_left": F.coalesce("_l", F.lit(False)), "in_right": F.coalesce("_r", F.lit(False)),
    }).drop("_l", "_r")


def with_emoji(rows: DataFrame, label: str = "label") -> DataFrame:
    """Add ``emoji``, null where the label is not a class."""
    return rows.withColumn("emoji", emoji_of(F.col(label)))


def with_label(rows: DataFrame, emoji: str = "emoji") -> DataFrame:
    """Add ``label``, -1 where the emoji is not listed."""
    return rows.withColumn("label", label_of(F.col(emoji)))


def label_usage(rows: DataFrame, label: str = "label") -> DataFrame:
    """The label dimension with the number of rows of each class."""
    number = F.col(label).cast("int")
    counts = (
        rows.where(number.isin(*V.EMOJI_BY_LABEL)).groupBy(number.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    dimension = label_dimension(rows.sparkSession)
    # at most 20 counts are left by the filter
    return dimension.join(F.broadcast(counts), "label", "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )


def union_widened(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
