"""Connected components of a link table, by alternating star contractions.

Rows are links, so a component of any size stays spread over tasks; each round
writes its links to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.session import stage


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Point the neighbours of each node (only larger ones, or only smaller) at its smallest."""
    if larger:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("low")).select(
        "a", F.least("a", "low").alias("low"))
    joined = near.join(least, "a")
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component``: for each node of the links ``a, b`` the smallest node it reaches.

    Links may repeat, point either way or at themselves; null ends are dropped.
    Nodes without links to others are absent; no links give no rows.
    """
    links = stage(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        links = stage(_stars(_stars(links, larger=True), larger=False))
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    low = links.groupBy("a").agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("component"))
    return low.union(roots).select(F.col("a").alias("node"), "component")
