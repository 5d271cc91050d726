"""Token-budget batches in length buckets that minimise padding.

One histogram of lengths, of bounded size, goes to the driver; dynamic programming over
its bins chooses the bucket bounds with the least padding.  Documents then find their
bucket by literals, without a join, and form batches inside shards of their bucket, so
that no bucket, however common its length, has to pass through one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.mixing import word_count

BUCKETS = 16
BUDGET = 32_768
#: lengths up to this have a bin each; above, 64 bins for each doubling
EXACT = 1_024
STEPS = 64
SHARD_ROWS = 20_000


def length_bin(length: Column) -> Column:
    """The histogram bin of a length; at most 1,024 + 64 for each doubling beyond."""
    far = F.lit(EXACT) + F.ceil(F.log2(length / F.lit(float(EXACT))) * STEPS)
    return F.when(length <= EXACT, length).otherwise(far).cast("long")


def best_bounds(count: np.ndarray, longest: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` runs of bins with the least padded length.

    Padding is the padded length less the sum of all lengths, which no choice changes.
    """
    n = len(count)
    if not n:
        return []
    total = np.append(0, np.cumsum(count)).astype(float)
    best, cut = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        now, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + longest[j - 1] * (total[j] - total[:j])
            at[j] = int(np.argmin(cost))
            now[j] = cost[at[j]]
        best = now
        cut.append(at)
    bounds, j = [], n
    for at in reversed(cut):
        if j == 0:
            break
        bounds.append(int(longest[j - 1]))
        j = int(at[j])
    return sorted(set(bounds))


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """``doc_id, n_words, bucket, bound, shard, batch, slot``, one row for each row given.

    ``bound`` is the padded length.  A batch (bucket, shard, batch) holds at most
    budget // bound documents, or one that alone is over the budget.  Null and empty
    texts have length 0 and go to the first bucket.  Repeated rows get a slot each;
    rows of equal length are ordered by key.  An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), word_count(F.col(text)).alias("n_words"))
    bins = (sized.groupBy(length_bin(F.col("n_words")).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("longest"))
            .orderBy("bin").collect())  # bounded by the number of bins
    longest = np.array([b.longest for b in bins], np.int64)
    count = np.array([b.n for b in bins], np.int64)
    bounds = best_bounds(count, longest, buckets) or [0]
    held = [int(count[(longest <= b) & (longest > a)].sum())
            for a, b in zip([-1, *bounds], bounds)]
    rooms = [max(1, budget // max(b, 1)) for b in bounds]
    shards = [max(1, math.ceil(n / SHARD_ROWS)) for n in held]
    bucket = sum((F.col("n_words") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1).cast("long")
    placed = sized.withColumn("bucket", bucket).withColumn("bound", at(bounds)).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "n_words"), at(shards)))
    order = Window.partitionBy("bucket", "shard").orderBy("n_words", F.asc_nulls_last("doc_id"))
    number = F.row_number().over(order) - 1
    return (placed.withColumn("number", number)
            .select("doc_id", "n_words", "bucket", "bound", "shard",
                    F.floor(F.col("number") / at(rooms)).alias("batch"),
                    (F.col("number") % at(rooms)).alias("slot")))
