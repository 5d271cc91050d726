"""Exact top-k search by columnar branch-and-bound.

Vectors are packed into blocks, stored dimension by dimension.  A block of queries
meets a block of candidates in one row: scores accumulate a slab of dimensions at a
time, and after each slab only candidates stay whose partial score plus the largest
score the other dimensions could still add reaches the query's bar.  Each block pair
returns k rows a query; a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.session import stage

BLOCK = 4_096
QUERIES = 512
SLAB = 16
#: candidate blocks that share a copy of the queries
GROUP = 4

PACKED = "ids binary, rows binary, width int, n int"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that takes no part."""
    values = vector.cast("array<double>")
    good = ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(good & (F.size(values) > 0), F.transform(values, lambda x: F.floor(x * scale)))


def pack_blocks(rows_per_block: int):
    """``id, vector`` rows of one block to ``PACKED``: ids, and the matrix column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            widths = np.diff(vectors.offsets.to_numpy())
            at = np.append(0, np.cumsum(widths))
            ids = batch.column("id").to_numpy()
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                matrix = flat[at[rows][:, None] + np.arange(width)]
                held.setdefault(int(width), []).append((ids[rows], matrix))
                if sum(len(x) for x, _ in held[int(width)]) >= rows_per_block:
                    yield from _packed(held.pop(int(width)), int(width), rows_per_block)
        for width, parts in held.items():
            yield from _packed(parts, width, rows_per_block)

    return run


def _packed(parts: list, width: int, most: int) -> Iterator[pa.RecordBatch]:
    ids, rows = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    for a in range(0, len(ids), most):
        one, cut = ids[a:a + most], rows[a:a + most]
        yield pa.RecordBatch.from_arrays([
            pa.array([one.astype(np.int64).tobytes()], pa.binary()),
            pa.array([np.ascontiguousarray(cut.T).tobytes()], pa.binary()),
            pa.array([width], pa.int32()), pa.array([len(one)], pa.int32())],
            names=["ids", "rows", "width", "n"])


def bounded_search(k: int):
    """Pairs of packed blocks to the k best candidates of each query in the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q = np.frombuffer(row["q_rows"], np.int64).reshape(width, -1)
                c = np.frombuffer(row["rows"], np.int64).reshape(width, -1)
                yield _best(q_ids, q, c_ids, c, k)

    return run


def _best(q_ids, q, c_ids, c, k) -> pa.RecordBatch:
    width = len(q)
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width
    exact = np.float64 if largest < 2**53 else np.int64  # sums of whole numbers, exact either way
    q, c = q.astype(exact), c.astype(exact)
    # dimensions with most mass first, so that the rest is small early
    order = np.argsort(-(c.astype(float) ** 2).sum(1), kind="stable")
    q, c = q[order], c[order]
    slabs = [slice(a, min(a + SLAB, width)) for a in range(0, width, SLAB)]
    rest = lambda m: np.sqrt(np.cumsum((m.astype(float) ** 2)[::-1], axis=0)[::-1])
    q_rest, c_rest = rest(q), rest(c)
    probe = np.arange(min(len(c_ids), 8 * k))
    first = q[slabs[0]].T @ c[slabs[0]]
    out_q, out_c, out_s = [], [], []
    for i in range(len(q_ids)):
        own = probe[c_ids[probe] != q_ids[i]]
        known = np.sort(q[:, i] @ c[:, own])
        bar = known[-k] if len(known) >= k else -np.inf
        alive, score = np.arange(len(c_ids)), first[i]
        for slab, after in zip(slabs, [*slabs[1:], None]):
            if slab.start:
                score = score + q[slab, i] @ c[slab, alive]
            if after is not None:
                most = score + q_rest[after.start, i] * c_rest[after.start, alive] * (1 + 1e-9) + 1e-6
                stay = most >= bar
                alive, score = alive[stay], score[stay]
        keep = c_ids[alive] != q_ids[i]
        alive, score = alive[keep], score[keep]
        if len(alive) > k:  # ties of the k-th score all stay until ids decide
            bar = np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[score >= bar], score[score >= bar]
        best = np.lexsort((c_ids[alive], -score))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_c.append(c_ids[alive[best]])
        out_s.append(score[best].astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x)) for x in (out_q, out_c, out_s)],
        names=["query_id", "vec_id", "score"])


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
    vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of floor(scale * x).

    Queries are the rows where ``is_query`` holds; candidates are all rows but those
    with the query's key.  Ties go to the smaller key, then to either of two equal rows.
    Null or empty vectors, those with null or non-finite components, and null keys take
    no part; vectors of different lengths are not compared.  Components times ``scale``
    must fit 2**31.  Fewer candidates than k give fewer rows; an empty table gives none.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and vector is not null")
    blocks = stage(rows.select("id", "vector").mapInArrow(pack_blocks(BLOCK), PACKED))
    asks = stage(rows.where("asks").select("id", "vector").mapInArrow(pack_blocks(QUERIES), PACKED)
                 .select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"),
                         "width", F.col("n").alias("q_n")))
    # each group of blocks gets its own copy of the queries, so no key is common to all rows
    groups = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-blocks.count() // GROUP))
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    met = blocks.join(asks, ["width", "part"]).select("ids", "rows", "width", "q_ids", "q_rows")
    found = met.mapInArrow(bounded_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
