"""Approximate nearest neighbours by a permutation index.

A few vectors serve as pivots.  Every vector is represented by the order in which it
sees them and posted in the inverted files of its nearest pivots; a query reads the
files of its own nearest pivots, ranks what it finds by the footrule distance of the
orders, and reranks the best share by the exact measure.  Files are cut into cells of
bounded size by vector and by query, so a pivot that many share stays spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm import kernels as K
from glyphloom.session import stage

#: pivots: one for so many vectors, up to the most
VECTORS_PER_PIVOT, MOST_PIVOTS = 32, 64
POSTED, PROBED = 4, 16
#: share of what a query finds in a cell that is reranked
RERANKED = 0.25
CELL_VECTORS, CELL_QUERIES = 8_192, 2_048

ENTRY = "pivot int, asks boolean, id long, vector binary, ranks binary"


def usable(vector: Column) -> Column:
    """The components as doubles; null if any is null or not finite, or all are zero."""
    x = vector.cast("array<double>")
    good = (~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
            & F.exists(x, lambda v: v != 0))
    return F.when(good, x)


def post(pivots: np.ndarray):
    """``id, asks, vector`` to entries in inverted files: each vector, and each query's probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(pivots)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = K.flat_lists(batch.column("vector"))[0].reshape(n, -1)
            near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
            ranks = np.empty((n, m), np.int8)
            np.put_along_axis(ranks, near, np.arange(m, dtype=np.int8)[None, :], 1)
            asks = np.array(batch.column("asks").to_pylist(), bool)
            ids = batch.column("id")
            vector = np.array([v.tobytes() for v in x], object)
            order = np.array([r.tobytes() for r in ranks], object)
            for role, rows, k in ((False, np.arange(n), POSTED), (True, np.flatnonzero(asks), PROBED)):
                k = min(k, m)
                if not len(rows):
                    continue
                at = np.repeat(rows, k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(near[rows, :k].ravel().astype(np.int32)), pa.array(np.full(len(at), role)),
                    ids.take(pa.array(at)), pa.array(vector[at], pa.binary()), pa.array(order[at], pa.binary())],
                    names=["pivot", "asks", "id", "vector", "ranks"])

    return run


def search_cells(k: int, reranked: float):
    """Cells, queries first, to the best k of each query in its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, "cell"):
            cells = table.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
            for a, b in zip(edges, edges[1:]):
                found = _search(table.slice(a, b - a), k, reranked)
                if found is not None:
                    yield found

    return run


def _search(cell: pa.Table, k: int, reranked: float) -> pa.RecordBatch | None:
    asks = np.array(cell.column("asks").to_pylist(), bool)
    if not asks.any() or asks.all():
        return None
    ids = cell.column("id").to_numpy()
    vectors = np.frombuffer(b"".join(cell.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
    ranks = np.frombuffer(b"".join(cell.column("ranks").to_pylist()), np.int8).reshape(len(ids), -1)
    c_ids, c, c_ranks = ids[~asks], vectors[~asks], np.ascontiguousarray(ranks[~asks].T)
    keep = min(len(c_ids), max(8 * k, int(np.ceil(reranked * len(c_ids)))) + 1)
    # how far a product of two vectors of length 1 may be from the exact one, with room to spare
    slack = 8 * c.shape[1] * np.finfo(np.float64).eps * np.sqrt((c * c).sum(1).max())
    out = []
    for q_id, q, own in zip(ids[asks], vectors[asks], ranks[asks]):
        distance = np.abs(c_ranks - own[:, None]).sum(0, dtype=np.int16)
        # neither cut parts equals: copies of one vector all stay until their keys are compared
        near = np.flatnonzero(distance <= np.partition(distance, keep - 1)[keep - 1])
        near = near[c_ids[near] != q_id]
        if not len(near):
            continue
        rough = c[near] @ q
        if len(near) > k:
            near = near[rough >= np.partition(rough, len(near) - k)[len(near) - k] - 2 * slack * np.sqrt(q @ q)]
        exact = (c[near] * q).sum(1)  # the same for a pair in whichever cell it meets
        best = np.lexsort((c_ids[near], -exact))[:k]
        out.append((np.full(len(best), q_id), c_ids[near[best]], exact[best]))
    if not out:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id",
    vector: str = "embedding", reranked: float = RERANKED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the k largest inner products of each query.

    Queries are the rows where ``is_query`` holds; candidates all rows but those with
    the query's key.  Scores are exact, in double precision; ties go to the smaller key;
    rows with one key and different vectors count once, by their larger score.  Null,
    empty, zero vectors, those with null or non-finite components and null keys take
    no part.  Vectors of each length are searched among those of the same length,
    each length with an index of its own.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
                          usable(F.col(vector)).alias("vector"))
    rows = stage(rows.where("id is not null and vector is not null").withColumn("width", F.size("vector")))
    widths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect()
    found = [_nearest_of_width(rows.where(F.col("width") == w.width).drop("width"), w.n, k, reranked)
             for w in widths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionAll, found)


def _nearest_of_width(rows: DataFrame, n: int, k: int, reranked: float) -> DataFrame:
    """``nearest`` among ``id, asks, vector`` rows that all have one length."""
    m = max(1, min(MOST_PIVOTS, n // VECTORS_PER_PIVOT))
    tried = rows.orderBy(F.xxhash64("id"), "id").limit(8 * MOST_PIVOTS).select("vector").collect()
    pivots = np.array(list(dict.fromkeys(tuple(r.vector) for r in tried))[:m])
    pivots = pivots / np.sqrt((pivots ** 2).sum(1, keepdims=True))
    entries = stage(rows.select("id", "asks", "vector").mapInArrow(post(pivots), ENTRY))
    sizes = {(r.pivot, r.asks): r.n for r in
             entries.groupBy("pivot", "asks").agg(F.count(F.lit(1)).alias("n")).collect()}  # two a pivot
    parts = [-(-sizes.get((p, False), 0) // CELL_VECTORS) or 1 for p in range(len(pivots))]
    asked = [-(-sizes.get((p, True), 0) // CELL_QUERIES) or 1 for p in range(len(pivots))]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pivot") + 1)
    own_v, own_q = F.pmod(F.xxhash64("id"), of(parts)).cast("int"), F.pmod(F.xxhash64("id"), of(asked)).cast("int")
    numbers = lambda values: F.sequence(F.lit(0), of(values) - 1)
    placed = (entries.withColumn("v", F.explode(F.when(F.col("asks"), numbers(parts)).otherwise(F.array(own_v))))
              .withColumn("q", F.explode(F.when(F.col("asks"), F.array(own_q)).otherwise(numbers(asked))))
              .withColumn("cell", F.xxhash64("pivot", "v", "q")).select("cell", "asks", "id", "vector", "ranks"))
    found = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        search_cells(k, reranked), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
