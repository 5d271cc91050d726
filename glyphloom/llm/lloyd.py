"""Centroid clustering by dimension-sharded Lloyd rounds.

Vectors are stored vertically: one row per vector and block of dimensions
(``row, vec_id, shard, slice``).  A round runs in three steps, all on Spark:

1. each block row computes its exact partial squared distances to the matching
   slice of every centroid (the centroids are a literal of ``k * width``
   integers, so the step is a projection inside whole-stage code);
2. a group by the vector adds the blocks' partial distances and takes the
   argmin (ties to the smaller centroid number);
3. the assignment meets the block rows again and a group by ``(shard,
   cluster)`` sums each shard's slices, combined map-side, so a cluster that
   holds most vectors is still summed in many tasks.  Only ``k * shards`` sums
   reach the driver, which sets each shard's slice of each centroid.

Cases: vectors that are null, of another width, or hold a null or non-finite
component are not kept and return no row.  Repeated rows (equal ``vec_id`` and
vector) are separate vectors, each with its own row.  A null ``vec_id`` is kept;
it sorts after all others when the first centroids are chosen.  Fewer kept
vectors than ``k`` give as many centroids as vectors; an empty table gives no
rows.  Components whose integer exceeds ``LARGEST`` in size stop the job with an
error rather than overflow the 64-bit distances.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.session import stage

#: fixed by the query's contract: width of a kept vector, scale, centroids, rounds
WIDTH = 64
SCALE = 64
K = 16
ROUNDS = 3
#: dimensions per shard; a vector is stored as WIDTH // SHARD block rows
SHARD = 16
#: largest integer component; 4 * LARGEST**2 * WIDTH stays below 2**63
LARGEST = 1 << 27


@dataclass
class Clustering:
    """Per-vector result and the final centroids (``k`` lists of ``width`` integers)."""

    vectors: DataFrame
    centroids: list[list[int]]


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(str(v) for v in centroid).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, column: str = "embedding", width: int = WIDTH,
                    scale: int = SCALE) -> DataFrame:
    """``vec_id, values``: floor(scale * x) of kept vectors as ints; others are dropped."""
    values = F.col(column).cast("array<double>")
    good = (values.isNotNull() & (F.size(values) == width)
            & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    scaled = F.transform(values, lambda x: F.floor(x * scale))
    too_big = F.exists(scaled, lambda v: F.abs(v) > LARGEST)
    checked = F.when(too_big, F.raise_error(F.lit(f"component above {LARGEST} after scaling"))).otherwise(
        F.transform(scaled, lambda v: v.cast("int")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("values"))


def first_centroids(kept: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The ``k`` vectors with smallest sha256 of ``<seed>:<vec_id>``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "values").orderBy(F.asc_nulls_last("h"), "values").limit(k).collect()
    return [list(r["values"]) for r in rows]


def _blocks(kept: DataFrame, width: int, shard: int) -> DataFrame:
    shards = width // shard
    # the key is taken before the rows are split, so all blocks of a vector share it
    numbered = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "values")
    return numbered.select(
        "row", "vec_id",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                                 lambda s: F.slice("values", s * shard + 1, shard))).alias("shard", "slice"))


def _assign(blocks: DataFrame, centroids: list[list[int]], shard: int) -> DataFrame:
    """``row, vec_id, cluster, distance``: partial distances per block, added by vector."""
    k, width = len(centroids), len(centroids[0])
    flat = F.array(*[F.lit(v) for c in centroids for v in c]).cast("array<long>")

    def partial(c: Column) -> Column:
        part = F.slice(flat, c * width + F.col("shard") * shard + 1, shard)
        return F.aggregate(F.zip_with(F.col("slice").cast("array<long>"), part, lambda a, b: (a - b) * (a - b)),
                           F.lit(0).cast("long"), lambda acc, x: acc + x)

    parts = blocks.select("row", "vec_id", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), partial).alias("p"))
    summed = parts.groupBy("row", "vec_id").agg(*[F.sum(F.col("p")[c]).alias(f"d{c}") for c in range(k)])
    dist = F.array(*[F.col(f"d{c}") for c in range(k)])
    return summed.select("row", "vec_id", (F.array_position(dist, F.array_min(dist)) - 1).cast("int").alias("cluster"),
                         F.array_min(dist).alias("distance"))


def _update(blocks: DataFrame, assigned: DataFrame, centroids: list[list[int]], shard: int) -> list[list[int]]:
    """Each shard's slice of each non-empty centroid becomes the exact floor of its mean."""
    sums = (blocks.join(assigned.select("row", "cluster"), "row")
            .groupBy("shard", "cluster")
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("slice")[j]).alias(f"s{j}") for j in range(shard)])
            .collect())
    fresh = [list(c) for c in centroids]
    for r in sums:
        base = r["shard"] * shard
        for j in range(shard):
            fresh[r["cluster"]][base + j] = r[f"s{j}"] // r["n"]
    return fresh


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, column: str = "embedding",
          width: int = WIDTH, scale: int = SCALE, shard: int = SHARD, seed: int = 1) -> Clustering:
    """Cluster ``vectors`` (``vec_id`` and an array column) by ``rounds`` Lloyd rounds.

    Returns per kept vector ``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256`` (the final assignment, squared distances as long) and the
    final centroids.
    """
    if width % shard:
        raise ValueError("width must be a multiple of the shard size")
    kept = integer_vectors(vectors, column, width, scale)
    blocks = stage(_blocks(kept, width, shard))
    centroids = first_centroids(kept, k, seed)
    spark = vectors.sparkSession
    if not centroids:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return Clustering(spark.createDataFrame([], empty), [])
    for _ in range(rounds):
        centroids = _update(blocks, _assign(blocks, centroids, shard), centroids, shard)
    final = stage(_assign(blocks, centroids, shard))
    per = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(per.values())
    inertia = F.create_map(*[x for c, s in per.items() for x in (F.lit(c), F.lit(s).cast("long"))])
    digest = F.create_map(*[x for c, v in enumerate(centroids) for x in (F.lit(c), F.lit(centroid_digest(v)))])
    out = final.select("vec_id", "cluster", "distance", inertia[F.col("cluster")].alias("cluster_inertia"),
                       F.lit(total).cast("long").alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))
    return Clustering(out, centroids)


def oracle(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 1) -> str:
    """DuckDB SQL for ``lloyd`` on ``embeddings``, rounds unrolled."""
    parts = [f"""v AS (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {width}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS cluster, e FROM (
    SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT {k}))"""]

    def assign(r: int) -> str:
        return f"""a{r} AS (
  SELECT rid, vec_id, cluster, d FROM (
    SELECT v.rid, v.vec_id, c.cluster,
      CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d,
      row_number() OVER (PARTITION BY v.rid ORDER BY
        list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster) AS o
    FROM v CROSS JOIN c{r} c) WHERE o = 1)"""

    for r in range(rounds):
        parts.append(assign(r))
        parts.append(f"""s{r} AS (
  SELECT a.cluster, g.i, sum(v.e[g.i]) AS tot, count(*) AS n
  FROM a{r} a JOIN v USING (rid) CROSS JOIN range(1, {width + 1}) g(i) GROUP BY a.cluster, g.i)""")
        parts.append(f"""c{r + 1} AS (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
    SELECT cluster, list(CAST((tot - (((tot % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS e
    FROM s{r} GROUP BY cluster) m USING (cluster))""")
    parts.append(assign(rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)
"""


ORACLE = oracle()
