import hashlib
import math

import pytest
from pyspark.sql import functions as F

from glyphloom.operators import sampling


def _order(keys, seed=42):
    return sorted(keys, key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())


@pytest.mark.parametrize("rows, n", [(5000, 1), (5000, 1234), (5000, 4999), (7, 7), (7, 9), (0, 3)])
def test_sample_is_exact(spark, rows, n):
    got = [r.id for r in sampling.sample_exact(spark.range(rows), "id", n).collect()]
    assert sorted(got) == sorted(_order(range(rows))[:n])


def test_sample_without_size_keeps_all(spark):
    assert sampling.sample_exact(spark.range(5), "id", 0).count() == 5
    assert sampling.sample_exact(spark.range(5), "id", None).count() == 5


def test_sample_does_not_depend_on_partitions(spark):
    one = sampling.sample_exact(spark.range(0, 3000, 1, 1), "id", 100, seed=7)
    many = sampling.sample_exact(spark.range(0, 3000, 1, 16), "id", 100, seed=7)
    assert {r.id for r in one.collect()} == {r.id for r in many.collect()}
    other = sampling.sample_exact(spark.range(3000), "id", 100, seed=8)
    assert {r.id for r in one.collect()} != {r.id for r in other.collect()}


@pytest.mark.parametrize("rows", [0, 1, 9, 10, 11, 70, 1000])
def test_split_size(spark, rows):
    got = sampling.train_val_split(spark.range(rows), "id").collect()
    val = {r.id for r in got if r.split == "val"}
    assert len(got) == rows
    assert val == set(_order(range(rows))[:math.ceil(0.1 * rows)])
    now = sampling.train_val_split(spark.range(rows), "id", eager=True).where("split = 'val'")
    assert {r.id for r in now.collect()} == val


def test_split_by_group(spark):
    rows = spark.range(1000).withColumn("g", F.when(F.col("id") < 950, "a").otherwise("b"))
    got = sampling.train_val_split(rows, "id", group=F.col("g")).where("split = 'val'")
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"a": 95, "b": 5}


def test_positions_are_a_permutation(spark):
    got = sampling.shuffle_position(spark.range(2000), "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == _order(range(2000))
    assert sorted(r.position for r in got) == list(range(1, 2001))
    assert [r.id for r in sampling.shuffled(spark.range(50), "id").collect()] == _order(range(50))


def _repeated(spark):
    """100 keys, key k in k % 4 + 1 rows; rows of one key differ in ``v`` except key 0's copies."""
    rows = [(k, 0 if k % 10 == 0 else c) for k in range(100) for c in range(k % 4 + 1)]
    return rows, spark.createDataFrame(rows, "id long, v long")


@pytest.mark.parametrize("n", [1, 7, 150, 249, 250, 400])
def test_sample_is_exact_on_repeated_keys(spark, n):
    rows, frame = _repeated(spark)
    got = sampling.sample_exact(frame, "id", n).collect()
    assert len(got) == min(n, len(rows))
    whole = {k for k in range(100) if sum(1 for r in got if r.id == k) == k % 4 + 1}
    order = _order(range(100))
    assert sum(1 for r in got if r.id not in whole) == (0 if n >= len(rows) else len(got) - sum(k % 4 + 1 for k in whole))
    # the keys taken whole are the first in draw order; at most one key is taken in part
    assert whole == set(order[:len(whole)])
    assert len({r.id for r in got} - whole) <= 1
    assert sorted(got) == sorted(sampling.sample_exact(frame.repartition(7), "id", n, eager=True).collect())


def test_equal_rows_at_the_bound_are_counted_one_by_one(spark):
    frame = spark.createDataFrame([(5, "a")] * 40 + [(6, "b")] * 3, "id long, t string")
    for n in (1, 17, 39, 41, 42):
        got = sampling.sample_exact(frame, "id", n).collect()
        assert len(got) == n
    split = sampling.train_val_split(frame, "id", test_size=0.5).collect()
    assert len(split) == 43 and sum(r.split == "val" for r in split) == 22


def test_split_is_exact_on_repeated_keys_and_skips_null_keys(spark):
    rows, frame = _repeated(spark)
    frame = frame.union(spark.createDataFrame([(None, 1)] * 5, "id long, v long"))
    got = sampling.train_val_split(frame, "id", eager=True).collect()
    assert len(got) == len(rows) + 5
    assert sum(r.split == "val" for r in got) == math.ceil(0.1 * len(rows))
    assert all(r.split == "train" for r in got if r.id is None)
    assert sampling.train_val_split(frame.limit(0), "id").count() == 0
