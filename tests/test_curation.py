import pytest
from pyspark.sql import functions as F

from glyphloom.operators import curation, lookups
from glyphloom.plans import curation as plans
from glyphloom.sources.seeds import SEEDS, seed_samples

SCHEMA = "seq long, text string, emoji string, type string, true_sentiment string"


def _samples(spark, *rows, parts=1):
    return spark.createDataFrame(
        [(n, *row) for n, row in enumerate(rows)], SCHEMA).repartition(parts)


def test_filters_come_before_the_first_choice(spark):
    rows = [
        ("too short", "😂", "irony", "mixed"),
        ("Long enough text", "🙄", "irony", "mixed"),
        (" LONG enough text\t", " 😂 ", None, None),
        ("long ENOUGH text", "💕", "slang", "positive"),
        ("x" * 10, "😂", "slang", "positive"),
        (None, "😂", None, None),
    ]
    for parts in (1, 16):
        got = plans.curate(_samples(spark, *rows, parts=parts)).orderBy("seq").collect()
        assert [(r.seq, r.text, r.emoji, r.type, r.true_sentiment) for r in got] == [
            (2, "LONG enough text", "😂", "unknown", "unknown"),
            (4, "x" * 10, "😂", "slang", "positive"),
        ]
    counts = {r.stage: r.n for r in plans.curation_counts(_samples(spark, *rows)).collect()}
    assert counts == {"read": 6, "long_enough": 4, "listed": 3, "unique": 2}


def test_earlier_frames_win(spark):
    first = _samples(spark, ("the same sentence", "😂", "irony", "mixed"))
    second = spark.createDataFrame([("The Same Sentence", "💕")], "text string, emoji string")
    (row,) = plans.curate(first, second).collect()
    assert (row.origin, row.emoji) == (0, "😂")
    (row,) = plans.curate(second, first).collect()
    assert (row.origin, row.emoji, row.type) == (0, "💕", "unknown")


def test_curating_twice_changes_nothing(spark):
    once = plans.curate(seed_samples(spark))
    again = plans.curate(once)
    assert once.count() == again.count() < len(SEEDS)
    kinds = {r.type for r in curation.type_distribution(once).collect()}
    assert "irony" in kinds and "bittersweet" in kinds


def test_hot_text_is_combined_before_the_shuffle(spark):
    hot = spark.range(20000).select(
        F.col("id").alias("seq"), F.lit("a very common sentence").alias("text"),
        F.lit("😂").alias("emoji"))
    (row,) = plans.curate(hot).collect()
    assert row.seq == 0


def test_random_order_is_reproducible(spark):
    seeds = seed_samples(spark)
    a = [r.text for r in plans.curated_in_random_order(seeds).collect()]
    b = [r.text for r in plans.curated_in_random_order(seeds.repartition(7)).collect()]
    assert a == b and a != sorted(a)


def test_union_and_align(spark):
    a = spark.createDataFrame([(1, "x")], "id int, p string")
    b = spark.createDataFrame([(2, "y")], "id int, q string")
    got = lookups.union_widened(a, b).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "x", None), (2, None, "y")]
    both = lookups.align(a, b.union(b.withColumn("id", F.lit(1))), "id").orderBy("id").collect()
    assert [(r.in_left, r.in_right) for r in both] == [(True, True), (False, True)]


def test_duplicate_keys_fail(spark):
    a = spark.createDataFrame([(1, "x"), (1, "z")], "id int, p string")
    b = spark.createDataFrame([(1, "y")], "id int, q string")
    for left, right in ((a, b), (b, a)):
        with pytest.raises(Exception, match="more than one row for id = 1"):
            lookups.align(left, right, "id").collect()
    assert lookups.unique_rows(b, "id").collect() == b.collect()


def test_label_usage_keeps_unused_classes(spark):
    rows = spark.createDataFrame([(3,), (3,), (99,)], "label int")
    got = {r.label: r.n for r in lookups.label_usage(rows).collect()}
    assert len(got) == 20 and got[3] == 2 and sum(got.values()) == 2


def test_repeated_keys_fail_even_if_only_counted(spark):
    from glyphloom.operators.lookups import unique_rows

    for columns in ("k int, v int", "k int"):
        rows = spark.createDataFrame([(1, 2)[:len(columns.split(","))]] * 2, columns)
        with pytest.raises(Exception, match="more than one row"):
            unique_rows(rows, "k").count()
