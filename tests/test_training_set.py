import hashlib
import math

import pytest
from pyspark.sql import functions as F

from glyphloom.plans import training_set as T
from glyphloom.plans.training_set import Variant


@pytest.fixture()
def posts(spark):
    return spark.range(300).select(
        F.col("id").alias("post_id"),
        F.concat(F.lit("  post number "), F.col("id").cast("string"), F.lit(" @someone"))
        .alias("raw"), (F.col("id") % 21).cast("int").alias("label"),
    ).union(spark.createDataFrame([(900, "short", 1), (901, "x" * 281, 1)],
                                  "post_id long, raw string, label int"))


@pytest.fixture()
def extra(spark):
    return spark.createDataFrame(
        [(0, "tiny", "😂", "irony", "mixed"), (1, "off list emoji here", "💀", "slang", "mixed")],
        "seq long, text string, emoji string, type string, true_sentiment string")


def _draw(key):
    return hashlib.md5(f"42:{key}".encode()).hexdigest()


@pytest.mark.parametrize("staged", [True, False])
def test_training_set(posts, extra, staged):
    got = {r.row_key: r for r in T.build_training_set(posts, extra, n=50, staged=staged).collect()}
    expected = sorted((f"post:{i}" for i in range(300)), key=_draw)[:50] + ["extra:0", "extra:1"]
    assert set(got) == set(expected)
    val = sorted(expected, key=lambda k: _draw(f"split:{k}"))[:math.ceil(0.1 * 52)]
    assert {k for k, r in got.items() if r.split == "val"} == set(val)
    # extra samples skip the length filter; an unlisted emoji gets the default second choice
    assert (got["extra:0"].text, got["extra:0"].label) == ("tiny", 2)
    assert got["extra:1"].label == -1 and '"alternative": "😊"' in got["extra:1"].target
    for key, r in got.items():
        if key.startswith("post:"):
            number = int(key[5:])
            assert r.text == f"post number {number} @user" and r.type is None
            assert (r.emoji is None) == (r.target is None) == (number % 21 == 20)
            assert len(r.messages) == (2 if r.target is None else 3)


def test_sample_size_at_or_above_rows_keeps_all(posts):
    for n in (None, 0, 300, 5000):
        assert T.build_training_set(posts, n=n, staged=False).count() == 300


def test_variants(posts, extra):
    variants = (*T.STANDARD_VARIANTS, Variant("ten", extra=False, n=10))
    rows = T.dataset_variants(posts, extra, variants)
    counts = {}
    for r in rows.groupBy("variant", "split").count().collect():
        counts.setdefault(r.variant, {})[r.split] = r["count"]
    assert counts == {
        "full": {"val": 31, "train": 271}, "no_extra": {"val": 30, "train": 270},
        "no_constraint": {"val": 31, "train": 271}, "half": {"val": 16, "train": 136},
        "ten": {"val": 1, "train": 9},
    }
    chats = T.variants_with_chat(rows, variants)
    listed = chats.select(
        "variant", F.col("messages")[0]["content"].contains("📸").alias("listed")).distinct()
    assert {r.variant: r.listed for r in listed.collect()} == {
        "full": True, "no_extra": True, "no_constraint": False, "half": True, "ten": True}


def test_stage_counts(posts, extra):
    got = {r.stage: r.n for r in T.stage_counts(posts, extra).collect()}
    assert got == {"read": 302, "kept": 300, "labelled": 286, "extra": 2}


def test_set_counts(posts, extra):
    rows = T.dataset_variants(posts, extra, (T.Variant("only", n=100),))
    got = {r.stage: r.n for r in T.set_counts(rows).collect()}
    assert got == {"sampled": 100, "union": 102, "train": 91, "val": 11}


def test_encoded_training_set(posts):
    rows = T.build_training_set(posts, n=20)
    encoded = T.encode_training_set(rows, max_length=64).collect()
    assert len(encoded) == 20 and {r.split for r in encoded} == {"train", "val"}
    assert all(len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 64 for r in encoded)
    # the rendered chat of a labelled post is longer, that of an unlabelled one is not
    assert all(r.truncated == (r.n_tokens > 64) for r in encoded)
    assert any(r.truncated for r in encoded)


def test_training_set_is_encoded_with_every_word(spark):
    words = [f"w{i}x" for i in range(50_400)]
    chats = [[("user", " ".join(words[i:i + 200]))] for i in range(0, len(words), 200)]
    rows = spark.createDataFrame(
        [("train", f"post:{i}", chat) for i, chat in enumerate(chats)],
        "split string, row_key string, messages array<struct<role string, content string>>")
    encoded = T.encode_training_set(rows)
    assert encoded.where(F.array_contains("input_ids", 1)).count() == 0
