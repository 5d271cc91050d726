import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import mixing
from glyphloom.llm.mixing import mix_copies, mix_documents
from glyphloom.llm.packing import best_bounds, length_bin, pack

SCHEMA = "doc_id long, text string, source string"


def targets(sizes):
    """Share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, got, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-6 and open_:
        total = sum(weight[s] for s in open_)
        more = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            got[s] += more[s]
            if got[s] >= 3 * sizes[s]:
                left += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
                open_.discard(s)
    return got


def check(rows, got):
    size = {k: len(re.findall("[^\x20\x09-\x0D]+", t or "")) for k, t, _ in rows}
    by = defaultdict(int)
    for k, _, s in rows:
        by[s] += size[k]
    want, taken = targets(by), defaultdict(int)
    assert sum(r.n for r in got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 3
        assert r.source_size == by[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.n * r.size * r.copies
    for s in by:
        assert abs(taken[s] - want[s]) <= max((size[k] for k, _, x in rows if x == s), default=0)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mix_copies(docs).collect()
    check(rows, got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_copies(docs.repartition(3)).collect()), key=str)


@pytest.mark.parametrize("fan", [2, 64])
def test_hot_source_and_odd_rows(spark, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    draw = random.Random(fan)
    rows = [(i, "w " * draw.randrange(40), draw.choice("aaaaabcdé𝒳")) for i in range(150)]
    rows += [(900, None, "a"), (901, "", "empty"), (902, "x " * 3000, None), (903, "q", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1)).withColumn("s", F.lit(2))
    got = mix_copies(docs).collect()
    check(rows, got)
    mixed = Counter(r.doc_id for r in mix_documents(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mix_documents(docs).columns == docs.columns


def test_probabilities_stay(spark, monkeypatch):
    """Over many seeds every document of a source is taken equally often."""
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 7 < 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain, counts, runs = mixing._draw, Counter(), 25
    for seed in range(runs):
        monkeypatch.setattr(mixing, "_draw", lambda level, *parts, s=seed: plain(level + 100 * s, *parts))
        got = mix_copies(docs).collect()
        counts.update({r.doc_id: r.copies for r in got})
    for s in "ab":
        own = [counts[k] / runs for k, _, x in rows if x == s]
        want = next(r.target / r.source_size for r in got if r.source == s)
        assert abs(np.mean(own) - want) < 0.05 and max(own) - min(own) < 0.75


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, "a", "t")]
    got = mix_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.n) for r in got} == {(1, 2), (2, 1)}
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_copies(empty).collect() == [] and pack(empty).collect() == []


def test_bounds_are_optimal():
    draw = random.Random(5)
    for _ in range(20):
        sizes = sorted(draw.sample(range(1, 60), 7))
        counts = [draw.randrange(1, 9) for _ in sizes]

        def padded(bounds):
            return sum(c * min(b for b in bounds if b >= s) for s, c in zip(sizes, counts))

        from itertools import combinations
        best = min(padded(b + (sizes[-1],)) for k in range(3) for b in combinations(sizes[:-1], k))
        assert padded(best_bounds(np.array(counts), np.array(sizes), 3)) == best


def test_batches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "w " * 50_000), (5, "a")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra).withColumn("bin", F.lit("clash"))
    rows = pack(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r.n_words for r in rows) == sorted(
        len(re.findall("[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    batches = defaultdict(list)
    for r in rows:
        assert r.n_words <= r.bound
        batches[r.bucket, r.shard, r.batch].append(r)
    for own in batches.values():
        assert len({r.bound for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].bound <= 32_768
    assert len({r.bucket for r in rows}) <= 16


def test_length_bins_are_bounded(spark):
    rows = spark.range(0, 3_000_000, 7).select(F.col("id").alias("n"), length_bin(F.col("id")).alias("bin"))
    assert rows.select("bin").distinct().count() < 1_025 + 64 * 12
    spread = rows.where("n > 1024").groupBy("bin").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    assert spread.where("b > a * 1.02").isEmpty()
