import random
import re

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import neardup
from glyphloom.llm.components import components
from glyphloom.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Every pair of documents, from the definition."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    pairs = set()
    for i, own in enumerate(sets):
        for s in own:
            pairs.update((j, i) for j in where.setdefault(s, []))
            where[s].append(i)
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return {k: (len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows)}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute(rows)


def chain(n, seed):
    """Texts of 150 words, each with a few words of the one before replaced."""
    draw = random.Random(seed)
    words = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(words)
        for _ in range(draw.randrange(4)):
            words[draw.randrange(150)] = f"w{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_chains_of_near_copies(spark):
    texts = [t for seed in range(8) for t in chain(25, seed)]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_large_nodes_branch(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE_ROWS", 6)
    rows = list(enumerate(chain(60, 3) + chain(40, 4)))
    assert result(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("depth", (1, 2))
def test_nodes_large_to_the_end(spark, monkeypatch, depth):
    monkeypatch.setattr(neardup, "NODE_ROWS", 4)
    monkeypatch.setattr(neardup, "MAX_DEPTH", depth)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = chain(40, 6)
    for _ in range(60):  # some near copies of one text, some at the edge, some beyond
        own = list(words)
        for i in draw.sample(range(200), draw.randrange(9)):
            own[i] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(own))
    draw.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, "another text of the third key"), (4, " ".join(words))]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_keys(rows)


def brute_keys(rows):
    """Smallest reachable key; rows of one key belong together."""
    sets = [shingles(t) for _, t in rows]
    label = {k: k for k, _ in rows}
    links = [(a[0], b[0]) for i, a in enumerate(rows) for j, b in enumerate(rows[:i])
             if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B\x0b"), (6, "a b c d e"),
            (7, "A B C D E"), (8, "a b c d e f"), (9, "a b"), (10, "x " * 50_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("x")).withColumn(
        "node", F.lit(1)).withColumn("id", F.lit(2))
    got = near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(got) == brute(rows)
    assert {r.doc_id for r in got.where("not kept").collect()} == {5, 7}


def test_repeated_and_null_keys(spark):
    rows = [(1, "a b"), (1, "c d"), (2, "c d"), (3, "a b"), (None, "a b")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    label = {x: x for link in links for x in link}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: label[x] for x in nodes}
    assert len(got) == len(nodes)


@pytest.mark.parametrize("threshold, trees", (((85, 100), 8), ((80, 100), 10)))
def test_recall_follows_the_threshold(threshold, trees):
    s = threshold[0] / threshold[1]
    assert neardup.trees(s) == trees and neardup.branches(s) * s > 1
    assert neardup.margin(s) == pytest.approx(4.5 * (s * (1 - s) / neardup.SLOTS) ** 0.5)
