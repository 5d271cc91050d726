import hashlib
import random

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import suffixdedup
from glyphloom.llm.suffixdedup import remove_repeats

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    """Kept bytes and removed runs, from every string of that length."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for t in data:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, kept))
    return out


def result(frame, key="doc_id"):
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in frame.orderBy(key).collect()]


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    want = brute(texts, 400)
    assert result(remove_repeats(docs)) == want
    assert any(x[1] for x in want)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_shared_passages_and_edits(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "NAME_ROWS", hot)
    draw = random.Random(hot)
    word = lambda: "".join(draw.choices("abcdé", k=draw.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(60):
        own = [" ".join(word() for _ in range(draw.randrange(30))) for _ in range(3)]
        text = own[0] + draw.choice(passages)[draw.randrange(9):] + own[1] + draw.choice(passages) + own[2]
        texts.append(text)
        if draw.random() < 0.3:
            at = draw.randrange(len(text))
            texts.append(text[:at] + "X" + text[at:])
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert result(remove_repeats(docs, length=40)) == brute(texts, 40)


def test_odd_rows(spark):
    texts = [None, "", "é" * 300, "a" * 399, "a" * 401, "b" * 400, "c" * 400, "c" * 400, "xy" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("name", F.lit(5)).withColumn(
        "kept", F.lit(6)).withColumn("spans", F.lit(7))
    got = remove_repeats(docs)
    assert got.columns == ["doc_id", "name", "spans", "n_bytes", "n_removed", "n_spans", "kept"]
    assert result(got) == brute(texts, 400)


def test_repeated_and_null_keys(spark):
    long_text = "".join(random.Random(3).choices("abcdefgh", k=700))
    rows = [(1, long_text), (1, long_text), (None, "z" + long_text), (2, "q" * 10), (2, None)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [
        (0, 701, 700), (1, 700, 700), (1, 700, 700), (2, 0, 0), (2, 10, 0)]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_hashes_the_kept_bytes(spark, sf_dir):
    from glyphloom.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = [hashlib.sha256(x[3]).hexdigest() for x in brute([r.text for r in rows], 400)]
    got = QUERIES["op4_suffix_dedup"](spark, sf_dir).orderBy("doc_id").collect()
    assert [r.kept_sha256 for r in got] == want
