import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphloom.operators import baseline, features, scoring
from glyphloom.plans.prediction import predict_records

TEXTS = ["Red red blue", "blue sky blue sky", "", "x", "green", "red sky at night"]


def _terms(text, n=2):
    words = re.findall(r"\w{2,}", text.lower())
    return words + ([" ".join(p) for p in zip(words, words[1:])] if n == 2 else [])


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def test_term_rows(rows):
    got = {(r.id, r.term): r.tf for r in features.term_rows(rows, "id", "text").collect()}
    assert got == {(i, t): n for i, s in enumerate(TEXTS) for t, n in Counter(_terms(s)).items()}


def test_vocabulary_breaks_ties_by_term(rows):
    totals = Counter(t for s in TEXTS for t in _terms(s))
    best = sorted(totals, key=lambda t: (-totals[t], t))
    for size in (1, 3, 5, 100):
        got = features.fit_vocabulary(rows, "id", "text", size).orderBy("rank").collect()
        assert [r.term for r in got] == best[:size]
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    df = Counter(t for s in TEXTS for t in set(_terms(s)))
    for r in got:
        assert (r.corpus_count, r.doc_count) == (totals[r.term], df[r.term])
        assert r.idf == pytest.approx(math.log((1 + len(TEXTS)) / (1 + df[r.term])) + 1)


def test_frequency_floor_keeps_exactly_the_best(spark):
    counts = spark.range(1, 5000).select(
        F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("term"),
        (F.lit(10000) / F.col("id")).cast("long").alias("corpus_count"),
        F.lit(1).cast("long").alias("doc_count"))
    got = [r.term for r in features.top_terms(counts, 777).orderBy("rank").collect()]
    assert got == [f"t{i:05d}" for i in range(1, 778)]


def test_weights_have_length_one(rows):
    vocabulary = features.fit_vocabulary(rows, "id", "text", 6)
    weights = features.tfidf_weights(rows, "id", "text", vocabulary)
    idf = {r.term: r.idf for r in vocabulary.collect()}
    got = {(r.id, r.term): r.weight for r in weights.collect()}
    for i, text in enumerate(TEXTS):
        raw = {t: n * idf[t] for t, n in Counter(_terms(text)).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        for term, w in raw.items():
            assert got.pop((i, term)) == pytest.approx(w / norm)
    assert not got


@pytest.mark.parametrize("partitions", [1, 8])
def test_encode_lengths(spark, partitions):
    lengths = [0, 1, 255, 256, 257, 3000]
    rows = spark.createDataFrame(
        [(n, " ".join(["aa", "bb"] * (n // 2) + ["cc"] * (n % 2))) for n in lengths],
        "id int, text string").repartition(partitions)
    vocabulary = features.fit_vocabulary(rows, "id", "text", 2, n=1)
    got = {r.id: r for r in features.encode_fixed(rows, "id", "text", vocabulary).collect()}
    for n in lengths:
        r = got[n]
        words = (["aa", "bb"] * (n // 2) + ["cc"] * (n % 2))[:256]
        # the two commonest terms have ids 2 and 3, all others 1
        ids = [{"aa": 2, "bb": 3}.get(w, 1) for w in words]
        assert r.input_ids == ids + [0] * (256 - len(ids)) == r.labels
        assert r.attention_mask == [1] * len(ids) + [0] * (256 - len(ids))
        assert (r.n_tokens, r.truncated) == (n, n > 256)


@pytest.mark.parametrize("bound", [1, 3, 100])
def test_vocabulary_size_decides_the_join(spark, monkeypatch, bound):
    rows = spark.createDataFrame(
        [(0, "aa bb cc dd ee"), (1, "aa bb cc"), (2, "aa zz bb"), (3, "")], "id int, text string")
    vocabulary = features.fit_vocabulary(rows, "id", "text", 5, n=1)

    def results():
        encoded = features.encode_fixed(rows, "id", "text", vocabulary, 8)
        weights = features.tfidf_weights(rows, "id", "text", vocabulary, n=1)
        return sorted(map(tuple, encoded.collect())), sorted(map(tuple, weights.collect()))

    expected = results()
    monkeypatch.setattr(features, "BROADCAST_ROWS", bound)
    assert results() == expected


def test_weights_need_one_exchange(spark):
    rows = spark.createDataFrame([(0, "aa bb"), (1, "aa")], "id int, text string")
    vocabulary = features.fit_vocabulary(rows, "id", "text", 5, n=1)
    plan = features.tfidf_weights(rows, "id", "text", vocabulary, n=1)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1


def test_predictions_keep_columns(spark):
    rows = spark.createDataFrame(
        [(2**60 + 1, "hi", 5, None), (2, None, None, "x")], "id long, text string, n long, s string")

    def make():
        return lambda prompts: [None if p is None else f'{{"primary": "🔥", "tone": "{len(p)}"}}' for p in prompts]

    got = {r.id: r for r in predict_records(rows, make).collect()}
    assert (got[2**60 + 1].n, got[2**60 + 1].s, got[2**60 + 1].primary) == (5, None, "🔥")
    assert (got[2].text, got[2].n, got[2].s, got[2].parse_success) == (None, None, "x", False)


def test_scoring_batches_do_not_matter(spark):
    def make():
        seen = []

        def predict(texts):
            seen.append(1)
            return [t.upper() for t in texts]
        return predict

    rows = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    expected = {(r.id, r.text.upper()) for r in rows.collect()}
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = scoring.score_table(rows, make)
        assert {tuple(r) for r in got.collect()} == expected
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.schema.simpleString() == "struct<id:bigint,raw:string>"


def test_baseline_learns(spark):
    words = ["sun warm bright", "rain cold grey", "snow ice white"]
    rows = spark.range(120).select(
        "id", (F.col("id") % 3).cast("int").alias("label"),
        F.concat(F.get(F.array(*[F.lit(w) for w in words]), (F.col("id") % 3).cast("int")),
                 F.lit(" noise"), (F.col("id") % 7).cast("string")).alias("text"))
    model = baseline.fit_baseline(rows, max_features=50, max_iter=50)
    got = model.predict(rows.withColumn("extra", F.lit(1)))
    assert got.columns == ["id", "label", "text", "extra", "pred_label", "pred"]
    assert got.where("label = pred_label").count() == 120
    assert {r.pred for r in got.select("pred").distinct().collect()} == {"❤️", "😍", "😂"}


def test_whole_vocabulary_has_every_rank_and_no_unknown(spark):
    words = [f"w{i:05d}" for i in range(60_000)]
    texts = [" ".join(words[i:i + 200]) for i in range(0, 60_000, 200)] + ["w59999 w59998 w59999", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    vocabulary = features.fit_vocabulary(rows, "id", "text", None, n=1)
    got = [r.term for r in vocabulary.orderBy("rank").collect()]
    assert got == ["w59999", "w59998", *words[:-2]]
    assert sorted(r["rank"] for r in vocabulary.collect()) == list(range(1, 60_001))
    encoded = features.encode_fixed(rows, "id", "text", vocabulary)
    assert encoded.where(F.array_contains("input_ids", features.UNKNOWN_ID)).count() == 0
    one = encoded.where("id = 300").first()
    assert one.input_ids[:4] == [2, 3, 2, 0]
