"""One registered query per operator, over the whole given tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import derived as D
from glyphloom import values as V
from glyphloom.functions import chat, parsing, text
from glyphloom.functions.labels import emoji_of
from glyphloom.operators import (
    baseline, conversations, curation, features, linear, lookups, metrics, sampling, scoring,
)
from glyphloom.plans import comparison, curation as curating, prediction, training_set as training
from glyphloom.session import stage, staging_folder
from glyphloom.sources import answers as answering, files
from glyphloom.sources.seeds import seed_samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return D.posts(spark, sf).select("post_id", "label", text.clean_text(F.col("raw")).alias("text"))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return text.where_length_ok(
        D.posts(spark, sf), "text", text.clean_text(F.col("raw"))
    ).drop("raw")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pair_counts(D.predictions(spark, sf))


#: the name of the fitted baseline's row in ``full_comparison``
BASELINE_MODEL = "tfidf_logreg"


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.parse_outputs(D.raw_outputs(spark, sf)).drop("raw")


def _new_folder(spark: SparkSession) -> str:
    return f"{staging_folder(spark).rstrip('/')}/glyphloom/{uuid.uuid4().hex}"


#: bytes of text in one written file, about
FILE_BYTES = 32 << 20


def _n_files(rows: DataFrame, least: int, *texts: str) -> int:
    """``least`` files, or as many more as keep a file, which one task sorts, at ``FILE_BYTES``."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0))
    return max(least, math.ceil((rows.agg(F.sum(size)).first()[0] or 0) / FILE_BYTES))


def _in_order(rows: DataFrame, n_files: int, *order: str) -> DataFrame:
    """Rows dealt to files so that these, by path, hold them in order."""
    return rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order)


# --- sources and lookups ---

@query
def aligned_files(spark, sf):
    line = F.translate(F.concat_ws(" ", "post_id", "raw"), "\r", " ")
    posts = D.posts(spark, sf).select("post_id", "label", line.alias("line"))
    texts, labels = _new_folder(spark), _new_folder(spark)
    n_files = _n_files(posts, 3, "line")
    _in_order(posts, max(7, n_files), "post_id", "line").select("line").write.text(texts)
    _in_order(posts, n_files, "post_id", "line").select(F.col("label").cast("string")).write.text(labels)
    return files.aligned_lines(spark, texts, labels)


@query
def samples_from_files(spark, sf):
    folder = _new_folder(spark)
    samples = D.samples(spark, sf)
    files.write_samples(_in_order(samples, _n_files(samples, 5, "text"), "seq", "text").drop("seq"), folder)
    return files.read_samples_if_present(spark, folder, lines=True)


@query
def aligned_labels(spark, sf):
    documents = D.table(spark, sf, "documents").select("doc_id", "lang")
    labels = D.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return lookups.align(documents, labels, "doc_id")


@query
def label_dimension(spark, sf):
    return lookups.label_usage(D.posts(spark, sf))


@query
def label_to_emoji(spark, sf):
    return lookups.with_emoji(D.posts(spark, sf).select("post_id", "label"))


@query
def emoji_to_label(spark, sf):
    return lookups.with_label(D.samples(spark, sf).select("seq", "emoji"))


@query
def parse_answer_batches(spark, sf):
    return answering.answer_samples(answering.parse_answers(D.answers(spark, sf)))


@query
def answer_counts(spark, sf):
    return answering.answer_counts(answering.parse_answers(D.answers(spark, sf)))


@query
def union_widen(spark, sf):
    posts = lookups.with_emoji(_cleaned(spark, sf)).withColumnRenamed("post_id", "id")
    extra = lookups.with_label(D.samples(spark, sf)).withColumnRenamed("seq", "id")
    return lookups.union_widened(posts, extra)


# --- text rules ---

@query
def clean_text(spark, sf):
    return _cleaned(spark, sf).select("post_id", "text")


@query
def clean_documents(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", text.clean_text(F.col("text")).alias("text")
    )


@query
def length_filter(spark, sf):
    return _kept(spark, sf).select(
        "post_id", "text", F.length("text").cast("long").alias("n_chars")
    )


@query
def irony_rule(spark, sf):
    t = F.col("text")
    return _cleaned(spark, sf).select(
        "post_id", text.contains_any(t, V.IRONY_WORDS).alias("irony_word"),
        text.contains_any(t, V.NEGATIVE_WORDS).alias("negative"), text.irony_rule(t).alias("irony"),
    )


@query
def training_target(spark, sf):
    rows = lookups.with_emoji(_kept(spark, sf))
    return rows.select(
        "post_id", "text", "emoji",
        chat.training_target(F.col("emoji"), F.col("text")).alias("target"),
    )


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookups.with_emoji(_kept(spark, sf))
    return training.with_chat(rows).select("post_id", "messages")


@query
def chat_messages(spark, sf):
    def content(i: int, name: str):
        return F.get("messages", F.lit(i)).getField("content").alias(name)

    return _chats(spark, sf).select(
        "post_id", F.size("messages").cast("long").alias("n_messages"),
        content(0, "system"), content(1, "user"), content(2, "assistant"),
    )


@query
def render_chat(spark, sf):
    return _chats(spark, sf).select("post_id", chat.render_chat(F.col("messages")).alias("chat"))


@query
def render_turns(spark, sf):
    return D.table(spark, sf, "conversations").select(
        "conv_id", "turn", chat.render_message(F.col("role"), F.col("text")).alias("message")
    )


@query
def render_conversations(spark, sf):
    return conversations.render_conversations(D.table(spark, sf, "conversations"))


# --- parsing ---

@query
def strip_think(spark, sf):
    return D.raw_outputs(spark, sf).select("id", parsing.strip_think(F.col("raw")).alias("answer"))


@query
def extract_json(spark, sf):
    span = parsing.json_span(parsing.strip_fences(parsing.strip_think(F.col("raw"))))
    return D.raw_outputs(spark, sf).select("id", span.alias("span"))


@query
def scan_emoji(spark, sf):
    found = parsing.scan_emoji(F.col("raw"))
    return D.raw_outputs(spark, sf).select(
        "id", F.size(found).cast("long").alias("n_found"), F.array_join(found, "|").alias("found")
    )


@query
def parse_output(spark, sf):
    return _parsed(spark, sf).select("id", *parsing.PARSED)


def _rule_predictor():
    """Stands for a model: the length of a text decides the answer."""
    def answer(text: str) -> str:
        first, second = V.EMOJI[len(text) % 20], V.EMOJI[len(text) % 7]
        forms = (
            f'{{"primary": "{first}", "alternative": "{second}", "irony": true}}',
            f"I would say {first} or {second}",
            "no idea",
        )
        return forms[len(text) % 3]

    def predict(texts: pd.Series) -> list[str]:
        return [answer(t) for t in texts]

    return predict


@query
def score_and_parse(spark, sf):
    documents = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return parsing.parse_outputs(scoring.score_table(documents, _rule_predictor)).drop("raw")


@query
def predict_records(spark, sf):
    documents = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return prediction.predict_records(documents, _rule_predictor).drop("raw")


# --- curation and sampling ---

@query
def quality_filter(spark, sf):
    return curation.quality_filter(D.samples(spark, sf))


@query
def dedupe_first(spark, sf):
    return curation.dedupe_first(
        curation.quality_filter(D.samples(spark, sf)), F.lower("text"), "seq"
    )


@query
def type_distribution(spark, sf):
    return curation.type_distribution(curating.curate(D.samples(spark, sf)))


@query
def curated_set(spark, sf):
    return curating.curated_in_random_order(
        seed_samples(spark), D.samples(spark, sf), D.extra(spark, sf)
    )


@query
def sample_exact(spark, sf):
    kept = stage(_kept(spark, sf).select("post_id", "label"))
    return sampling.sample_exact(kept, "post_id", 1000)


@query
def train_val_split(spark, sf):
    kept = stage(_kept(spark, sf).select("post_id", "label"))
    return sampling.train_val_split(kept, "post_id")


@query
def shuffle_rank(spark, sf):
    return sampling.shuffle_position(_cleaned(spark, sf).select("post_id", "label"), "post_id")


@query
def training_set(spark, sf):
    rows = training.build_training_set(D.posts(spark, sf), D.extra(spark, sf), n=None)
    return rows.withColumn("n_messages", F.size("messages").cast("long")).drop("messages")


@query
def variant_counts(spark, sf):
    rows = training.dataset_variants(D.posts(spark, sf), D.extra(spark, sf))
    return rows.groupBy("variant", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"),
        F.sum(F.length("text").cast("long")).alias("chars"),
    )


@query
def variant_chats(spark, sf):
    rows = training.variants_with_chat(training.dataset_variants(D.posts(spark, sf), D.extra(spark, sf)))
    listed = F.col("messages")[0]["content"].contains(" ".join(V.EMOJI[:2]))
    length = F.length(chat.render_chat(F.col("messages"))).cast("long")
    return rows.select("variant", listed.alias("listed"), length.alias("l")).groupBy(
        "variant", "listed").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("chars"))


@query
def stage_counts(spark, sf):
    posts = training.stage_counts(D.posts(spark, sf), D.extra(spark, sf))
    only = (training.Variant("only"),)
    posts = posts.union(training.set_counts(
        training.dataset_variants(D.posts(spark, sf), D.extra(spark, sf), only)))
    curated = curating.curation_counts(D.samples(spark, sf), D.extra(spark, sf))
    return posts.select(F.lit("posts").alias("flow"), "stage", "n").union(
        curated.select(F.lit("samples"), "stage", "n")
    )


# --- features and baseline ---

@query
def tokens(spark, sf):
    words = text.tokens(F.col("text"))
    return D.table(spark, sf, "documents").select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("words")
    )


@query
def ngrams(spark, sf):
    words = text.ngrams(text.tokens(F.col("text")))
    return D.table(spark, sf, "documents").select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_terms"), F.array_join("w", "|").alias("terms")
    )


@query
def term_counts(spark, sf):
    return features.term_rows(D.table(spark, sf, "documents"), "doc_id", "text", n=1)


TOP_TERMS = 2000  # of the top-k report alone


def _vocabulary(spark: SparkSession, sf: str, n: int, terms: int | None = V.MAX_FEATURES) -> DataFrame:
    return features.fit_vocabulary(
        D.table(spark, sf, "documents"), "doc_id", "text", terms, n
    )


@query
def vocabulary_topk(spark, sf):
    vocabulary = _vocabulary(spark, sf, 2, TOP_TERMS)
    return vocabulary.select(
        "term", "corpus_count", "doc_count", F.col("rank").cast("long").alias("rank"), *_six("idf")
    )


@query
def tfidf_weights(spark, sf):
    weights = features.tfidf_weights(
        D.table(spark, sf, "documents"), "doc_id", "text", _vocabulary(spark, sf, 2)
    )
    return weights.select("doc_id", "term", *_six("weight"))


@query
def encode_fixed(spark, sf):
    encoded = features.encode_fixed(
        D.table(spark, sf, "documents"), "doc_id", "text", _vocabulary(spark, sf, 1, None),
    )

    return _readable(encoded, "doc_id")


def _readable(encoded: DataFrame, *keys: str) -> DataFrame:
    """Encoded columns with their lists as text."""
    def joined(name: str):
        return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)

    return encoded.select(
        *keys, F.col("n_tokens").cast("long").alias("n_tokens"), "truncated",
        joined("input_ids"), joined("attention_mask"), joined("labels"),
    )


@query
def encoded_training_set(spark, sf):
    rows = training.build_training_set(D.posts(spark, sf), D.extra(spark, sf), n=None)
    return _readable(training.encode_training_set(rows), "split", "row_key")


@query
def baseline_predictions(spark, sf):
    rows = sampling.train_val_split(D.labelled_documents(spark, sf), "id", eager=True)
    train = rows.where("split = 'train' and label is not null")
    model = baseline.fit_baseline(train, max_iter=1000, tol=1e-6)
    return model.predict(rows).select("id", "split", "label", "pred_label", "pred")


@query
def baseline_certificate(spark, sf):
    """Per split: rows, labelled rows, the commonest training class's accuracy, and two checks.

    ``beats_majority``: predictions by join with the model's tables are right more
    often than the commonest class; ``converged``: the gradient at the fit (1,000
    iterations allowed) is certified below ``linear.TOLERANCE`` of that at zero.
    """
    rows = sampling.train_val_split(D.labelled_documents(spark, sf), "id", eager=True)
    train = rows.where("split = 'train' and label is not null")
    model = baseline.fit_baseline(train, max_iter=1000, tol=1e-6)
    tables = linear.as_tables(model, spark)
    certified = linear.certify(train, tables).holds()
    top = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    commonest = F.lit(top["label"] if top else None).cast("int")
    predicted = linear.predict_by_join(rows, tables, ["split", "label"])

    def right(guess):
        return F.avg(F.when(F.col("label").isNotNull(), (F.col("label") == guess).cast("double")))

    return predicted.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("label").alias("n_labelled"),
        right(commonest).alias("majority_accuracy"), right(F.col("pred_label")).alias("accuracy"),
    ).select(
        "split", "n_rows", "n_labelled", F.round("majority_accuracy", 6).alias("majority_accuracy"),
        (F.col("accuracy") > F.col("majority_accuracy")).alias("beats_majority"),
        F.lit(certified).alias("converged"),
    )


# --- metrics ---

@query
def pair_predictions(spark, sf):
    both = D.predictions(spark, sf)
    truths = D.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), D.truth_of(F.col("doc_id")).alias("truth")
    )
    return metrics.pair_predictions(both.drop("truth"), truths)


@query
def reconcile_predictions(spark, sf):
    truths = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return metrics.reconcile(D.predictions(spark, sf), truths)


@query
def pair_similarity(spark, sf):
    return metrics.pair_scores(_pairs(spark, sf)).withColumn(
        "hundredths", F.col("hundredths").cast("long")
    )


@query
def exact_accuracy(spark, sf):
    return metrics.accuracy(_pairs(spark, sf)).select("model", "n", *_six("accuracy"))


@query
def f1_scores(spark, sf):
    return metrics.f1_scores(_pairs(spark, sf)).select("model", *_six("f1_macro", "f1_weighted"))


@query
def class_report(spark, sf):
    return metrics.class_report(_pairs(spark, sf)).select(
        "model", "emoji", "tp", "fp", "fn", "support", *_six("precision", "recall", "f1")
    )


@query
def semantic_score(spark, sf):
    return metrics.semantic_score(_pairs(spark, sf)).select("model", *_six("semantic_score"))


@query
def sentiment_consistency(spark, sf):
    return metrics.sentiment_consistency(_pairs(spark, sf)).select("model", *_six("sentiment_acc"))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_pairs(spark, sf))


@query
def confusion_wide(spark, sf):
    return metrics.confusion_wide(metrics.confusion_matrix(_pairs(spark, sf)))


@query
def similarity_histogram(spark, sf):
    return metrics.similarity_histogram(_pairs(spark, sf)).select(
        "model", *[F.col(c).cast("long").alias(c) for c in ("bin", "low", "high", "n")],
        *_six("percent"),
    )


@query
def parse_rate(spark, sf):
    return metrics.parse_rate(_parsed(spark, sf)).select("model", *_six("json_parse_success_rate"))


@query
def alternative_score(spark, sf):
    return metrics.alternative_score(_parsed(spark, sf)).select(
        "model", *_six("alternative_semantic_score")
    )


@query
def irony_accuracy(spark, sf):
    return metrics.irony_accuracy(_parsed(spark, sf), D.annotated(spark, sf)).select(
        "model", "n_annotated", *_six("irony_detection_accuracy")
    )


@query
def model_comparison(spark, sf):
    outputs = _parsed(spark, sf)
    answered = outputs.select("model", "truth", F.col("primary").alias("pred"))
    paired = D.predictions(spark, sf).select("model", "truth", "pred").union(answered)
    table = comparison.compare_models(paired, outputs, D.annotated(spark, sf))
    return table.select("model", *_six(*comparison.METRICS))


@query
def full_comparison(spark, sf):
    """``model_comparison`` with the reference's fourth row: TF-IDF and logistic regression.

    The baseline is fitted on the training split of the labelled documents (1,000
    iterations allowed) and predicts the validation split by join with its tables;
    truths and predictions become emoji, so its row is scored like the others.  The
    generation metrics of that row are null, as it writes no text.
    """
    rows = sampling.train_val_split(D.labelled_documents(spark, sf), "id", eager=True)
    train = rows.where("split = 'train' and label is not null")
    tables = linear.as_tables(baseline.fit_baseline(train, max_iter=1000, tol=1e-6), spark)
    held = linear.predict_by_join(rows.where("split = 'val' and label is not null"), tables, ["label"])
    fitted = held.select(F.lit(BASELINE_MODEL).alias("model"), emoji_of(F.col("label")).alias("truth"),
                         emoji_of(F.col("pred_label")).alias("pred"))
    outputs = _parsed(spark, sf)
    answered = outputs.select("model", "truth", F.col("primary").alias("pred"))
    paired = D.predictions(spark, sf).select("model", "truth", "pred").union(answered).union(fitted)
    table = comparison.compare_models(paired, outputs, D.annotated(spark, sf))
    return table.select("model", *_six(*comparison.METRICS))


@query
def parse_and_score(spark, sf):
    table = comparison.score_raw_outputs(D.raw_outputs(spark, sf), D.annotated(spark, sf))
    return table.select("model", *_six(*comparison.METRICS))


@query
def comparison_report(spark, sf):
    folder = _new_folder(spark)
    files.write_report(model_comparison(spark, sf), folder)
    return files.read_report(spark, folder)
