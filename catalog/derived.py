"""Task-shaped tables derived from the given ones, in Spark and in SQL.

The given texts hold hardly any mentions, links, hashtags or emoji, so posts get
suffixes and answers get wrapped in the forms a model produces, by row number.
Each table covers all rows of its source; ``catalog.oracle`` has the same
definitions for the SQL engine the results are checked with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.sources.answers import answer_samples, parse_answers

OUTSIDE = "🙄"
FOREIGN = "☠"

SUFFIXES = {
    1: " www.ex.org/x @josé_9 hi",
    2: " #été2 ##tag #",
    3: "\u00a0\u2028 @ home\t",
    4: " Great, my flight got CANCELLED",
    5: " I love chocolate",
    6: " a@b.com &amp; so",
}
LINK = " http://t.co/a"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.

    A scan has no more tasks than the files have row groups.  A small file would
    leave cores idle, so its rows are spread; a large one already has more scan
    tasks than there are cores and is left alone.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def emoji_at(index: Column) -> Column:
    """The emoji with that 0-based number, null past the end."""
    return F.get(F.array(*[F.lit(e) for e in V.EMOJI]), index.cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n, line, post_id``: one row per line of each document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")
    ).withColumn("post_id", F.col("doc_id") * 100000 + F.col("n"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``post_id, label, raw``."""
    doc, n = F.col("doc_id"), F.col("n")
    kind = (doc + n) % 9
    suffix = F.when(kind == 0, F.concat(F.lit(LINK), F.col("post_id").cast("string")))
    for k, text in SUFFIXES.items():
        suffix = suffix.when(kind == k, text)
    return lines(spark, sf_dir).select(
        "post_id", ((doc * 7 + n) % 21).cast("int").alias("label"),
        F.concat("line", suffix.otherwise("")).alias("raw"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, text, emoji, type, true_sentiment``: one per line."""
    doc, n, post = F.col("doc_id"), F.col("n"), F.col("post_id")
    kind, mood = F.lit(None), F.lit(None)
    for k, name in enumerate(V.SAMPLE_TYPES):
        kind = F.when(post % 6 == k, name).otherwise(kind)
    for k, name in enumerate(("positive", "negative", "mixed")):
        mood = F.when(post % 4 == k, name).otherwise(mood)
    return lines(spark, sf_dir).select(
        post.alias("seq"), F.col("line").alias("text"),
        F.coalesce(emoji_at((doc * 7 + n) % 21), F.lit(OUTSIDE)).alias("emoji"),
        kind.cast("string").alias("type"), mood.cast("string").alias("true_sentiment"),
    )


def truth_of(doc: Column) -> Column:
    """Skewed truth: class 0 for over half of the rows, the last class never."""
    return emoji_at(F.when(doc % 40 < 19, doc % 40).otherwise(0))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, id, truth, pred``: three models on every document."""
    doc = F.col("doc_id")
    per_model = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m")
    )
    k = (doc * (F.col("m") * 2 + 3) + F.col("n_chars")) % 23
    truth = truth_of(doc)
    pred = (
        F.when(k == 22, V.NO_ANSWER).when(k < 6, truth).when(k < 20, emoji_at(k))
        .otherwise(FOREIGN)
    )
    return per_model.select(
        F.concat(F.lit("model"), F.col("m").cast("string")).alias("model"),
        doc.alias("id"), truth.alias("truth"), pred.alias("pred"),
    )


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, id, truth, raw``: one answer per document in 14 forms."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", emoji_at(doc % 20).alias("p"), emoji_at((doc * 7 + 3) % 20).alias("a")
    )
    raw = F.lit("")
    for kind, form in enumerate(FORMS):
        text = F.replace(F.replace(F.lit(form), F.lit("<P>"), F.col("p")), F.lit("<A>"),
                         F.col("a"))
        raw = F.when(doc % 14 == kind, text).otherwise(raw)
    return docs.select(
        F.lit("tuned").alias("model"), doc.alias("id"), truth_of(doc).alias("truth"),
        raw.alias("raw"),
    )


FORMS = (
    '{"tone": "t", "irony": true, "primary": "<P>", "alternative": "<A>", "reason": "r"}',
    '```json\n{"primary": "<P>", "irony": false}\n```',
    '<think>a\n{"x"</think> {"primary": " <P> ", "alternative": "zz", "irony": "false"}',
    '{"primary": "<P>"',
    "I pick <P><A> now",
    "no answer",
    '{"primary": "happy", "alternative": "<A>"}',
    '{"primary": null, "alternative": "<A>", "irony": 1}',
    '{"primary": "<P>"} or {"primary": "<A>"}',
    'Sure! {"primary": "<P>", "irony": 0, "alternative": ""} ok',
    '<think>open {"primary": "<P>", "irony": []}',
    '{"primary": "happy", "reason": "<P><A><P>"}',
    '{"primary": 5, "irony": null}',
    "",
)

ANSWERS = (
    '[{"text": "post <ID> is just fine", "emoji": "<P>", "type": "irony", '
    '"true_sentiment": "mixed"}, {"text": "ok", "emoji": "🙄"}]',
    '```json\n[{"text": "fenced post <ID50>", "emoji": "<P>"}]\n```',
    '[{"text": "cut off',
    '{"text": "an object"}',
    "[]",
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch_id, answer``: one generated answer per document in 5 forms."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", emoji_at(doc % 20).alias("p")
    )
    answer = F.lit("")
    for kind, form in enumerate(ANSWERS):
        text = F.lit(form)
        for mark, value in (("<ID50>", (doc % 50).cast("string")),
                            ("<ID>", doc.cast("string")), ("<P>", F.col("p"))):
            text = F.replace(text, F.lit(mark), value)
        answer = F.when(doc % 5 == kind, text).otherwise(answer)
    return docs.select(doc.alias("batch_id"), answer.alias("answer"))


def extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, text, emoji, type, true_sentiment``: the samples in the answers."""
    parsed = answer_samples(parse_answers(answers(spark, sf_dir)))
    return parsed.select(
        (F.col("batch_id") * 10 + F.col("pos")).alias("seq"),
        "text", "emoji", "type", "true_sentiment",
    )


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, type`` for the documents with labels."""
    kind = (
        F.when(F.col("toxic") == 1, "sarcasm").when(F.col("quality") == 0, "dark_humor")
        .otherwise("bittersweet")
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), kind.alias("type"))


LANGUAGES = ("en", "fr", "de", "es")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, label``: documents with the number of their language."""
    label = F.lit(None).cast("int")
    for n, lang in enumerate(LANGUAGES):
        label = F.when(F.col("lang") == lang, n).otherwise(label)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", label.alias("label")
    )
