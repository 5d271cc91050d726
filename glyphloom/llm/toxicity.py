"""Toxicity by a counterfactual-regularised linear classifier.

Features are the presence of hashed words and word starts.  Labelled texts that name a
group get a counterfactual in which the group is swapped for another of its kind; the
loss adds the squared change of the score, so that naming a group moves no decision.
Gradients are summed over the partitions of a bounded labelled sample; the driver sees
counts of features and one gradient a partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm import kernels as K
from glyphloom.session import stage

BUCKETS = 1 << 20
STARTS = (4, 5, 6)
#: labelled rows that fitting sees at most
SAMPLE_ROWS = 20_000
FEATURES = 4_096
LEAST_CHI = 15.0
STEPS = 40
RATE = 1.0
PENALTY = 1.0
RIDGE = 1e-4
SPLITS = 8
THRESHOLD = 0.7

#: kinds of groups; a swap takes the next term of the same kind
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight"),
    ("black", "white", "asian", "latino"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "refugees", "locals"), ("mexican", "chinese", "german", "french", "african", "american"),
    ("transgender", "lesbian", "bisexual", "heterosexual"), ("old", "young"), ("disabled", "deaf", "blind"),
)
NEXT = {a: b for kind in IDENTITY for a, b in zip(kind, kind[1:] + kind[:1])}
NEUTRAL = "people"
TERM = re.compile(rf"(?<![^\W_])({'|'.join(NEXT)})(?![^\W_])", re.IGNORECASE)

BETWEEN = np.ones(256, bool)
BETWEEN[97:123] = False
BETWEEN[128:] = False


@dataclass
class Toxic:
    """The model: feature buckets in order, their weights, and the offset."""

    buckets: np.ndarray
    weights: np.ndarray
    offset: float


def features(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``first row, buckets``: the distinct features of whole texts."""
    for row, data, offsets in K.pieces(texts):
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, BETWEEN)
        prefix = K.prefix_hash(data)
        kinds = [K.span_hash(prefix, starts, ends)]
        for k in STARTS:
            cut = np.where(ends - starts >= k, starts + k, starts)
            kinds.append(K.span_hash(prefix, starts, cut) * np.uint64(2 * k + 1))
        codes = (np.stack(kinds, 1) >> np.uint64(44)).astype(np.int32)
        yield row, [np.unique(codes[a:b]) for a, b in zip(first[:-1], first[1:])]


def swapped(text: str | None, neutral: bool = False) -> str | None:
    """The text with every group named replaced by the next of its kind, or by a neutral
    word; None if it names none."""
    if not text or not TERM.search(text):
        return None
    return TERM.sub(NEUTRAL if neutral else lambda m: NEXT[m[0].lower()], text)


def training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text, toxic`` to features of the text and of its counterfactual."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        # half of the texts, by a hash, meet the neutral word
        other = [swapped(t, crc32((t or "").encode()) % 2 == 0) for t in texts]
        own = [f for _, part in features(batch.column("text")) for f in part]
        turned = [f for _, part in features(pa.array([o or "" for o in other])) for f in part]
        yield pa.RecordBatch.from_arrays([
            batch.column("toxic"), pa.array([f.tolist() for f in own], pa.list_(pa.int32())),
            pa.array([f.tolist() if o else None for f, o in zip(turned, other)], pa.list_(pa.int32())),
        ], names=["toxic", "own", "turned"])


def _dense(lists: pa.Array, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, column`` of the chosen features that stand in the lists."""
    lists = lists.fill_null(pa.scalar([], lists.type)) if lists.null_count else lists
    flat, ends = K.flat_lists(lists)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at = np.searchsorted(buckets, flat)
    hit = (at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == flat)
    return row[hit], at[hit]


def gradients(model: Toxic, toxic_weight: float):
    """One row a partition: the gradient of the loss, offset last."""

    def run(batches):
        total = np.zeros(len(model.weights) + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.array(batch.column("toxic").to_pylist(), float)
            row, col = _dense(batch.column("own"), model.buckets)
            score = model.offset + np.bincount(row, model.weights[col], minlength=len(y))
            error = (1 / (1 + np.exp(-score)) - y) * np.where(y > 0, toxic_weight, 1.0)
            total[:-1] += np.bincount(col, error[row], minlength=len(model.weights))
            total[-1] += error.sum()
            paired = np.array([x is not None for x in batch.column("turned").to_pylist()])
            if paired.any():
                row2, col2 = _dense(batch.column("turned"), model.buckets)
                own = paired[row]
                change = (np.bincount(row[own], model.weights[col[own]], minlength=len(y))
                          - np.bincount(row2, model.weights[col2], minlength=len(y)))
                total[:-1] += 2 * PENALTY * (
                    np.bincount(col[own], change[row[own]], minlength=len(model.weights))
                    - np.bincount(col2, change[row2], minlength=len(model.weights)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    return run


def fit_toxicity(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Toxic:
    """The model for rows ``doc_id, text, toxic``; rows without a label are left out.

    At most about ``sample_rows`` rows, drawn by a hash of their key, are used.  Without
    any toxic or any other row the model says 0.5 less the prior for everything.
    """
    rows = rows.where("toxic is not null")
    n = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)).cast("double")
    few = rows.where(draw < 1e6 * sample_rows / max(n, 1)).repartition(SPLITS, "doc_id")
    train = stage(few.select("text", "toxic").mapInArrow(
        training_features, "toxic int, own array<int>, turned array<int>"))
    sizes = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    bad, good = sizes.t, sizes.n - sizes.t
    if not bad or not good:
        return Toxic(np.zeros(0, np.int32), np.zeros(0), np.log((bad + 1) / (good + 1)))
    counts = train.select("toxic", F.explode("own").alias("bucket")).groupBy("bucket").agg(
        F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("m"))
    # chi-square of the two-by-two table of feature and label
    expected = F.col("m") * (bad / sizes.n)
    chi = ((F.col("a") - expected) ** 2 / expected + (F.col("a") - expected) ** 2 / (F.col("m") - expected))
    chosen = (counts.where("m >= 5").withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI)
              .orderBy(F.desc("chi"), "bucket").limit(FEATURES).select("bucket").collect())
    terms = np.concatenate([f for _, part in features(pa.array(list(NEXT))) for f in part])
    buckets = np.unique(np.concatenate([np.array([r.bucket for r in chosen], np.int32), terms]))
    train = stage(train.mapInArrow(_only(buckets), train.schema))
    model = Toxic(buckets, np.zeros(len(buckets)), float(np.log(bad / good)))
    weight = (good / bad) ** 0.75
    squares = np.full(len(buckets) + 1, 1e-9)
    for _ in range(STEPS):
        g = sum(np.array(r.g) for r in train.mapInArrow(gradients(model, weight), "g array<double>").collect())
        g = g / sizes.n + RIDGE * np.append(model.weights, 0)
        squares += g * g
        step = RATE * g / np.sqrt(squares)
        model = Toxic(buckets, model.weights - step[:-1], model.offset - step[-1])
    return model


def _only(buckets: np.ndarray):
    """Keep the chosen features of each list."""

    def run(batches):
        for batch in batches:
            columns = [batch.column("toxic")]
            for name in ("own", "turned"):
                lists = batch.column(name)
                row, col = _dense(lists, buckets)
                ends = np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)
                built = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(buckets[col]),
                    mask=pa.array(np.array([x is None for x in lists.to_pylist()], bool)))
                columns.append(built)
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "own", "turned"])

    return run


def _score(model: Toxic):
    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, lists in features(batch.column("text")):
                for i, own in enumerate(lists):
                    at = np.searchsorted(model.buckets, own)
                    if len(model.buckets):
                        hit = model.buckets[np.minimum(at, len(model.buckets) - 1)] == own
                        total = model.offset + model.weights[at[hit]].sum()
                    else:
                        total = model.offset
                    out[row + i] = 1 / (1 + np.exp(-total))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Toxic, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Null and empty texts get the score of a text without features.  Repeated rows get
    the same score; columns named as the results are replaced.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"row {kind}, score double").select(
        "row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled documents; a document with two labels counts twice."""
    return docs.select("doc_id", "text").join(
        labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic"), "doc_id")
