"""Language identification by nearest centroids of TF-IDF byte n-grams.

Texts become unit vectors of hashed byte trigrams, weighted by inverse document
frequencies of all learning rows.  Each language has several centroids, clustered on a
bounded sample of its rows (``SAMPLE`` a language); a text goes to the language of the
nearest centroid by cosine, or to none if even that one is too far away.  Cosines grow
with the length of a text, whatever its language; so how far is too far is learned from
the sampled rows for each centroid and class of length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm import kernels as K
from glyphloom.session import stage

GRAMS = 4_096
CENTROIDS = 4
ROUNDS = 4
#: labelled rows a language that clustering sees; document frequencies see all rows
SAMPLE = 2_000
UNKNOWN = "und"
#: classes of length: powers of two of the trigrams in a text
CLASSES = 32
#: steps of a cosine that the learned ones are counted by
STEPS = 200
#: share of the learning rows whose cosines bound the rest from below, and how far under the bound a text may be
LOWEST, REACH = 0.01, 0.6
#: learning rows that a bound takes: with fewer, so small a share is no row
LEARNED_ROWS = 100


@dataclass
class Centroids:
    """The model: one language a row of ``centres``, and the weights of the grams.

    ``least`` is the cosine from which a text belongs to a centroid, by centroid and class
    of length; 0 if too few rows were learned from.
    """

    languages: list[str]
    centres: np.ndarray
    idf: np.ndarray
    least: np.ndarray | float = 0.0


def gram_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``first row, counts``: hashed trigram counts of whole texts, 256 texts at most at once."""
    for row, data, offsets in K.pieces(texts):
        data = K.LOWER[data]
        data = np.where((data < 97) | ((data > 122) & (data < 128)), np.uint8(32), data).astype(np.uint32)
        codes = np.zeros(len(data), np.int64)
        if len(data) > 2:
            mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA6B)) ^ (
                data[2:] * np.uint32(0xC2B2AE35))
            codes[:-2] = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(20)
        for a in range(0, len(offsets) - 1, 256):
            b = min(a + 256, len(offsets) - 1)
            own = slice(offsets[a], offsets[b])
            doc = np.repeat(np.arange(b - a), np.diff(offsets[a:b + 1]))
            valid = np.arange(offsets[a], offsets[b]) + 2 < offsets[a + 1:b + 1][doc]
            flat = doc[valid] * GRAMS + codes[own][valid]
            yield row + a, np.bincount(flat, minlength=(b - a) * GRAMS).reshape(b - a, GRAMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.sqrt(counts).astype(np.float32) * idf
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def _packed(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["cluster", "sums", "n"])


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: in how many texts each gram stands, and how many texts."""
    total, n = np.zeros(GRAMS, np.int64), 0
    for batch in batches:
        for _, counts in gram_counts(batch.column("text")):
            total += (counts > 0).sum(0)
            n += len(counts)
    for low in range(0, GRAMS, 512):
        yield _packed(pa.array([low]), pa.array([total[low:low + 512].tolist()], pa.list_(pa.int64())), pa.array([n]))


def cluster_sums(model: Centroids):
    """Sums of the vectors nearest to each centroid of their own language."""
    names = np.array(model.languages)

    def run(batches):
        sums = np.zeros(model.centres.shape, np.float64)
        n = np.zeros(len(names), np.int64)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            for row, counts in gram_counts(batch.column("text")):
                x = vectors(counts, model.idf)
                near = x @ model.centres.T
                near[names[None, :] != langs[row:row + len(x), None]] = -2
                best = near.argmax(1)
                np.add.at(sums, best, x)
                n += np.bincount(best, minlength=len(names))
        for i in np.flatnonzero(n):
            yield _packed(pa.array([int(i)]), pa.array([sums[i].tolist()], pa.list_(pa.float64())), pa.array([int(n[i])]))

    return run


def length_class(counts: np.ndarray) -> np.ndarray:
    """The class of length of each text, from its trigram counts."""
    return np.frexp(np.maximum(counts.sum(1), 1))[1].clip(1, CLASSES) - 1


def own_cosines(model: Centroids):
    """``cluster, length, step, n``: how many rows have which cosine with the nearest centroid of their language."""
    names = np.array(model.languages)

    def run(batches):
        n = np.zeros((len(names), CLASSES, STEPS), np.int64)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            for row, counts in gram_counts(batch.column("text")):
                near = vectors(counts, model.idf) @ model.centres.T
                near[names[None, :] != langs[row:row + len(counts), None]] = -2
                step = (near.max(1) * STEPS).astype(np.int64).clip(0, STEPS - 1)
                np.add.at(n, (near.argmax(1), length_class(counts), step), 1)
        at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at, n[at])], names=["cluster", "length", "step", "n"])

    return run


def _bound(steps: np.ndarray) -> np.ndarray:
    """The cosine that all but the ``LOWEST`` share reach; 1 for too few rows."""
    total = steps.sum(-1)
    low = (np.cumsum(steps, -1) > LOWEST * total[..., None]).argmax(-1) / STEPS
    return np.where(total >= LEARNED_ROWS, low, 1.0)


def least_cosines(counted: np.ndarray) -> np.ndarray:
    """``Centroids.least`` from rows counted by centroid, class of length and cosine.

    Neighbouring classes are taken together until they have enough rows; what is left
    of long ones asks as much as those before.  They are bound by all their rows, a
    centroid's own rows can only lower that: those of a centroid that stands among copies
    of one text say nothing about others.  A class asks no more than longer ones do.
    """
    ends, seen = [0], 0
    for k, n in enumerate(counted.sum((0, 2))):
        seen += n
        if seen >= LEARNED_ROWS:
            ends.append(k + 1)
            seen = 0
    if len(ends) == 1:
        return np.zeros(counted.shape[:2])
    grouped = np.add.reduceat(counted[:, :ends[-1]], ends[:-1], axis=1)
    both = np.minimum(_bound(grouped), _bound(grouped.sum(0)))
    both = np.minimum.accumulate(both[:, ::-1], axis=1)[:, ::-1]
    sizes = np.diff(ends)
    sizes[-1] += counted.shape[1] - ends[-1]
    return REACH * np.repeat(both, sizes, axis=1)


def first_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, counts in gram_counts(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(row, len(counts)), pa.array(counts.tolist(), pa.list_(pa.int64()))],
                names=["lang", "counts"])


def fit_languages(
    rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, rejecting: bool = False,
) -> Centroids:
    """The model for rows ``doc_id, text, lang``; rows without language or letters are left out.

    The driver sees one number a language, 4,096 frequencies, and a vector a centroid; if
    ``rejecting``, counts of cosines as well, from which ``least`` is learned.
    """
    rows = rows.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Centroids([], np.zeros((0, GRAMS), np.float32), np.ones(GRAMS, np.float32))
    parts = rows.select("text").mapInArrow(document_frequencies, "cluster long, sums array<long>, n long")
    summed = (parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos")
              .agg(F.sum("col").alias("df"), F.sum("n").alias("n")).collect())
    idf = np.zeros(GRAMS)
    for r in summed:
        idf[r.cluster + r.pos] = np.log((1 + r.n) / (1 + r.df)) + 1
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)).cast("double")
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, 1e6 * sample / n).otherwise(share)
    few = stage(rows.where(draw < share).repartition(max(1, min(8, len(sizes))), "doc_id"))
    firsts = (few.withColumn("k", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"))))
        .where(F.col("k") <= centroids).select("text", "lang")
        .mapInArrow(first_vectors, "lang string, counts array<long>").collect())
    firsts = sorted(firsts, key=lambda r: (r.lang, r.counts))
    idf = idf.astype(np.float32)
    model = Centroids([r.lang for r in firsts],
                      vectors(np.array([r.counts for r in firsts]), idf), idf)
    for _ in range(ROUNDS):
        sums = few.select("text", "lang").mapInArrow(
            cluster_sums(model), "cluster long, sums array<double>, n long").collect()
        centres = np.zeros(model.centres.shape)
        for r in sums:
            centres[r.cluster] += r.sums
        length = np.sqrt((centres ** 2).sum(1, keepdims=True))
        moved = np.where(length > 0, centres / np.where(length > 0, length, 1), model.centres)
        model = Centroids(model.languages, moved.astype(np.float32), idf)
    if rejecting:
        counted = np.zeros((len(model.languages), CLASSES, STEPS), np.int64)
        for r in (few.select("text", "lang").mapInArrow(own_cosines(model), "cluster long, length long, step long, n long")
                  .groupBy("cluster", "length", "step").agg(F.sum("n").alias("n")).collect()):
            counted[r.cluster, r.length, r.step] = r.n
        model.least = least_cosines(counted)
    return model


def _predict(model: Centroids, least: np.ndarray | float):
    least = np.broadcast_to(least, (len(model.languages), CLASSES))

    def run(batches):
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), bool)
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model.languages:
                for row, counts in gram_counts(batch.column("text")):
                    near = vectors(counts, model.idf) @ model.centres.T
                    best, length = near.argmax(1), length_class(counts)
                    for i, k in enumerate(best):
                        if letters[row + i]:
                            scores[row + i] = min(1.0, max(0.0, float(near[i, k])))
                            if near[i, k] >= least[k, length[i]]:
                                langs[row + i] = model.languages[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(langs), pa.array(scores)], names=["row", "lang_pred", "score"])

    return run


def identify(
    docs: DataFrame, model: Centroids, text: str = "text", least: np.ndarray | float = 0.0,
) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, the cosine of the nearest centroid.

    Null texts, texts without a letter, and texts with a cosine below ``least`` (one
    number, or one for each centroid and class of length) get ``und``; the first two a
    score of 0.  A model of no languages gives ``und``.  Ties
    go to the centroid first by language.  Repeated rows get the same answer; columns
    named as the results are replaced.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{text}`").alias("text"),
        F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(model, least), f"row {kind}, lang_pred string, score double").select(
        "row.*", "lang_pred", "score")


def held_out(key: Column, parts: int, which: int) -> Column:
    """Whether crc32 of the key as text leaves that remainder; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == which, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` of the rows that may be learned from."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang")
