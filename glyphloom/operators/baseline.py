"""TF-IDF features on ``pyspark.ml`` with multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import DenseMatrix, DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom import values as V
from glyphloom.functions.labels import emoji_of
from glyphloom.functions.text import ngrams, tokens
from glyphloom.operators import bigrams
from glyphloom.operators.features import fit_vocabulary
from glyphloom.operators.softmax import BLOCK, STAGED, blocks, fit_blocks, margins
from glyphloom.session import stage


@dataclass(frozen=True)
class Classifier:
    """Weights (classes by features) and an intercept per class, named as in ``pyspark.ml``."""

    coefficientMatrix: DenseMatrix
    interceptVector: DenseVector


@dataclass(frozen=True)
class TextBaseline:
    """A fitted text classifier."""

    features: PipelineModel
    classifier: Classifier
    n: int

    def predict(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """Add ``pred_label`` and ``pred``, the emoji of that class."""
        vocabulary, scaling = self.features.stages[:2]
        terms, idf = bigrams.Terms(list(vocabulary.vocabulary), self.n), scaling.getScalingVec().toArray()
        told = _classes(terms, idf, self.classifier)(bigrams.plain_text(F.col(text)))
        kept = [F.col(f"`{name}`") for name in rows.columns]
        return rows.select(*kept, told.alias("pred_label")).withColumn("pred", emoji_of(F.col("pred_label")))


def _vectors(rows: DataFrame, text: str, features: PipelineModel, n: int) -> DataFrame:
    """``rows`` with the vectors of ``pyspark.ml``, ``_features``, which ``bigrams.Terms`` gives without its rows."""
    return features.transform(rows.withColumn("_terms", ngrams(tokens(F.col(text)), n)))


def _classes(terms: bigrams.Terms, idf: np.ndarray, classifier: Classifier):
    """The class with the largest margin; ties to the smaller."""
    weights, intercepts = classifier.coefficientMatrix.toArray(), classifier.interceptVector.toArray()

    @F.arrow_udf("int")
    def classes(text: pa.Array) -> pa.Array:
        found = [margins(weights, intercepts, *terms.vectors(idf, *bigrams.words_of(text[rows]))).argmax(axis=1)
                 for rows in bigrams.text_pieces(text)]
        return pa.array(np.concatenate(found) if found else [], pa.int32())

    return classes


def fit_baseline(
    train: DataFrame, key: str = "id", text: str = "text", label: str = "label",
    max_features: int = V.MAX_FEATURES, n: int = 2, c: float = 1.0, max_iter: int = 1000,
    tol: float = 1e-4,
) -> TextBaseline:
    """Fit on ``train``; ``c`` is the inverse regularisation strength.

    The vocabulary (at most ``max_features`` terms) passes through the driver as
    a model parameter; texts and gradients stay distributed.  The vectors are
    staged in blocks, so the many passes of the solver do not depend on the text pipeline.
    """
    vocabulary = fit_vocabulary(train, key, text, max_features, n)
    terms = vocabulary.orderBy("rank").select("term", "idf").collect()
    features = PipelineModel([
        CountVectorizerModel.from_vocabulary(
            [t.term for t in terms], inputCol="_terms", outputCol="_tf"
        ),
        ElementwiseProduct(
            scalingVec=Vectors.dense([t.idf for t in terms]), inputCol="_tf", outputCol="_tfidf"
        ),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol="_features"),
    ])
    known, idf = bigrams.Terms([t.term for t in terms], n), np.array([t.idf for t in terms], np.float64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, words, ends in bigrams.cut_pieces(batches):
            yield blocks(piece.column("label").to_numpy(), *known.scaled(idf, words, ends))

    labelled = train.select(F.col(label).cast("int").alias("label"), bigrams.plain_text(F.col(text)).alias("words"))
    vectors = stage(labelled.mapInArrow(packed, BLOCK), **STAGED)
    classes = (vectors.agg(F.max("label")).first()[0] or 0) + 1
    weights, intercepts = fit_blocks(vectors, len(terms), classes, c, max_iter, tol, idf)
    matrix = DenseMatrix(classes, len(terms), weights.ravel(), isTransposed=True)
    return TextBaseline(features, Classifier(matrix, Vectors.dense(intercepts)), n)
