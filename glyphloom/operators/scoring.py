"""Apply any predictor to a table of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

Predictor = Callable[[pd.Series], Iterable[str]]


def score_table(
    rows: DataFrame, make_predictor: Callable[[], Predictor], key: str = "id", text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``key``, the columns of ``keep``, and ``raw``: the predictor's answer for every text.

    ``make_predictor`` runs once per task, where a model would be loaded; the
    predictor then gets Arrow batches of texts, and batch size (set with
    ``spark.sql.execution.arrow.maxRecordsPerBatch``) does not change results.
    """
    kept = [key, *(c for c in keep if c != key)]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("raw", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predictor()
        for batch in batches:
            answers = pa.array(list(predict(batch.column(text).to_pandas())), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), answers], names=[*kept, "raw"])

    return rows.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)
