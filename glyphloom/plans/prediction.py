"""Texts to parsed predictions in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.chat import chat_messages, render_chat
from glyphloom.functions.parsing import parse_outputs
from glyphloom.operators.scoring import Predictor, score_table


def predict_records(
    rows: DataFrame, make_predictor: Callable[[], Predictor], key: str = "id", text: str = "text",
    constrain: bool = True,
) -> DataFrame:
    """The columns of ``rows`` with ``raw`` and the parsed columns of the answer.

    Each text becomes a chat without an answer, rendered and opened for the assistant;
    the predictor answers that prompt.  A null text has a null prompt.
    """
    messages = chat_messages(F.col(text), constrain=constrain)
    prompt = F.when(F.col(text).isNotNull(), render_chat(messages, add_generation_prompt=True))
    asked = rows.withColumn("_prompt", prompt)
    return parse_outputs(score_table(asked, make_predictor, key, "_prompt", tuple(rows.columns)))
