"""Label-set preparation, answer parsing and classifier evaluation on Spark.

Functions take and return DataFrames and Columns; see the README for the map.
"""

from glyphloom.functions.parsing import parse_outputs
from glyphloom.operators.baseline import fit_baseline
from glyphloom.operators.scoring import score_table
from glyphloom.plans.comparison import compare_models, score_raw_outputs
from glyphloom.plans.curation import curate
from glyphloom.plans.training_set import (
    Variant,
    build_training_set,
    dataset_variants,
    encode_training_set,
)
from glyphloom.session import build_session

__all__ = [
    "Variant", "build_session", "build_training_set", "compare_models", "curate",
    "dataset_variants", "encode_training_set", "fit_baseline", "parse_outputs",
    "score_raw_outputs", "score_table",
]
