"""Scoring of reads as they arrive: a stateless map over a stream, beyond what the batch operators' parity asks for.

Fitting is batch. A fitted model is one vector over strings, which every executor holds once; each read is expanded and scored
alone: no state, no watermark, no late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, ocsvm


def score_stream(stream: DataFrame, vector: DataFrame, weights: dict[int, float], m: int, rho: float, decay: float = 0.5) -> DataFrame:
    """(patient, read_idx, score) of a stream of reads under the model (k, kmer, v); scores are inverted decisions.

    Reads without a string of the alphabet score rho. Strings with other letters are left out, also without mismatches.
    """
    rows = features.read_vectors(stream, sorted(weights), m, decay, alphabet_only=True)
    return rows.select("patient", "read_idx", (F.lit(rho) - ocsvm.dot_of(vector, weights)("vectors")).alias("score"))
