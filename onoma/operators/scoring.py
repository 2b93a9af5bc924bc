"""Score candidate pairs.

Input rows carry ``q_norm``/``q_tokens`` (request side), ``normalized_name``/
``tokens`` (record side) and ``w_token``/``threshold``. Scores stay raw
doubles; rounding is for display only (ranking and the threshold use raw).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.functions.similarity import (
    edit_score,
    lcs_length,
    score_upper_bound,
    token_needs_lcs,
    token_parts,
    token_score,
    weighted,
)

# Slack for the length bound so float rounding never drops a pair that
# reaches the threshold exactly.
_BOUND_SLACK = 1e-9


def score_pairs(pairs: DataFrame, prune: bool = True) -> DataFrame:
    """Add ``token_raw``, ``edit_raw``, ``similarity_raw``.

    ``prune`` drops pairs whose length-only upper bound is below their
    request's threshold before any LCS is computed; those pairs would fail
    the threshold anyway, so results are unchanged.
    """
    q, k = F.col("q_norm"), F.col("normalized_name")
    tq, tk = F.col("q_tokens"), F.col("tokens")
    if prune:
        # Lengths alone first: drops pairs of very unequal length before any
        # set operation runs on their token arrays.
        w = F.col("w_token")
        total = F.length(q) + F.length(k)
        edit_ub = F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.least(F.length(q), F.length(k)) / total)
        token_ub = F.when((F.size(tq) > 0) & (F.size(tk) > 0), F.lit(100.0)).otherwise(F.lit(0.0))
        if "q_tokens_len" in pairs.columns and "tokens_len" in pairs.columns:
            # With no shared token the token score is the diff ratio of the two
            # joined token strings, at most 100 - 100 |lx - ly| / (lx + ly).
            lx, ly = F.col("q_tokens_len"), F.col("tokens_len")
            no_shared = F.lit(100.0) - F.lit(100.0) * F.abs(lx - ly) / (lx + ly)
            token_ub = (
                F.when((F.size(tq) == 0) | (F.size(tk) == 0), F.lit(0.0))
                .when(F.arrays_overlap(tq, tk), F.lit(100.0))
                .otherwise(no_shared)
            )
        pairs = pairs.filter(w * token_ub + (F.lit(1.0) - w) * edit_ub >= F.col("threshold") - F.lit(_BOUND_SLACK))
    parts = token_parts(tq, tk)
    # The set pieces are computed once here; ``spark_partition_id`` (a cheap
    # non-deterministic column) keeps the optimizer from pushing the bound
    # filter below this projection, which would inline each set operation
    # several times into the filter.
    df = pairs.withColumns(
        {
            "_inter_n": parts["inter_n"],
            "_x": parts["x"],
            "_y": parts["y"],
            "_sect": parts["sect"],
            "_barrier": F.spark_partition_id(),
        }
    )
    cols = {"inter_n": F.col("_inter_n"), "x": F.col("_x"), "y": F.col("_y"), "sect": F.col("_sect")}
    if prune:
        bound = score_upper_bound(F.col("w_token"), F.length(q), F.length(k), tq, tk, cols)
        df = df.filter(bound >= F.col("threshold") - F.lit(_BOUND_SLACK))
    need = token_needs_lcs(tq, tk, cols)
    df = df.withColumns(
        {
            "_lcs_edit": lcs_length(q, k),
            "_lcs_tok": lcs_length(F.when(need, F.col("_x")).otherwise(F.lit("")), F.when(need, F.col("_y")).otherwise(F.lit(""))),
        }
    )
    df = df.withColumns(
        {
            "token_raw": token_score(tq, tk, cols, F.col("_lcs_tok")),
            "edit_raw": edit_score(q, k, F.col("_lcs_edit")),
        }
    )
    df = df.withColumn("similarity_raw", weighted(F.col("w_token"), F.col("token_raw"), F.col("edit_raw")))
    return df.drop("_inter_n", "_x", "_y", "_sect", "_barrier", "_lcs_edit", "_lcs_tok")
