"""Request validation (R7) and reuse of equal requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.sources.tables import with_request_defaults

# Accepted parameter ranges.
THRESHOLD_RANGE = (0.0, 100.0)
LIMIT_RANGE = (1, 100)
W_TOKEN_RANGE = (0.0, 1.0)

REQUEST_KEY = ["q_norm", "threshold", "limit", "w_token", "explain", "include_by_id"]


def rejection_reason(df: DataFrame):
    t, lim, w = F.col("threshold"), F.col("limit"), F.col("w_token")
    return (
        F.when(F.col("name").isNull(), F.lit("name is required"))
        .when(t.isNull() | (t < THRESHOLD_RANGE[0]) | (t > THRESHOLD_RANGE[1]) | F.isnan(t), F.lit("threshold must be between 0 and 100"))
        .when(lim.isNull() | (lim < LIMIT_RANGE[0]) | (lim > LIMIT_RANGE[1]), F.lit("limit must be between 1 and 100"))
        .when(w.isNull() | (w < W_TOKEN_RANGE[0]) | (w > W_TOKEN_RANGE[1]) | F.isnan(w), F.lit("w_token must be between 0 and 1"))
    )


def validate_requests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into ``(valid, rejected)``; ``rejected`` carries ``reason``.

    Absent parameters take their defaults first (threshold 70, limit 10,
    w_token 0.65, explain false, include_by_id true).
    """
    df = with_request_defaults(raw)
    df = df.withColumn("reason", rejection_reason(df))
    valid = df.filter(F.col("reason").isNull()).drop("reason")
    rejected = df.filter(F.col("reason").isNotNull())
    return valid, rejected


def distinct_request_keys(requests: DataFrame) -> DataFrame:
    """One representative request per equal key (R8); ``request_id`` = lowest id."""
    return requests.groupBy(*REQUEST_KEY).agg(
        F.min("request_id").alias("request_id"), F.min_by("name", "request_id").alias("name")
    )


def key_members(requests: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep_request_id, request_id): which representative answers each request."""
    keyed = requests.select("request_id", *REQUEST_KEY)
    return keyed.join(
        reps.select(F.col("request_id").alias("rep_request_id"), *REQUEST_KEY), REQUEST_KEY, "inner"
    ).select("rep_request_id", "request_id")
