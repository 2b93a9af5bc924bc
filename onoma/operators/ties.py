"""Tie statistics over the returned (limited) lists.

Rows are ordered by raw similarity and rounding is monotone, so a run of equal
rounded similarity is exactly a group of equal rounded similarity. A group of
more than one row is resolved by token when its rounded token scores differ,
else by edit when its rounded edit scores differ, else by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tie_groups(display: DataFrame) -> DataFrame:
    """(request_id, similarity, size, resolved_by) for every tie group."""
    groups = display.groupBy("request_id", "similarity").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_distinct("token_2dp").alias("_tokens"),
        F.count_distinct("edit_2dp").alias("_edits"),
    )
    return groups.filter(F.col("size") > 1).select(
        "request_id",
        "similarity",
        "size",
        F.when(F.col("_tokens") > 1, F.lit("token"))
        .when(F.col("_edits") > 1, F.lit("edit"))
        .otherwise(F.lit("id"))
        .alias("resolved_by"),
    )


def tie_stats(display: DataFrame) -> DataFrame:
    """(request_id, tie_groups, by_token, by_edit, by_id) for requests with a tie."""
    return tie_groups(display).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("tie_groups"),
        F.count_if(F.col("resolved_by") == "token").alias("by_token"),
        F.count_if(F.col("resolved_by") == "edit").alias("by_edit"),
        F.count_if(F.col("resolved_by") == "id").alias("by_id"),
    )
