"""Threshold, deterministic ranking, top-k, projections and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onoma.functions.similarity import py_round

# Fixed value: the largest accepted per-request limit.
MAX_LIMIT = 100

HIT_COLUMNS = ["request_id", "rank", "id", "name", "similarity", "token_score", "edit_score", "w_token"]


def rank_hits(scored: DataFrame) -> DataFrame:
    """Threshold on the raw score, order by (sim desc, token desc, edit desc, id asc), keep ``limit``.

    ``limit`` is a per-request column that validation has found to be at most
    ``MAX_LIMIT``; the literal bound lets Spark plan a WindowGroupLimit that
    trims rows before the shuffle on request_id.
    """
    kept = scored.filter(F.col("similarity_raw") >= F.col("threshold"))
    order = Window.partitionBy("request_id").orderBy(
        F.col("similarity_raw").desc(), F.col("token_raw").desc(), F.col("edit_raw").desc(), F.col("id").asc()
    )
    ranked = kept.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= F.lit(MAX_LIMIT)) & (F.col("rank") <= F.col("limit")))


def with_display_scores(ranked: DataFrame) -> DataFrame:
    """Rounded scores as shown to users (Python rounding semantics, S5)."""
    return ranked.withColumns(
        {
            "similarity": py_round(F.col("similarity_raw"), 2),
            "token_2dp": py_round(F.col("token_raw"), 2),
            "edit_2dp": py_round(F.col("edit_raw"), 2),
            "w_3dp": py_round(F.col("w_token"), 3),
        }
    )


def project_hits(display: DataFrame) -> DataFrame:
    """Hit rows (R3/R4): explain columns are null unless the request asked for them."""
    explain = F.col("explain")
    return display.select(
        "request_id",
        "rank",
        "id",
        F.col("full_name").alias("name"),
        "similarity",
        F.when(explain, F.col("token_2dp")).alias("token_score"),
        F.when(explain, F.col("edit_2dp")).alias("edit_score"),
        F.when(explain, F.col("w_3dp")).alias("w_token"),
    )


def payloads(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: ordered ``results`` list and optional ``results_by_id`` map.

    Each list holds at most ``limit`` (<= 100) hits, so gathering it is bounded.
    """
    hit = F.struct("rank", "id", "name", "similarity", "token_score", "edit_score", "w_token")
    grouped = hits.groupBy("request_id").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    lists = grouped.select(
        "request_id",
        F.transform(
            "_hits",
            lambda h: F.struct(
                h["id"].alias("id"),
                h["name"].alias("name"),
                h["similarity"].alias("similarity"),
                h["token_score"].alias("token_score"),
                h["edit_score"].alias("edit_score"),
                h["w_token"].alias("w_token"),
            ),
        ).alias("results"),
    )
    out = requests.select("request_id", "include_by_id").join(lists, "request_id", "left")
    results = F.coalesce(F.col("results"), F.array().cast(lists.schema["results"].dataType))
    by_id = F.map_from_entries(
        F.transform(
            results,
            lambda r: F.struct(
                r["id"],
                F.struct(
                    r["name"].alias("name"),
                    r["similarity"].alias("similarity"),
                    r["token_score"].alias("token_score"),
                    r["edit_score"].alias("edit_score"),
                    r["w_token"].alias("w_token"),
                ),
            ),
        )
    )
    return out.select(
        "request_id",
        results.alias("results"),
        F.when(F.col("include_by_id"), by_id).alias("results_by_id"),
    )


def flat_payloads(lists: DataFrame) -> DataFrame:
    """One row per listed hit: ``request_id, pos`` (from 1), the hit, and ``in_map``.

    ``in_map`` tells whether the by-id map holds the same entry under the hit's id.
    """
    rows = lists.select("request_id", "results_by_id", F.posexplode("results").alias("pos", "hit"))
    entry = F.try_element_at("results_by_id", F.col("hit.id"))
    same = (entry["name"] == F.col("hit.name")) & (entry["similarity"] == F.col("hit.similarity"))
    return rows.select("request_id", F.col("pos") + 1, "hit.*", F.coalesce(same, F.lit(False)).alias("in_map")).withColumnRenamed("(pos + 1)", "pos")
