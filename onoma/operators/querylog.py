"""Query-log analytics.

A query log has one row per request: ``seq`` (arrival order), ``query_norm``,
``is_repeat`` (an equal request was answered before, so it is served again
without a search), ``latency_ms``, ``candidate_count`` and the four tie
counters. Repeats add no latency, candidate or tie samples; rolling figures
use the newest ``last_n`` searches.

Every figure is an aggregate: partial aggregation before any shuffle, and the
only ordered steps work on bounded row sets (newest ``last_n`` rows, top 10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onoma.functions.similarity import py_round
from onoma.session import materialize

# Size of the rolling sample, number of top queries, and the
# percentile reported.
LAST_N = 5000
TOP_K = 10
P95 = 0.95

TIE_COLUMNS = ["tie_groups", "by_token", "by_edit", "by_id"]


def mark_repeats(log: DataFrame, key: list[str]) -> DataFrame:
    """Set ``is_repeat`` = an earlier row has the same key.

    The first-seen ``seq`` per key comes from a partially aggregated
    ``groupBy`` (a hot key costs one row per map task); the join back is
    skew-split by AQE.
    """
    first = log.groupBy(*key).agg(F.min("seq").alias("_first_seq"))
    return log.join(first, key, "left").withColumn("is_repeat", F.col("seq") > F.col("_first_seq")).drop("_first_seq")


def searches(log: DataFrame) -> DataFrame:
    """Rows that ran a search (not served as repeats)."""
    return log.filter(~F.col("is_repeat"))


def last_searches(log: DataFrame, last_n: int = LAST_N) -> DataFrame:
    """The newest ``last_n`` searches (M4); a bounded top-k by ``seq``."""
    return searches(log).orderBy(F.col("seq").desc()).limit(last_n)


def request_totals(log: DataFrame) -> DataFrame:
    """total_requests, total_cache_hits, cache_hit_rate (M1)."""
    out = log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("is_repeat")).alias("total_cache_hits"),
    )
    rate = F.when(F.col("total_requests") == 0, F.lit(0.0)).otherwise(
        F.col("total_cache_hits") / F.col("total_requests")
    )
    return out.withColumn("cache_hit_rate", py_round(rate, 4))


def _pctl_position(n: F.Column) -> F.Column:
    """1-based position of the p95 element: floor(0.95 * (n - 1)) + 1."""
    return F.floor(F.lit(P95) * (n - F.lit(1)).cast("double")) + F.lit(1)


def _sample_stats(log: DataFrame, last_n: int) -> DataFrame:
    """One row: unrounded means and p95 of the newest ``last_n`` searches, from one sample."""
    # The sample holds at most last_n rows, so these global orderings are bounded.
    sample = last_searches(log, last_n).select(
        F.col("latency_ms").alias("lat"),
        F.col("candidate_count").cast("double").alias("cand"),
        F.row_number().over(Window.orderBy(F.col("latency_ms").asc_nulls_first())).alias("lat_rn"),
        F.row_number().over(Window.orderBy(F.col("candidate_count").asc_nulls_first())).alias("cand_rn"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )
    at = _pctl_position(F.col("n"))
    return sample.agg(
        F.coalesce(F.avg("lat"), F.lit(0.0)).alias("lat_avg"),
        F.coalesce(F.max(F.when(F.col("lat_rn") == at, F.col("lat"))), F.lit(0.0)).alias("lat_p95"),
        F.coalesce(F.avg("cand"), F.lit(0.0)).alias("cand_avg"),
        F.coalesce(F.max(F.when(F.col("cand_rn") == at, F.col("cand"))), F.lit(0.0)).alias("cand_p95"),
    )


_ROLLING = (("latency_ms_avg", "lat_avg"), ("latency_ms_p95", "lat_p95"), ("candidates_avg", "cand_avg"), ("candidates_p95", "cand_p95"))


def rolling_stats(log: DataFrame, last_n: int = LAST_N) -> DataFrame:
    """Mean and p95 of latency and candidates over the newest searches (M2, M3).

    p95 is the element at 0-based index int(0.95 * (n - 1)) of the sorted
    sample (no interpolation); 0.0 for an empty sample.
    """
    return _sample_stats(log, last_n).select(*[py_round(F.col(raw), 2).alias(name) for name, raw in _ROLLING])


def tie_shares(log: DataFrame) -> DataFrame:
    """Tie groups and the share resolved by token / edit / id."""
    sums = searches(log).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TIE_COLUMNS])

    def share(c: str) -> F.Column:
        return py_round(
            F.when(F.col("tie_groups") == 0, F.lit(0.0)).otherwise(F.col(c) / F.col("tie_groups")), 4
        )

    return sums.select(
        F.col("tie_groups").alias("tie_groups_total"),
        share("by_token").alias("resolved_by_token_pct"),
        share("by_edit").alias("resolved_by_edit_pct"),
        share("by_id").alias("resolved_by_id_pct"),
    )


def top_queries(log: DataFrame, k: int = TOP_K) -> DataFrame:
    """Most frequent normalised queries, ties in first-seen order (M5)."""
    counts = log.groupBy("query_norm").agg(
        F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq")
    )
    ranked = counts.orderBy(F.col("count").desc(), F.col("first_seq").asc()).limit(k)
    return ranked.select(
        F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("first_seq").asc())).alias("position"),
        F.col("query_norm").alias("query"),
        "count",
    )


def metrics_summary(log: DataFrame, last_n: int = LAST_N, report: DataFrame | None = None) -> DataFrame:
    """The whole metrics record in one row (M6): totals, rolling figures, tie
    shares, ``top_queries`` (list of query and count) and, when the one-row
    load ``report`` (I10) is given, ``repo``.

    The marked log is written once; totals and ties are one aggregate over it
    and the rolling figures another.
    """
    log = materialize(log, "query-log")
    searched = ~F.col("is_repeat")
    totals = log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("is_repeat").alias("total_cache_hits"),
        *[F.coalesce(F.sum(F.when(searched, F.col(c))), F.lit(0)).alias(c) for c in TIE_COLUMNS],
    )
    top = top_queries(log).agg(F.array_sort(F.collect_list(F.struct("position", "query", "count"))).alias("top_queries"))  # TOP_K rows
    parts = [totals, _sample_stats(log, last_n), top]
    if report is not None:
        parts.append(report.select(F.struct(*report.columns).alias("repo")))
    # one-row frames side by side: each fills its own columns of a union
    names = [(c, p.schema[c].dataType) for p in parts for c in p.columns]
    rows = None
    for p in parts:
        row = p.select(*[(F.col(c) if c in p.columns else F.lit(None).cast(t)).alias(c) for c, t in names])
        rows = row if rows is None else rows.unionByName(row)
    one = rows.agg(*[F.any_value(c, True).alias(c) for c, _ in names])

    def share(part: str, whole: str) -> F.Column:
        return F.when(F.col(whole) == 0, F.lit(0.0)).otherwise(F.col(part) / F.col(whole))

    one = one.withColumns(
        {"_hit": share("total_cache_hits", "total_requests")} | {f"_{c}": share(c, "tie_groups") for c in TIE_COLUMNS[1:]}
    )
    return one.select(
        "total_requests",
        "total_cache_hits",
        py_round(F.col("_hit"), 4).alias("cache_hit_rate"),
        *[py_round(F.col(raw), 2).alias(name) for name, raw in _ROLLING],
        F.col("tie_groups").alias("tie_groups_total"),
        *[py_round(F.col(f"_{c}"), 4).alias(f"resolved_{c}_pct") for c in TIE_COLUMNS[1:]],
        F.transform("top_queries", lambda q: F.struct(q["query"].alias("query"), q["count"].alias("count"))).alias("top_queries"),
        *(["repo"] if report is not None else []),
    )


def log_from_events(events: DataFrame) -> DataFrame:
    """Read the ``events`` table as a query log (a mapping of our own).

    seq = event_id, query = "<event_type> <user_id>", latency_ms = value,
    candidate_count = user_id; no tie samples. Repeats are requests whose
    query was seen at an earlier seq.
    """
    log = events.select(
        F.col("event_id").alias("seq"),
        F.concat_ws(" ", F.lower(F.col("event_type")), F.col("user_id").cast("string")).alias("query_norm"),
        F.col("value").cast("double").alias("latency_ms"),
        F.col("user_id").cast("long").alias("candidate_count"),
        *[F.lit(0).cast("long").alias(c) for c in TIE_COLUMNS],
    )
    return mark_repeats(log, ["query_norm"])


def log_from_match(requests: DataFrame, summary: DataFrame) -> DataFrame:
    """A query log of one match batch: seq = request_id, no latency measured.

    ``is_repeat`` marks a request whose full key (query and parameters) was
    already asked with a lower seq, the rule under which a cache would have
    served it.
    """
    keyed = requests.select(
        F.col("request_id").alias("seq"), "threshold", "limit", "w_token", "explain", "include_by_id"
    )
    log = summary.select(
        F.col("request_id").alias("seq"),
        "q_norm",
        F.lit(None).cast("double").alias("latency_ms"),
        F.col("candidate_count").cast("long"),
        *[F.col(c).cast("long") for c in TIE_COLUMNS],
    ).join(keyed, "seq")
    key = ["q_norm", "threshold", "limit", "w_token", "explain", "include_by_id"]
    marked = mark_repeats(log, key)
    return marked.select("seq", F.col("q_norm").alias("query_norm"), "is_repeat", "latency_ms", "candidate_count", *TIE_COLUMNS)
