"""The match job (R9): standardised names x a batch of requests -> ranked hits.

1. Requests are validated first (R7): only valid ones are matched, the others
   come back with a reason. Request ids and record ids must be unique.
2. The name table is indexed once (``keyindex``): distinct keys with a member
   count (equal keys have equal scores), in lots with letter counts and
   postings. ``match`` indexes for one call, ``match_index`` opens a stored one.
3. The request batch goes past the lots in blocks (``probe``): candidates are
   counted, bounded and scored inside the scan, so no pair is shuffled that
   cannot reach its request's threshold or the best keys of its task.
4. Requests without any candidate (C4) go past the lots again without the
   gram condition, under the same bounds.
5. Scored keys join their records. A request's limit is at most
   ``MAX_LIMIT`` and equal keys rank by id, so only the ``MAX_LIMIT`` lowest
   ids of a key can be hits; the others are trimmed inside each task.
6. ``row_number`` ranking and the per-request limit (WindowGroupLimit).

The job runs its scans when called: what it returns reads written tables. The
index of a call goes when the call ends, and shuffle files with their action,
so that one index at a time takes room.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onoma.functions.grams import token_set
from onoma.functions.normalize import normalize_name
from onoma.operators.candidates import DEFAULT_NGRAM, candidate_counts, candidate_ids, gram_index
from onoma.operators.keyindex import WAVE_ENDS, KeyIndex, build_index
from onoma.operators.probe import PROBE_SCHEMA, met_bars, probe, request_blocks
from onoma.operators.ranking import MAX_LIMIT, project_hits, rank_hits, with_display_scores
from onoma.operators.requests import distinct_request_keys, key_members, validate_requests
from onoma.operators.ties import tie_stats
from onoma.session import ensure_checkpoint_dir, materialize, shuffles_dropped
from onoma.sources import versions
from onoma.sources.tables import with_request_defaults

#: Records from which a table is met in waves.
WAVES_FROM = 2_000_000
#: Bytes of scored keys up to which every task that reads the records holds them; above, the records are shuffled.
HELD_KEYS = 1 << 25


@dataclass(frozen=True)
class MatchConfig:
    ngram_n: int = DEFAULT_NGRAM
    # A caller may cap the candidates of a request at the K lowest ids.
    max_candidates: int | None = None


@dataclass
class MatchResult:
    hits: DataFrame
    display: DataFrame
    summary: DataFrame
    counts: DataFrame  # (request_id, candidate_count) of requests that hit the index
    rejected: DataFrame  # invalid requests with their reason
    requests: DataFrame  # the valid ones, prepared
    work: DataFrame  # (request_id, bounded, scored): keys compared by bounds and by LCS


def prepare_names(names: DataFrame) -> DataFrame:
    """(id, full_name, normalized_name, tokens)."""
    out = names.select("id", "full_name", "normalized_name", token_set("normalized_name").alias("tokens"))
    return out.withColumn("tokens_len", F.length(F.array_join("tokens", " ")))


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Requests with defaults, ``q_norm`` and ``q_tokens``."""
    reqs = with_request_defaults(requests)
    reqs = reqs.withColumn("q_norm", normalize_name("name"))
    reqs = reqs.withColumn("q_tokens", token_set("q_norm"))
    return reqs.withColumn("q_tokens_len", F.length(F.array_join("q_tokens", " ")))


def require_unique(df: DataFrame, col: str, what: str) -> None:
    if not df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"duplicate {what}")


def match(names: DataFrame, requests: DataFrame, cfg: MatchConfig = MatchConfig()) -> MatchResult:
    """Match requests ``(request_id, name, [threshold, limit, w_token, explain, include_by_id])``
    against standardised ``names`` ``(id, full_name, normalized_name)``, indexed for this call."""
    spark = names.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/match-index-{uuid.uuid4().hex}"
    try:
        return match_index(build_index(names, root, cfg.ngram_n), requests, cfg)
    finally:
        # what the result reads is written by now
        versions.remove(spark, root)


def _scan(index: KeyIndex, requests: DataFrame, need_gram: bool, top: bool) -> DataFrame:
    """Probe the requests block by block; the driver holds one block at a time.

    A table of some size is met in waves: a few lots give the bars that the requests start from at the others.
    """
    spark = requests.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/match-scored-{uuid.uuid4().hex}"
    paths = [f"{path}/none"]
    spark.createDataFrame([], PROBE_SCHEMA).write.parquet(paths[0])
    for block in request_blocks(requests):
        waves = [index.lots]
        if top and index.n_records >= WAVES_FROM and "wave" in index.lots.columns:
            waves = [index.lots.filter(F.col("wave") == i) for i in range(len(WAVE_ENDS) + 1)]
        bars = None
        for i, lots in enumerate(waves):
            if i:
                bars = met_bars(index, block, spark.read.schema(PROBE_SCHEMA).parquet(*paths[-i:]))
            paths.append(f"{path}/part-{len(paths)}")
            probe(index, block, need_gram, top, lots, bars).write.parquet(paths[-1])
    return spark.read.schema(PROBE_SCHEMA).parquet(*paths)


def _held_keys(pairs: DataFrame) -> DataFrame:
    """Distinct keys of scored pairs; few of them go to the records, so that these are not shuffled."""
    with shuffles_dropped(pairs.sparkSession):
        keys = materialize(pairs.select(F.col("key").alias("normalized_name")).distinct(), "match-keys")
    size = keys.agg(F.sum(F.octet_length("normalized_name") + 32)).first()[0] or 0
    return F.broadcast(keys) if size <= HELD_KEYS else keys


def match_index(index: KeyIndex, requests: DataFrame, cfg: MatchConfig = MatchConfig()) -> MatchResult:
    """Match requests against an opened index; only tables of the batch's size are written."""
    valid, rejected = validate_requests(requests)
    reqs = materialize(prepare_requests(valid), "match-requests")
    require_unique(reqs, "request_id", "request ids")
    recs = index.records
    # a cap drops records by their id, so that none is out of reach for better ones
    top = cfg.max_candidates is None
    scored = _scan(index, reqs, True, top)
    counts = scored.filter("key IS NULL AND candidates > 0").groupBy("request_id").agg(F.sum("candidates").alias("candidate_count"))
    unhit = _scan(index, reqs.join(counts, "request_id", "left_anti"), False, top)
    work = scored.unionByName(unhit).filter("key IS NULL").groupBy("request_id").agg(F.sum("bounded").alias("bounded"), F.sum("scored").alias("scored"))
    pairs, fallback = (df.filter("key IS NOT NULL").drop("members", "candidates", "bounded", "scored") for df in (scored, unhit))

    ids = Window.partitionBy("normalized_name").orderBy("id")
    wanted = recs.join(_held_keys(pairs.unionByName(fallback)), "normalized_name", "left_semi")
    if cfg.max_candidates is None:
        lowest = wanted.withColumn("_rn", F.row_number().over(ids)).filter(F.col("_rn") <= MAX_LIMIT).drop("_rn")
        rows = pairs.unionByName(fallback).join(lowest, F.col("key") == F.col("normalized_name"))
    else:
        capped = materialize(candidate_ids(reqs, gram_index(recs, index.ngram_n), index.ngram_n, cfg.max_candidates), "match-capped")
        counts = candidate_counts(capped)
        rows = pairs.join(wanted, F.col("key") == F.col("normalized_name")).join(capped, ["request_id", "id"], "left_semi")
        rows = rows.unionByName(fallback.join(wanted, F.col("key") == F.col("normalized_name")))
    asked = reqs.select("request_id", "q_norm", "threshold", "limit", "w_token", "explain")
    with shuffles_dropped(reqs.sparkSession):
        display = materialize(with_display_scores(rank_hits(rows.join(asked, "request_id"))), "match-display")

    n_hits = display.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_hits"))
    summary = (
        reqs.select("request_id", "q_norm")
        .join(counts, "request_id", "left")
        .join(n_hits, "request_id", "left")
        .join(tie_stats(display), "request_id", "left")
        .select(
            "request_id",
            "q_norm",
            F.col("candidate_count").isNull().alias("fallback"),
            F.coalesce(F.col("candidate_count"), F.lit(index.n_records)).alias("candidate_count"),
            F.coalesce(F.col("n_hits"), F.lit(0)).alias("n_hits"),
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("tie_groups", "by_token", "by_edit", "by_id")],
        )
    )
    return MatchResult(project_hits(display), display, summary, counts, rejected, reqs, work)


def match_distinct(names: DataFrame, requests: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Match each distinct request key once and hand the hits to every equal request.

    Invalid requests (a null name among them) get no hits; ``match`` returns
    them with a reason.
    """
    reqs = prepare_requests(validate_requests(requests)[0])
    reps = distinct_request_keys(reqs)
    rep_hits = match(names, reps.select("request_id", "name", "threshold", "limit", "w_token", "explain", "include_by_id"), cfg).hits
    members = key_members(reqs, reps)
    return (
        members.join(rep_hits.withColumnRenamed("request_id", "rep_request_id"), "rep_request_id")
        .drop("rep_request_id")
        .select("request_id", "rank", "id", "name", "similarity", "token_score", "edit_score", "w_token")
    )
