"""Answers kept across batches (R8): a request key that was matched before is looked up, not matched.

Answers lie below a root in a folder for each version of the index, so a
changed name table starts without any. A batch validates its requests, takes
each distinct key once, matches the keys that have no answer yet (none: no key
of the index is read) and adds them as one part; asked keys are kept apart from
hits, so a key without a hit is known too. Parts are published by a pointer
(``sources.versions``): a batch that fails leaves the answers as they were.

All joins are on the request key or its id, so the driver sees folder names
only. Invalid requests get no hits; repeated request ids raise. One writer at a
time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.operators.keyindex import KeyIndex
from onoma.operators.requests import REQUEST_KEY, distinct_request_keys, key_members, validate_requests
from onoma.plans.match import MatchConfig, match_index, prepare_requests, require_unique
from onoma.session import ensure_checkpoint_dir, materialize
from onoma.sources import versions

ASKED = "answer_id string, q_norm string, threshold double, limit int, w_token double, explain boolean, include_by_id boolean"
HIT_COLUMNS = ["rank", "id", "name", "similarity", "token_score", "edit_score", "w_token"]
HITS = "answer_id string, rank int, id long, name string, similarity double, token_score double, edit_score double, w_token double"
_PARAMS = ["threshold", "limit", "w_token", "explain", "include_by_id"]


def _answers_root(index: KeyIndex, root: str, cfg: MatchConfig) -> str:
    version = index.path.rstrip("/").rsplit("/", 1)[-1]
    return f"{root.rstrip('/')}/{version}-{cfg.max_candidates or 'all'}"


def _parts(spark, at: str) -> list[str]:
    current = versions.current(spark, at)
    return [] if current is None else sorted(r["part"] for r in spark.read.schema("part string").parquet(current).collect())


def _read(spark, parts: list[str], table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{p}/{table}" for p in parts]) if parts else spark.createDataFrame([], schema)


def match_reusing(index: KeyIndex, requests: DataFrame, root: str, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Hits of ``match_distinct`` for the opened index; only new request keys are matched."""
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    at = _answers_root(index, root, cfg)
    reqs = materialize(prepare_requests(validate_requests(requests)[0]), "reuse-requests")
    require_unique(reqs, "request_id", "request ids")
    reps = distinct_request_keys(reqs)
    parts = _parts(spark, at)
    fresh = materialize(reps.join(_read(spark, parts, "asked", ASKED), REQUEST_KEY, "left_anti"), "reuse-fresh")
    if not fresh.isEmpty():
        part = f"{at}/_parts/{uuid.uuid4().hex}"
        tag = part.rsplit("/", 1)[-1]
        answer = F.concat(F.lit(f"{tag}-"), F.col("request_id").cast("string"))
        hits = match_index(index, fresh.select("request_id", "name", *_PARAMS), cfg).hits
        hits.select(answer.alias("answer_id"), *HIT_COLUMNS).write.parquet(f"{part}/hits")
        fresh.select(answer.alias("answer_id"), *REQUEST_KEY).write.parquet(f"{part}/asked")
        parts = [*parts, part]
        versions.publish(spark, at, lambda v: spark.createDataFrame([(p,) for p in parts], "part string").coalesce(1).write.parquet(v))
    asked = _read(spark, parts, "asked", ASKED)
    members = key_members(reqs, asked.withColumnRenamed("answer_id", "request_id")).withColumnRenamed("rep_request_id", "answer_id")
    return members.join(_read(spark, parts, "hits", HITS), "answer_id").select("request_id", *HIT_COLUMNS)
