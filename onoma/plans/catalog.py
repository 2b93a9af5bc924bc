"""Registered queries: one per operator of the survey inventory.

Every query reads the driver's tables whole (no id subsets, no row caps):

* names = every sentence/clause segment of every ``documents`` text;
* requests = every segment of every ``benchmark`` passage (passages that also
  occur inside documents, so exact and near hits exist);
* ``part.p_name`` / ``customer.c_name`` are the heavy-duplicate and
  single-key cases;
* ``events`` stands in for a query log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.functions.grams import distinct_grams, token_set
from onoma.functions.normalize import normalize_name
from onoma.functions.similarity import py_round
from onoma.operators import candidates as C
from onoma.operators.arriving import add_names, stored_groups, stored_members
from onoma.operators.dedupe import dedupe, dedupe_members, dedupe_report
from onoma.operators.profile import profile_names
from onoma.operators.querylog import (
    last_searches,
    log_from_events,
    log_from_match,
    metrics_summary,
    request_totals,
    rolling_stats,
    tie_shares,
    top_queries,
)
from onoma.operators.keyindex import build_index, open_index
from onoma.operators.ranking import flat_payloads, payloads
from onoma.operators.requests import distinct_request_keys, key_members, validate_requests
from onoma.operators.running import running_stats, whole_stats
from onoma.operators.scoring import score_pairs
from onoma.operators.standardize import standardize
from onoma.plans.answers import match_reusing
from onoma.plans.match import match, match_distinct, match_index, prepare_requests
from onoma.session import ensure_checkpoint_dir, materialize
from onoma.sources import versions
from onoma.sources.names_csv import lenient_rows, load_lenient_reported, strict_rows
from onoma.sources.quoted_csv import fields, records
from onoma.sources.store import load_if_needed, load_report, read_names, upgrade_layout
from onoma.sources.tables import SEGMENT_PATTERN, SEGMENT_STRIDE, column_names, read_table, segment_names, segment_requests

Query = Callable[[SparkSession, str], DataFrame]


# ---- shared inputs -------------------------------------------------------

def doc_names(spark: SparkSession, sf: str) -> DataFrame:
    return standardize(segment_names(spark, sf))


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    return standardize(column_names(spark, sf, "part", "p_partkey", "p_name"))


def customer_names(spark: SparkSession, sf: str) -> DataFrame:
    return standardize(column_names(spark, sf, "customer", "c_custkey", "c_name"))


def bench_requests(spark: SparkSession, sf: str) -> DataFrame:
    return segment_requests(spark, sf)


def param_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark segments with per-request parameters derived from the segment id."""
    base = segment_requests(spark, sf).select("request_id", "name")
    pos = F.col("request_id") % F.lit(SEGMENT_STRIDE)
    return base.select(
        "request_id",
        "name",
        (F.lit(40.0) + F.lit(10.0) * (pos % 4)).alias("threshold"),
        (F.lit(1) + pos % 7).cast("int").alias("limit"),
        ((pos % 11) / F.lit(10.0)).alias("w_token"),
        (pos % 2 == 0).alias("explain"),
        F.lit(True).alias("include_by_id"),
    )


def event_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Raw requests from ``events``: some parameters are out of range on purpose."""
    ev = read_table(spark, sf, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("name"),
        F.col("value").alias("threshold"),
        F.col("user_id").cast("int").alias("limit"),
        (F.col("value") / F.lit(100.0)).alias("w_token"),
    )


# ---- N: standardisation --------------------------------------------------

def q_normalize_documents(spark, sf):
    return doc_names(spark, sf)


def q_normalize_parts(spark, sf):
    return part_names(spark, sf)


# ---- C1: grams and index -------------------------------------------------

def q_gram_frequency(spark, sf):
    postings = doc_names(spark, sf).select("id", F.explode(distinct_grams("normalized_name")).alias("gram"))
    return postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n_ids"))


def q_gram_index(spark, sf):
    return C.gram_index(doc_names(spark, sf))


# ---- D: dedupe -------------------------------------------------------------

def q_dedupe_documents(spark, sf):
    return dedupe(doc_names(spark, sf))


def q_dedupe_members(spark, sf):
    return dedupe_members(doc_names(spark, sf))


def q_dedupe_report(spark, sf):
    return dedupe_report(segment_names(spark, sf), dedupe(doc_names(spark, sf)))


def q_dedupe_customers(spark, sf):
    return dedupe(customer_names(spark, sf))


def q_dedupe_customer_members(spark, sf):
    return dedupe_members(customer_names(spark, sf))


def _arrived(spark: SparkSession, sf: str) -> str:
    """All names of the documents, added in two batches whose ids interleave."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arriving-{uuid.uuid4().hex}"
    names = doc_names(spark, sf)
    first = F.xxhash64("id") < 0
    add_names(names.filter(first), root, "first")
    add_names(names.filter(~first), root, "second")
    return root


def q_dedupe_arriving(spark, sf):
    return stored_groups(spark, _arrived(spark, sf))


def q_dedupe_arriving_members(spark, sf):
    return stored_members(spark, _arrived(spark, sf))


def q_name_profile(spark, sf):
    return profile_names(segment_names(spark, sf))


# ---- C2-C6: candidates -----------------------------------------------------

def q_candidates(spark, sf):
    """Every part name that shares a gram with a benchmark segment, from the stored postings."""
    return C.candidate_ids(prepare_requests(bench_requests(spark, sf)), C.gram_index(part_names(spark, sf)))


def q_candidate_counts(spark, sf):
    res = match(doc_names(spark, sf), bench_requests(spark, sf))
    return res.summary.select("request_id", "q_norm", "fallback", "candidate_count")


def q_fallback(spark, sf):
    """Requests from ``nation`` names: no part name shares a gram with them."""
    nations = read_table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("request_id"), F.col("n_name").alias("name"), F.lit(30.0).alias("threshold")
    )
    return match(part_names(spark, sf), nations).hits


# ---- S/R: the match job ----------------------------------------------------

def q_match_topk(spark, sf):
    return match(doc_names(spark, sf), bench_requests(spark, sf)).hits


def q_match_indexed(spark, sf):
    """The same matches from a stored index: the part names' version is replaced before the match opens it."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    build_index(part_names(spark, sf), root)
    build_index(doc_names(spark, sf), root)
    versions.remove_old(spark, root)
    return match_index(open_index(spark, root), bench_requests(spark, sf)).hits


def q_match_explain(spark, sf):
    reqs = bench_requests(spark, sf).withColumn("explain", F.lit(True))
    return match(doc_names(spark, sf), reqs).hits


def q_match_params(spark, sf):
    return match(doc_names(spark, sf), param_requests(spark, sf)).hits


def q_match_dedupe(spark, sf):
    reps = dedupe(doc_names(spark, sf)).drop("member_count")
    return match(reps, bench_requests(spark, sf)).hits


def q_match_parts(spark, sf):
    """Every part name matched against all part names, equal requests matched once."""
    reqs = column_names(spark, sf, "part", "p_partkey", "p_name").select(
        F.col("id").alias("request_id"), F.col("full_name").alias("name")
    )
    return match_distinct(part_names(spark, sf), reqs)


def q_match_parts_reused(spark, sf):
    """The same as a second batch: the names with an even hash were asked before."""
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reused-{uuid.uuid4().hex}"
    reqs = column_names(spark, sf, "part", "p_partkey", "p_name").select(
        F.col("id").alias("request_id"), F.col("full_name").alias("name")
    )
    index = build_index(part_names(spark, sf), f"{at}/index")
    match_reusing(index, reqs.filter(F.xxhash64("name") % 2 == 0), f"{at}/answers")
    return match_reusing(index, reqs, f"{at}/answers")


def payload_requests(spark, sf):
    """Benchmark segments: every second explained, every third without the by-id map."""
    pos = F.col("request_id") % F.lit(SEGMENT_STRIDE)
    return segment_requests(spark, sf).withColumns({"explain": pos % 2 == 0, "include_by_id": pos % 3 != 0})


def q_match_payload(spark, sf):
    """Ordered lists and by-id maps, one row per listed hit."""
    res = match(doc_names(spark, sf), payload_requests(spark, sf))
    return flat_payloads(payloads(res.hits, res.requests))


def q_match_validated(spark, sf):
    """Mixed valid and invalid requests from ``events`` over part names: one row per request."""
    res = match(part_names(spark, sf), event_requests(spark, sf))
    answered = res.summary.select("request_id", "candidate_count", "n_hits", F.lit(None).cast("string").alias("reason"))
    return answered.unionByName(
        res.rejected.select("request_id", F.lit(0).cast("long").alias("candidate_count"), F.lit(0).cast("long").alias("n_hits"), "reason")
    )


def q_pair_scores(spark, sf):
    """Scores of given pairs: every part's name with its type and brand (S1-S3, no threshold)."""
    part = read_table(spark, sf, "part")
    pairs = part.select(
        F.col("p_partkey").cast("long").alias("id"),
        normalize_name("p_name").alias("normalized_name"),
        normalize_name(F.concat_ws(" ", F.lit("ring"), "p_type", "p_brand")).alias("q_norm"),
        F.lit(0.65).alias("w_token"),
        F.lit(0.0).alias("threshold"),
    ).withColumns({"tokens": token_set("normalized_name"), "q_tokens": token_set("q_norm")})
    return score_pairs(pairs, prune=False).select(
        "id", "q_norm", *[py_round(F.col(f"{c}_raw"), 2).alias(c) for c in ("token", "edit", "similarity")]
    )


def q_tie_stats(spark, sf):
    res = match(doc_names(spark, sf), bench_requests(spark, sf))
    return res.summary.filter(F.col("tie_groups") > 0).select("request_id", "tie_groups", "by_token", "by_edit", "by_id")


def q_request_validation(spark, sf):
    valid, rejected = validate_requests(event_requests(spark, sf))
    return valid.select("request_id", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("request_id", "reason")
    )


def q_distinct_requests(spark, sf):
    reqs = prepare_requests(column_names(spark, sf, "part", "p_partkey", "p_name").select(
        F.col("id").alias("request_id"), F.col("full_name").alias("name")
    ))
    return key_members(reqs, distinct_request_keys(reqs))


# ---- M/T: query log ------------------------------------------------------

def q_log_totals(spark, sf):
    return request_totals(log_from_events(read_table(spark, sf, "events")))


def q_log_rolling(spark, sf):
    return rolling_stats(log_from_events(read_table(spark, sf, "events")))


def q_log_running(spark, sf):
    """Mean and p95 over the newest 5,000 searches, at every search."""
    return running_stats(log_from_events(read_table(spark, sf, "events")))


def q_log_percentiles(spark, sf):
    """p95 over all searches."""
    return whole_stats(log_from_events(read_table(spark, sf, "events")))


def q_log_last_n(spark, sf):
    return last_searches(log_from_events(read_table(spark, sf, "events"))).select("seq", "query_norm", "latency_ms", "candidate_count")


def q_top_queries(spark, sf):
    return top_queries(log_from_events(read_table(spark, sf, "events")))


def q_metrics_summary(spark, sf):
    """The whole record; the query list as text and the load report as columns."""
    report = load_report(part_names(spark, sf), "parquet", "original", "part.parquet")
    one = metrics_summary(log_from_events(read_table(spark, sf, "events")), report=report)
    top = F.array_join(F.transform("top_queries", lambda q: F.concat(q["query"], F.lit("="), q["count"].cast("string"))), ", ")
    return one.select(*[c for c in one.columns if c not in ("top_queries", "repo")], top.alias("top_queries"), "repo.*")


def q_match_log_ties(spark, sf):
    res = match(doc_names(spark, sf), bench_requests(spark, sf))
    return tie_shares(log_from_match(res.requests, res.summary))


# ---- D5 / I: modes and loading ---------------------------------------------

def clean_names(spark, sf):
    """Raw names with a curated ``strict_key``: the key's words in order; empty for every fourth segment."""
    raw = segment_names(spark, sf)
    words = F.array_join(token_set(normalize_name("full_name")), " ")
    return raw.withColumn("strict_key", F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(words))


def q_mode_comparison(spark, sf):
    """Size, hits and ranking quality of the three dataset modes; the standardised ones use the stored key."""
    reqs = bench_requests(spark, sf)
    clean = clean_names(spark, sf)
    modes = {
        "original": standardize(clean, "original"),
        "standardized": standardize(clean, "standardized"),
        "standardized+dedupe": dedupe(standardize(clean, "standardized+dedupe")).drop("member_count"),
    }
    parts = []
    for mode, names in modes.items():
        res = match(names, reqs)
        first = res.display.filter("rank = 1").select("request_id", F.col("similarity").alias("top_similarity"))
        parts.append(
            res.summary.join(first, "request_id", "left").agg(
                F.count(F.lit(1)).alias("requests"),
                F.sum("candidate_count").alias("candidates"),
                F.sum("n_hits").alias("hits"),
                F.count_if(F.col("n_hits") > 0).alias("answered"),
                F.count_if(F.col("top_similarity") == 100.0).alias("exact_first"),
            ).select(F.lit(mode).alias("mode"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def q_normalize_untrimmed(spark, sf):
    """Titles before untrimmed segments, blank ones included: the trimming rules at both ends."""
    docs = read_table(spark, sf, "documents")
    segs = docs.select("doc_id", F.posexplode(F.split("text", SEGMENT_PATTERN)).alias("pos", "seg"))
    titles = F.array(*[F.lit(t) for t in ("Dr.", "Ing", "prof.", "x", "\u00a0Lic.", "SRTA")])
    name = F.concat(F.element_at(titles, (F.col("pos") % 6 + 1).cast("int")), F.lit(" "), F.col("seg"), F.lit("\t"))
    return segs.select("doc_id", "pos", normalize_name(name).alias("normalized_name"))


def _strict_body(spark, sf):
    sup = read_table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    body = sup.select(
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(key).alias("_c0"),
        F.concat(F.lit("Dr. "), F.col("s_name")).alias("_c1"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("KEY "), key)).alias("_c2"),
        F.concat(key, F.lit(" ")).alias("_c3"),
    )
    return body, ["id", "Full Name", "strict_key", "ID "]


def q_load_strict(spark, sf):
    """Strict loader rules over ``supplier``: alias priority per row, keys normalised."""
    return strict_rows(*_strict_body(spark, sf), "original")


def q_load_strict_key(spark, sf):
    """The same rows in the standardised mode: a stored key is used as is, an empty one recomputed."""
    return strict_rows(*_strict_body(spark, sf), "standardized")


def _lenient_body(spark, sf):
    cust = read_table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    body = cust.select(
        F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), key)).otherwise(F.concat(F.lit("\t"), key, F.lit(" "))).alias("_c0"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(" \t")).when(F.col("c_custkey") % 13 == 0, F.lit("#12"))
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "), F.col("c_name"), F.lit("\t"))).alias("_c1"),
        F.lit("ignored").alias("_c2"),
    )
    return body, [" IDX", "Nombre ", "extra"]


def q_load_lenient(spark, sf):
    """Lenient loader rules over ``customer``: bad ids, blank names and empty keys drop out."""
    return lenient_rows(*_lenient_body(spark, sf))


def q_load_quoted(spark, sf):
    """Every document as a CSV record whose text keeps its line breaks and quotes, read back by byte ranges."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quoted-{uuid.uuid4().hex}"
    quote = F.lit('"')
    docs = read_table(spark, sf, "documents").select(
        F.concat(quote, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit('","'),
                 F.replace(F.coalesce("text", F.lit("")), quote, F.lit('""')), quote)
    )
    docs.write.option("lineSep", "\n").text(path)
    text = F.coalesce("r._c1", F.lit(""))
    return records(spark, path).select(fields("record", 2).alias("r")).select(
        F.col("r._c0").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.regexp_count(text, F.lit("\n")).cast("long").alias("n_breaks"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def q_lenient_report(spark, sf):
    """What that load kept and dropped, counted on the pass that stores it."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lenient-{uuid.uuid4().hex}"
    return load_lenient_reported(*_lenient_body(spark, sf), "original", lambda rows: rows.write.parquet(root))


def q_store_reload(spark, sf):
    """Load-if-empty over part names: loaded, kept, reloaded; rows scanned after each step."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    names = part_names(spark, sf)
    steps = []
    for step, force in (("first", False), ("again", False), ("forced", True)):
        loaded = load_if_needed(spark, names, root, "original", force)
        scan = read_names(spark, root, "original").agg(F.count(F.lit(1)).alias("records"))
        steps.append(materialize(  # the next step replaces the files that this one reads
            scan.select(F.lit(step).alias("step"), F.lit(loaded).cast("long").alias("loaded_rows"), "records"), "store-step"
        ))
    return reduce(DataFrame.unionByName, steps)


def q_legacy_layout(spark, sf):
    part = read_table(spark, sf, "part")
    old = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return upgrade_layout(old)


def q_load_report(spark, sf):
    return load_report(part_names(spark, sf), "parquet", "original", "part.parquet")


# ---- ST: streaming ---------------------------------------------------------

def _stream(spark, sf):
    from onoma.streaming.match_stream import start_match_stream

    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/stream-{uuid.uuid4().hex}"
    reqs = bench_requests(spark, sf)
    reqs.repartition(3, "request_id").write.parquet(f"{run}/requests")
    query = start_match_stream(
        spark, doc_names(spark, sf), f"{run}/requests", reqs.schema, f"{run}/out", f"{run}/ckpt"
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return f"{run}/out"


def q_stream_match(spark, sf):
    """Benchmark requests arrive as parquet files; each micro-batch is matched."""
    from onoma.streaming.match_stream import read_stream_hits

    return read_stream_hits(spark, _stream(spark, sf))


def q_stream_log(spark, sf):
    """The log that the stream leaves, by query: whichever batch came first, one request of each searched."""
    from onoma.streaming.match_stream import read_stream_log

    log = read_stream_log(spark, _stream(spark, sf))
    return log.groupBy("query_norm").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("is_repeat")).alias("searches"),
        F.max("candidate_count").alias("candidate_count"), F.max("tie_groups").alias("tie_groups"),
    )


QUERIES: dict[str, Query] = {
    "normalize_documents": q_normalize_documents,
    "normalize_parts": q_normalize_parts,
    "gram_frequency": q_gram_frequency,
    "gram_index": q_gram_index,
    "dedupe_documents": q_dedupe_documents,
    "dedupe_members": q_dedupe_members,
    "dedupe_report": q_dedupe_report,
    "dedupe_customers": q_dedupe_customers,
    "dedupe_customer_members": q_dedupe_customer_members,
    "dedupe_arriving": q_dedupe_arriving,
    "dedupe_arriving_members": q_dedupe_arriving_members,
    "name_profile": q_name_profile,
    "candidates": q_candidates,
    "candidate_counts": q_candidate_counts,
    "fallback": q_fallback,
    "match_topk": q_match_topk,
    "match_indexed": q_match_indexed,
    "match_explain": q_match_explain,
    "match_params": q_match_params,
    "match_dedupe": q_match_dedupe,
    "match_parts": q_match_parts,
    "match_parts_reused": q_match_parts_reused,
    "match_payload": q_match_payload,
    "tie_stats": q_tie_stats,
    "request_validation": q_request_validation,
    "distinct_requests": q_distinct_requests,
    "log_totals": q_log_totals,
    "log_rolling": q_log_rolling,
    "log_running": q_log_running,
    "log_percentiles": q_log_percentiles,
    "log_last_n": q_log_last_n,
    "top_queries": q_top_queries,
    "metrics_summary": q_metrics_summary,
    "match_log_ties": q_match_log_ties,
    "mode_comparison": q_mode_comparison,
    "legacy_layout": q_legacy_layout,
    "load_report": q_load_report,
    "stream_match": q_stream_match,
    "match_validated": q_match_validated,
    "pair_scores": q_pair_scores,
    "normalize_untrimmed": q_normalize_untrimmed,
    "load_strict": q_load_strict,
    "load_strict_key": q_load_strict_key,
    "load_lenient": q_load_lenient,
    "load_quoted": q_load_quoted,
    "lenient_report": q_lenient_report,
    "store_reload": q_store_reload,
    "stream_log": q_stream_log,
}
