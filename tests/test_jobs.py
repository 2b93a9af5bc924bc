"""Dedupe, loaders, query-log analytics, profile and streaming."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

import pyref
from onoma.operators.dedupe import dedupe, dedupe_members, dedupe_report, group_ids
from onoma.operators.profile import profile_names
from onoma.operators.querylog import (
    last_searches,
    mark_repeats,
    metrics_summary,
    request_totals,
    rolling_stats,
    top_queries,
)
from onoma.operators.requests import validate_requests
from onoma.sources.names_csv import dataset_path, read_names_lenient, read_names_strict
from onoma.sources.store import load_if_needed, read_names, upgrade_layout, write_names


def _scratch():
    return tempfile.mkdtemp(prefix="onoma-test-", dir="/tmp")


def test_dedupe_groups(spark):
    rows = [(5, "Dr. Ana Gómez"), (2, "ana gomez"), (9, "ANA GOMEZ!!"), (3, "Juan"), (4, "123")]
    from onoma.operators.standardize import standardize

    names = standardize(spark.createDataFrame(rows, "id long, full_name string"))
    reps = {r.normalized_name: r for r in dedupe(names).collect()}
    assert set(reps) == {"ana gomez", "juan"}
    assert (reps["ana gomez"].id, reps["ana gomez"].full_name, reps["ana gomez"].member_count) == (2, "ana gomez", 3)
    members = dedupe_members(names)
    assert [r.member_id for r in group_ids(members, 2).collect()] == [2, 5, 9]
    rep = dedupe_report(names, dedupe(names)).collect()[0]
    assert (rep.sot_rows, rep.search_rows, rep.dedupe_ratio) == (5, 2, 0.4)


def test_dedupe_single_hot_key(spark):
    """Every customer name standardises to one key: one group, all members kept."""
    from onoma.plans.catalog import customer_names

    names = customer_names(spark, "/root/testdata/sf0.001")
    n = names.count()
    reps = dedupe(names).collect()
    assert len(reps) == 1 and reps[0].member_count == n
    assert dedupe_members(names).select("rep_id").distinct().count() == 1
    assert dedupe_members(names).count() == n


def test_dedupe_computes_each_key_once(spark):
    """Empty and null keys drop out as groups; no filter below the aggregation repeats the key's expression."""
    from onoma.operators.standardize import standardize

    rows = [(1, "123"), (2, None), (7, "Ana"), (3, "ana"), (4, " ")]
    reps = dedupe(standardize(spark.createDataFrame(rows, "id long, full_name string")))
    assert [tuple(r) for r in reps.collect()] == [(3, "ana", "ana", 2)]
    plan = reps._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Aggregate") :]
    assert dedupe(standardize(spark.createDataFrame([], "id long, full_name string"))).count() == 0


def test_csv_loaders(spark):
    d = _scratch()
    strict = os.path.join(d, "strict.csv")
    with open(strict, "w", encoding="utf-8") as f:
        f.write('ID,Full Name\n 1 ,"Dr. Ana, Gómez"\n2,"Juan ""JJ"" Perez"\n')
    got = {r.id: r for r in read_names_strict(spark, strict).collect()}
    assert got[1].full_name == "Dr. Ana, Gómez" and got[1].normalized_name == "ana gomez"
    assert got[2].normalized_name == "juan jj perez"

    clean = os.path.join(d, "clean.csv")
    with open(clean, "w", encoding="utf-8") as f:
        f.write("ID,Full Name,name_strict,strict_key\n1,Ana Gómez,x,KEY ONE\n2,Juan,x,\n")
    got = {r.id: r.normalized_name for r in read_names_strict(spark, clean, "standardized").collect()}
    assert got == {1: "KEY ONE", 2: "juan"}

    broken = os.path.join(d, "broken.csv")
    with open(broken, "w", encoding="utf-8") as f:
        f.write("ID,Full Name\n1,\n")
    with pytest.raises(ValueError):
        read_names_strict(spark, broken)

    lenient = os.path.join(d, "lenient.csv")
    with open(lenient, "w", encoding="utf-8-sig") as f:
        f.write(" IDX ,Extra, Full Name \n1,a,Ana\nx,b,Bad Id\n3,c,   \n4,d,!!\n5,e,Luis\n")
    got = {r.id: r.normalized_name for r in read_names_lenient(spark, lenient).collect()}
    assert got == {1: "ana", 5: "luis"}

    assert dataset_path("/data", "Standardized+Dedupe ").endswith("clean/names_dataset_standardized.csv")
    assert dataset_path("/data", "weird").endswith("raw/names_dataset.csv")


def test_store_and_legacy(spark):
    root = _scratch()
    names = spark.createDataFrame([(1, "Ana", "ana"), (2, "Luis", "luis")], "id long, full_name string, normalized_name string")
    assert load_if_needed(spark, names, root, "original") == 2
    assert load_if_needed(spark, names, root, "original") == -1
    assert read_names(spark, root, "original").count() == 2
    dup = names.unionByName(names)
    with pytest.raises(ValueError):
        write_names(dup, root, "standardized")
    old = spark.createDataFrame([(1, "Dr. Ana", ""), (2, "Luis", "luis")], "id long, name string, normalized_name string")
    assert {r.id: r.normalized_name for r in upgrade_layout(old).collect()} == {1: "ana", 2: "luis"}
    odd = spark.createDataFrame([(1, "x")], "id long, other string")
    assert upgrade_layout(odd).count() == 0


def _log(spark, rows):
    df = spark.createDataFrame(rows, "seq long, query_norm string, latency_ms double, candidate_count long")
    for c in ("tie_groups", "by_token", "by_edit", "by_id"):
        df = df.withColumn(c, F.lit(0).cast("long"))
    return mark_repeats(df, ["query_norm"])


@pytest.mark.parametrize("n", [0, 1, 10, 20, 21])
def test_p95_positions(spark, n):
    rows = [(i, f"q{i}", float(i), i) for i in range(n)]
    if n == 0:
        rows = [(0, "a", 1.0, 1), (1, "a", 2.0, 2)]
        log = _log(spark, rows).filter("seq > 0")
    else:
        log = _log(spark, rows)
    got = rolling_stats(log).collect()[0]
    assert pyref.is_p95(got.latency_ms_p95, [float(i) for i in range(n)])


def test_totals_and_top_queries(spark):
    rows = [(1, "b", 5.0, 3), (2, "a", 7.0, 4), (3, "b", 1.0, 1), (4, "a", 1.0, 1), (5, "c", 2.0, 2)]
    log = _log(spark, rows)
    t = request_totals(log).collect()[0]
    assert (t.total_requests, t.total_cache_hits, t.cache_hit_rate) == (5, 2, 0.4)
    top = [(r.query, r["count"]) for r in top_queries(log).orderBy("position").collect()]
    assert top == [("b", 2), ("a", 2), ("c", 1)]
    assert [r.seq for r in last_searches(log, 2).collect()] == [5, 2]
    m = metrics_summary(log).collect()[0]
    assert m.latency_ms_avg == round((5.0 + 7.0 + 2.0) / 3, 2)


def test_request_validation(spark):
    raw = spark.createDataFrame(
        [(1, "ana", 50.0, 5, 0.5), (2, "ana", 150.0, 5, 0.5), (3, "ana", 50.0, 0, 0.5), (4, "ana", 50.0, 5, 1.5), (5, None, 50.0, 5, 0.5), (6, "x", None, None, None)],
        "request_id long, name string, threshold double, limit int, w_token double",
    )
    valid, rejected = validate_requests(raw)
    assert sorted(r.request_id for r in valid.collect()) == [1, 6]
    reasons = {r.request_id: r.reason for r in rejected.collect()}
    assert reasons[2].startswith("threshold") and reasons[3].startswith("limit")
    assert reasons[4].startswith("w_token") and reasons[5].startswith("name")


def test_profile(spark):
    rows = [(1, "Dr. Ana Gómez"), (2, "ana  gomez"), (3, "Luis!"), (4, "123")]
    p = profile_names(spark.createDataFrame(rows, "id long, full_name string")).collect()[0]
    assert (p.rows, p.with_accents, p.with_titles, p.with_symbols, p.with_extra_spaces) == (4, 1, 1, 3, 1)
    assert (p.empty_keys, p.distinct_keys, p.duplicate_rows) == (1, 2, 1)


def test_stream_equals_batch(spark):
    from onoma.plans import catalog

    sf = "/root/testdata/sf0.001"
    stream_df = catalog.q_stream_match(spark, sf)
    streamed = {tuple(r) for r in stream_df.collect()}
    batch = {tuple(r) for r in catalog.q_match_topk(spark, sf).select(*stream_df.columns).collect()}
    assert streamed == batch and streamed


def test_rolling_window_takes_the_newest_searches(spark):
    """A log of more searches than the window holds."""
    log = spark.range(6500).selectExpr(
        "id AS seq", "concat('q', id) AS query_norm", "CAST(id AS DOUBLE) AS latency_ms", "id AS candidate_count",
        "0L AS tie_groups", "0L AS by_token", "0L AS by_edit", "0L AS by_id", "false AS is_repeat",
    )
    got = metrics_summary(log).first()
    newest = [float(i) for i in range(1500, 6500)]
    assert got.total_requests == 6500
    assert got.latency_ms_avg == sum(newest) / len(newest)
    assert pyref.is_p95(got.latency_ms_p95, newest) and pyref.is_p95(got.candidates_p95, newest)
    assert [(q["query"], q["count"]) for q in got.top_queries] == [(f"q{i}", 1) for i in range(10)]


def test_metrics_scan_the_log_once_written(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from onoma.operators.querylog import log_from_events

    plan = metrics_summary(log_from_events(events))._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan


def test_stream_log_marks_repeats_once(spark, tmp_path):
    """Two batches and a replay: each key is searched once, whatever the order of its requests."""
    from onoma.streaming.match_stream import batch_writer, read_stream_log, standing_index

    names = spark.createDataFrame([(1, "Ana Ruiz", "ana ruiz")], "id long, full_name string, normalized_name string")
    write = batch_writer(standing_index(names, f"{tmp_path}/index"), str(tmp_path))
    schema = "request_id long, name string"
    first = spark.createDataFrame([(5, "Ana Ruiz"), (6, "ana ruiz"), (7, "luis")], schema)
    second = spark.createDataFrame([(1, "ANA RUIZ"), (2, "luis"), (3, "eva"), (4, None)], schema)
    for batch, i in ((first, 0), (second, 1), (second, 1)):
        write(batch, i)
    log = {r.seq: r.is_repeat for r in read_stream_log(spark, str(tmp_path)).collect()}
    assert log == {5: False, 6: True, 7: False, 1: True, 2: True, 3: False}
    assert spark.read.parquet(f"{tmp_path}/rejected").count() == 1


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from onoma.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)
