"""Stored index, versions, the standing index of a stream, the lenient report."""

import pytest
from pyspark.sql import functions as F

import pyref
from onoma.operators import keyindex, probe
from onoma.operators.keyindex import build_index, open_index
from onoma.operators.standardize import standardize
from onoma.plans.match import match, match_index
from onoma.sources import versions
from onoma.sources.names_csv import load_lenient_reported
from onoma.sources.store import read_names, remove_old_names, write_names
from onoma.sources.tables import segment_names, segment_requests

SF = "/root/testdata/sf0.001"
NAMES = "id long, full_name string, normalized_name string"


def hits(res):
    return sorted(tuple(r) for r in res.hits.collect())


def test_index_serves_many_matches_and_versions(spark, names_df, tmp_path):
    root = str(tmp_path)
    assert open_index(spark, root) is None
    first = build_index(names_df, root)
    reqs = spark.createDataFrame([(1, "Juan Perez"), (2, "an"), (3, "xyzxyz")], "request_id long, name string")
    assert hits(match_index(open_index(spark, root), reqs)) == hits(match(names_df, reqs))
    with pytest.raises(ValueError, match="record ids"):
        build_index(names_df.unionByName(names_df), root)
    assert open_index(spark, root).path == first.path
    second = build_index(names_df.filter("id > 3"), root)
    assert open_index(spark, root).path == second.path
    # a reader of the replaced version still reads it
    assert hits(match_index(first, reqs)) == hits(match(names_df, reqs))
    assert versions.remove_old(spark, root) == 1
    assert hits(match_index(open_index(spark, root), reqs)) == hits(match(names_df.filter("id > 3"), reqs))


@pytest.mark.parametrize("lot_keys", [3, 8192])
def test_bounds_drop_no_hit(spark, monkeypatch, lot_keys):
    """Every pair of odd keys against plain scores, at several thresholds and weights; lots of any size."""
    monkeypatch.setattr(keyindex, "LOT_KEYS", lot_keys)
    keys = ["", "a", "an", "ana", "ana ana", "ana ruiz", "ruiz ana", "anaruiz", "Ana Ruiz", "z" * 300, "z z z z", "àé ïõ", "a" * 90 + " b", "b " + "a" * 90, "juan carlos perez gomez", "gomez perez"]
    names = spark.createDataFrame([(i, k, k) for i, k in enumerate(keys)], NAMES)
    asked = [k for k in keys if k == "" or (k.isascii() and k.islower())]
    schema = "request_id long, name string, threshold double, w_token double, limit int"
    rows = [(100 * i + 10 * j + l, q, t, w, 100) for i, q in enumerate(asked) for j, t in enumerate((0.0, 30.0, 70.0, 100.0)) for l, w in enumerate((0.0, 0.65, 1.0))]
    got = {}
    for r in match(names, spark.createDataFrame(rows, schema)).display.collect():
        got.setdefault(r["request_id"], set()).add(r["id"])
    for rid, q, t, w, _ in rows:
        near = [k for k in keys if pyref.share_gram(q, k)] or keys
        want = {keys.index(k) for k in near if w * pyref.token_set_ratio(q, k) + (1 - w) * pyref.ratio(q, k) >= t}
        assert got.get(rid, set()) == want, (q, t, w)


def test_few_pairs_are_scored(spark):
    res = match(standardize(segment_names(spark, SF)), segment_requests(spark, SF))
    scored = res.work.agg(F.sum("scored")).first()[0]
    candidates = res.summary.agg(F.sum("candidate_count")).first()[0]
    assert 0 < 10 * scored < candidates


def test_blocks_of_requests_give_the_same_hits(spark, names_df, monkeypatch):
    reqs = spark.createDataFrame([(i, n) for i, n in enumerate(["Juan Perez", "ana", "an", "juan perez", "q", "maria"])], "request_id long, name string")
    whole = hits(match(names_df, reqs))
    monkeypatch.setattr(probe, "BLOCK_REQUESTS", 1)
    assert hits(match(names_df, reqs)) == whole


def test_stream_indexes_names_once(spark, names_df, tmp_path):
    """Batches add tables of their own; the index folder stays as it was."""
    from onoma.streaming.match_stream import batch_writer, standing_index

    index = standing_index(names_df, f"{tmp_path}/index")
    before = sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "index").rglob("*"))
    write = batch_writer(index, str(tmp_path / "out"))
    for i in range(3):
        write(spark.createDataFrame([(i, "Juan Perez")], "request_id long, name string"), i)
    assert sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "index").rglob("*")) == before
    assert standing_index(names_df, f"{tmp_path}/index").path == index.path
    assert spark.read.parquet(f"{tmp_path}/out/hits").count() == 9


def test_failed_refresh_leaves_the_old_rows(spark, tmp_path):
    root = str(tmp_path)
    names = spark.createDataFrame([(1, "Ana", "ana")], NAMES)
    assert write_names(names, root, "original") == 1
    held = read_names(spark, root, "original")
    broken = names.withColumn("full_name", F.raise_error(F.lit("lost the source")).cast("string"))
    with pytest.raises(Exception, match="lost the source"):
        write_names(broken, root, "original")
    assert read_names(spark, root, "original").collect() == names.collect()
    assert write_names(names.unionByName(spark.createDataFrame([(2, "Eva", "eva")], NAMES)), root, "original") == 2
    assert held.count() == 1 and read_names(spark, root, "original").count() == 2
    assert remove_old_names(spark, root, "original") == 1
    assert read_names(spark, root, "original").count() == 2


def test_lenient_report_counts_each_row_once(spark, tmp_path):
    rows = [("1", "Ana"), ("x", "Eva"), (None, None), ("2", " "), ("3", None), ("4", "#12"), (" 5 ", " Luis ")]
    body = spark.createDataFrame(rows, "_c0 string, _c1 string")
    report = load_lenient_reported(body, ["ID", "Nombre"], "original", lambda df: df.write.parquet(f"{tmp_path}/kept"))
    assert tuple(report.first()) == ("original", 7, 2, 2, 2, 1, 2 / 7)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [1, 5]
    nothing = load_lenient_reported(body.limit(0), ["ID", "Nombre"], "original", lambda df: df.write.parquet(f"{tmp_path}/none"))
    assert tuple(nothing.first())[1:] == (0, 0, 0, 0, 0, 1.0)
