"""Dedupe of names that arrive in batches (D1, D2 kept up to date).

A group is a minimum, the name at the minimum and a count, all of which merge.
A batch therefore writes only what it brings: its rows and one partial group
for each of its keys, whatever is stored already. Reading merges the partial
groups by key, so a lower id that arrives later becomes the representative
without any stored row being rewritten. Membership is kept by key, not by
representative, and needs no change either; ``compact`` merges the parts when
there are many.

A batch meets the stored parts twice: its keys, to tell which representatives
are new or change, and its ids, which must not be stored yet. Both read only
the columns they need, and a key that many rows share is one row for each map
task before it is shuffled. Of the first, only the keys that were stored before
are written, with their representatives: what the batch changed follows from
them and its own groups, whose folder has the same name and stays when parts
are merged.

Batches are published by a pointer (``sources.versions``): readers see a batch
whole or not at all, and a batch that is sent again is not added again. One
writer adds at a time.

Rows with an empty or null key belong to no group and are not stored. A null
id, or an id that stands twice in a batch or is stored already, raises before
anything is published. An empty batch is recorded and brings nothing; other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from onoma.sources import versions

ROWS = "id long, full_name string, normalized_name string"
GROUPS = ROWS + ", member_count long"
CHANGES = "normalized_name string, old_id long, id long, full_name string, member_count long"
MET = "normalized_name string, old_id long"
_MANIFEST = "batch_id string, part string, changes string"


def _manifest(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """(batch, its part, its met keys) of every batch: names of folders, one row a batch."""
    at = versions.current(spark, root)
    if at is None:
        return []
    return sorted(tuple(r) for r in spark.read.schema(_MANIFEST).parquet(at).collect())


def _publish(spark: SparkSession, root: str, entries: list[tuple[str, str, str]]) -> None:
    versions.publish(spark, root, lambda at: spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.parquet(at))


def _parts(spark: SparkSession, entries: list[tuple[str, str, str]], table: str, schema: str) -> DataFrame:
    folders = sorted({part for _, part, _ in entries})
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{f}/{table}" for f in folders])


def _write(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def _merged(partial: DataFrame) -> DataFrame:
    return partial.groupBy("normalized_name").agg(
        F.min("id").alias("id"), F.min_by("full_name", "id").alias("full_name"), F.sum("member_count").alias("member_count")
    ).select("id", "full_name", "normalized_name", "member_count")


def add_names(names: DataFrame, root: str, batch_id: str) -> bool:
    """Add a batch of standardised names; False where ``batch_id`` has been added before."""
    spark, root = names.sparkSession, root.rstrip("/")
    known = _manifest(spark, root)
    if any(b == batch_id for b, _, _ in known):
        return False
    name = uuid.uuid4().hex
    part, met = f"{root}/_parts/{name}", f"{root}/_met/{name}"
    seen = Observation()
    kept = names.observe(seen, F.count_if(F.col("id").isNull()).alias("unnamed")).filter(F.length("normalized_name") > 0)
    _write(kept.select(F.col("id").cast("long"), "full_name", "normalized_name"), f"{part}/rows")
    if seen.get["unnamed"]:
        raise ValueError("a name without an id")
    rows = spark.read.schema(ROWS).parquet(f"{part}/rows")
    ids = rows.select("id", F.lit(1).alias("new"))
    if known:
        ids = ids.unionByName(_parts(spark, known, "rows", ROWS).select("id", F.lit(0).alias("new")))
    twice = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("new")).filter("n > 1 AND new > 0")
    most = twice.agg(F.max("new")).first()[0]
    if most is not None:
        raise ValueError("duplicate ids in the batch" if most > 1 else "ids of the batch are stored already")

    _write(_merged(rows.withColumn("member_count", F.lit(1).cast("long"))), f"{part}/groups")
    groups = spark.read.schema(GROUPS).parquet(f"{part}/groups")
    before = _parts(spark, known, "groups", GROUPS) if known else groups.limit(0)
    before = before.groupBy("normalized_name").agg(F.min("id").alias("old_id"))
    _write(before.join(groups.select("normalized_name"), "normalized_name", "left_semi") if known else before, met)
    _publish(spark, root, [*known, (batch_id, part, met)])
    return True


def stored_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row per key over all batches, as ``dedupe`` gives for their union."""
    return _merged(_parts(spark, _manifest(spark, root), "groups", GROUPS))


def stored_members(spark: SparkSession, root: str) -> DataFrame:
    """(rep_id, member_id) over all batches, as ``dedupe_members`` gives for their union."""
    entries = _manifest(spark, root)
    reps = _merged(_parts(spark, entries, "groups", GROUPS)).select("normalized_name", F.col("id").alias("rep_id"))
    rows = _parts(spark, entries, "rows", ROWS).select("normalized_name", F.col("id").alias("member_id"))
    return rows.join(reps, "normalized_name").select("rep_id", "member_id")


def batch_changes(spark: SparkSession, root: str, batch_id: str) -> DataFrame:
    """Representatives that a batch brought: (normalized_name, old_id, id, full_name, member_count).

    ``old_id`` is null for a new group; ``member_count`` counts the batch's members.
    """
    entries = _manifest(spark, root)
    for batch, _, at in entries:
        if batch != batch_id:
            continue
        if "/_changes/" in at:  # stored before the met keys were: the changes themselves
            return spark.read.schema(CHANGES).parquet(at)
        part = "/_parts/".join(at.rsplit("/_met/", 1))
        groups = spark.read.schema(GROUPS).parquet(f"{part}/groups")
        return (
            groups.join(spark.read.schema(MET).parquet(at), "normalized_name", "left")
            .filter(F.col("old_id").isNull() | (F.col("id") < F.col("old_id")))
            .select("normalized_name", "old_id", "id", "full_name", "member_count")
        )
    raise ValueError(f"no batch {batch_id}")


def compact(spark: SparkSession, root: str) -> None:
    """Merge all parts into one; what readers see stays the same."""
    root = root.rstrip("/")
    entries = _manifest(spark, root)
    if len({part for _, part, _ in entries}) < 2:
        return
    part = f"{root}/_parts/{uuid.uuid4().hex}"
    _parts(spark, entries, "rows", ROWS).write.parquet(f"{part}/rows")
    _merged(_parts(spark, entries, "groups", GROUPS)).write.parquet(f"{part}/groups")
    _publish(spark, root, [(batch, part, changes) for batch, _, changes in entries])
