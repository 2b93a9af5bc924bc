"""Persisted standardised name table.

The table lives as parquet under a path that includes the mode, so changing
mode never serves the other mode's rows. A refresh writes a version of its own
and switches to it last (``versions``): readers see the old rows or the new
ones, and a load that fails leaves the old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from onoma.functions.normalize import normalize_name
from onoma.operators.standardize import resolve_mode
from onoma.sources import versions

TABLE_COLUMNS = ["id", "full_name", "normalized_name"]


def table_path(root: str, mode: str) -> str:
    return f"{root.rstrip('/')}/names/mode={resolve_mode(mode).replace('+', '_')}"


def duplicate_ids(names: DataFrame) -> DataFrame:
    """Ids held by more than one row (they would break the primary key)."""
    return names.groupBy("id").count().filter(F.col("count") > 1)


def write_names(names: DataFrame, root: str, mode: str) -> int:
    """Full refresh of the table; fails on duplicate ids. Returns rows written."""
    if duplicate_ids(names).limit(1).count():
        raise ValueError("duplicate ids in the name table")
    spark = names.sparkSession
    path = versions.publish(spark, table_path(root, mode), lambda at: names.select(*TABLE_COLUMNS).write.parquet(at))
    return spark.read.parquet(path).count()


def read_names(spark: SparkSession, root: str, mode: str) -> DataFrame:
    """I8: scan the table's current version; the reader keeps it through later refreshes."""
    path = table_path(root, mode)
    return spark.read.parquet(versions.current(spark, path) or path).select(*TABLE_COLUMNS)


def remove_old_names(spark: SparkSession, root: str, mode: str, keep: int = 1) -> int:
    """Remove replaced versions of the table that no reader needs any more."""
    return versions.remove_old(spark, table_path(root, mode), keep)


def has_rows(spark: SparkSession, root: str, mode: str) -> bool:
    try:
        return not read_names(spark, root, mode).isEmpty()
    except AnalysisException:
        return False


def load_if_needed(spark: SparkSession, source: DataFrame, root: str, mode: str, force_reload: bool = False) -> int:
    """Reload when forced or when the table is missing/empty; -1 when kept."""
    if force_reload or not has_rows(spark, root, mode):
        return write_names(source, root, mode)
    return -1


def upgrade_layout(old: DataFrame) -> DataFrame:
    """Bring an old layout to (id, full_name, normalized_name).

    Old layouts name the text column ``name`` or ``Full Name`` and may lack
    ``normalized_name``; a missing or empty key is recomputed (not left
    empty). Rows without a text are dropped. An unknown layout gives an empty
    table.
    """
    cols = set(old.columns)
    if "full_name" in cols:
        text = F.col("full_name")
    elif "name" in cols:
        text = F.col("name")
    elif "Full Name" in cols:
        text = F.col("`Full Name`")
    else:
        return old.sparkSession.createDataFrame([], "id long, full_name string, normalized_name string")
    key = F.col("normalized_name") if "normalized_name" in cols else F.lit(None).cast("string")
    return old.select(
        F.col("id").cast("long").alias("id"),
        text.cast("string").alias("full_name"),
        F.coalesce(F.nullif(key, F.lit("")), normalize_name(text)).alias("normalized_name"),
    ).filter(F.col("full_name").isNotNull())


def load_report(names: DataFrame, storage: str, mode: str, dataset: str, loaded_rows: int | None = None) -> DataFrame:
    """One row describing the loaded table."""
    return names.agg(F.count(F.lit(1)).alias("records")).select(
        F.lit(storage).alias("storage"),
        F.lit(resolve_mode(mode)).alias("dataset_mode"),
        F.lit(dataset).alias("dataset_path"),
        F.lit(loaded_rows).cast("long").alias("loaded_rows"),
        "records",
    )
