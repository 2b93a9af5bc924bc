"""Name CSV loaders.

Both loaders read every column as text (no inference) and pick the id and
name columns by header alias. Spark renames duplicate header names, so the
header is read by position from the file's first line first.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from onoma.functions.normalize import strip_space
from onoma.operators.standardize import STANDARD_MODES, resolve_mode, standardize
from onoma.sources.quoted_csv import read_quoted

# Accepted header aliases, in priority order.
STRICT_ID_ALIASES = ["id", "ID", "Id", "ID "]
STRICT_NAME_ALIASES = ["name", "Full Name", "full_name", "FullName", "nombre", "Name"]
LENIENT_ID_ALIASES = ["id", "idx", "index"]
LENIENT_NAME_ALIASES = ["name", "nombre", "full name", "full_name", "fullname"]

# Dataset file per mode under a data root.
RAW_FILE = "raw/names_dataset.csv"
CLEAN_FILE = "clean/names_dataset_standardized.csv"


def dataset_path(data_root: str, mode: str) -> str:
    """Original -> raw file; the standardised modes -> clean file."""
    mode = resolve_mode(mode)
    return f"{data_root.rstrip('/')}/{CLEAN_FILE if mode in STANDARD_MODES else RAW_FILE}"


def _read_positional(spark: SparkSession, path: str, multi_line: bool) -> list[tuple[DataFrame, list[str]]]:
    """Bodies with columns ``_c0.._cN`` plus the header names as written in the file.

    A byte-order mark before the header is accepted by both readers. Files
    are split over tasks by line; ``multi_line`` is for files whose fields
    hold line breaks (``quoted_csv``: split as well, one body per different header).
    """
    if multi_line:
        return read_quoted(spark, path)
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError("CSV without a header")
    line = first[0][0].lstrip("\ufeff")
    header = next(csv.reader(io.StringIO(line)))
    body = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return [(body.toDF(*[f"_c{i}" for i in range(len(body.columns))]), header)]


def strict_rows(body: DataFrame, header: list[str], mode: str = "original") -> DataFrame:
    """Row rules of the strict loader over text columns ``_c0.._cN`` named by ``header``.

    Per row the first non-empty aliased column wins; a row without id or
    name fails the load (one bounded scan looks for it).
    """

    def first_non_empty(aliases: list[str]):
        cols = [F.nullif(F.col(f"_c{header.index(a)}"), F.lit("")) for a in aliases if a in header]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    out = body.select(
        first_non_empty(STRICT_ID_ALIASES).alias("_id"),
        first_non_empty(STRICT_NAME_ALIASES).alias("full_name"),
        (F.col(f"_c{header.index('strict_key')}") if "strict_key" in header else F.lit(None).cast("string")).alias("strict_key"),
    )
    if not out.filter(F.col("_id").isNull() | F.col("full_name").isNull()).isEmpty():
        raise ValueError(f"CSV needs id and name columns on every row; header={header}")
    return standardize(out.withColumn("id", F.trim(F.col("_id")).cast("long")).drop("_id"), mode)


def _lenient_columns(body: DataFrame, header: list[str]) -> DataFrame:
    """``id`` (null where it is no whole number) and trimmed ``full_name`` of every row."""
    lowered = [h.strip().lower() for h in header]

    def pick(aliases: list[str]) -> str:
        for a in aliases:
            if a in lowered:
                return f"_c{lowered.index(a)}"
        raise ValueError(f"CSV needs 'id' and 'name' columns (or equivalents); header={header}")

    return body.select(
        strip_space(F.col(pick(LENIENT_ID_ALIASES))).try_cast("long").alias("id"),
        strip_space(F.col(pick(LENIENT_NAME_ALIASES))).alias("full_name"),
    )


def lenient_rows(body: DataFrame, header: list[str], mode: str = "original") -> DataFrame:
    """Row rules of the lenient loader (I2, I5): trimmed, case-insensitive headers;
    values trimmed of any white space; bad ids, blank names and empty keys dropped."""
    typed = _lenient_columns(body, header)
    typed = typed.filter(F.col("id").isNotNull() & F.col("full_name").isNotNull() & (F.col("full_name") != ""))
    return standardize(typed, mode, drop_empty=True)


def load_lenient_reported(body: DataFrame, header: list[str], mode: str, write: Callable[[DataFrame], None]) -> DataFrame:
    """Load by the lenient rules and report on it (I10): ``write`` gets the kept rows.

    The counts are metrics observed on the one pass that ``write`` makes: rows
    of the source, rows kept, and what the others lacked (the first reason
    counts: id, name, key). ``kept_ratio`` is 1.0 for a source without rows.
    """
    seen = Observation(f"load-{uuid.uuid4().hex}")
    rows = standardize(_lenient_columns(body, header), mode)
    no_id, no_name = F.col("id").isNull(), F.coalesce(F.col("full_name"), F.lit("")) == ""
    reason = F.when(no_id, "id").when(no_name, "name").when(F.coalesce(F.col("normalized_name"), F.lit("")) == "", "key")
    rows = rows.withColumn("_reason", reason).observe(
        seen,
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(F.col("_reason").isNull()).alias("kept_rows"),
        *[F.count_if(F.col("_reason") == r).alias(f"no_{r}") for r in ("id", "name", "key")],
    )
    write(rows.filter(F.col("_reason").isNull()).drop("_reason"))
    found = seen.get
    ratio = found["kept_rows"] / found["source_rows"] if found["source_rows"] else 1.0
    counts = [found[c] for c in ("source_rows", "kept_rows", "no_id", "no_name", "no_key")]
    return body.sparkSession.createDataFrame(
        [(resolve_mode(mode), *counts, ratio)],
        "dataset_mode string, source_rows long, kept_rows long, no_id long, no_name long, no_key long, kept_ratio double",
    )


def read_names_strict(spark: SparkSession, path: str, mode: str = "original", multi_line: bool = False) -> DataFrame:
    """I1 + I4: ``(id, full_name, normalized_name)``; a missing id or name fails the load."""
    return reduce(DataFrame.unionByName, [strict_rows(*part, mode) for part in _read_positional(spark, path, multi_line)])


def read_names_lenient(spark: SparkSession, path: str, mode: str = "original", multi_line: bool = False) -> DataFrame:
    """I2 + I5: ``(id, full_name, normalized_name)`` with bad rows dropped."""
    return reduce(DataFrame.unionByName, [lenient_rows(*part, mode) for part in _read_positional(spark, path, multi_line)])
