"""Standardised name table (I4, I5, N1): (id, full_name, normalized_name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.functions.normalize import normalize_name

STANDARD_MODES = ("standardized", "standardized+dedupe")
MODES = ("original",) + STANDARD_MODES


def resolve_mode(mode: str | None) -> str:
    """Mode names are trimmed and lower-cased; anything unknown is ``original``."""
    m = (mode or "").strip().lower()
    return m if m in MODES else "original"


def standardize(df: DataFrame, mode: str = "original", drop_empty: bool = False) -> DataFrame:
    """Add the search key.

    In the standardised modes a non-empty ``strict_key`` column, when present,
    is used as is (it is not normalised again); otherwise the key is the
    normalised full name. ``drop_empty`` drops rows whose key is empty.
    """
    mode = resolve_mode(mode)
    key = normalize_name(F.col("full_name"))
    if mode in STANDARD_MODES and "strict_key" in df.columns:
        key = F.coalesce(F.nullif(F.col("strict_key").cast("string"), F.lit("")), key)
    out = df.select(
        F.col("id").cast("long").alias("id"),
        F.col("full_name").cast("string").alias("full_name"),
        key.alias("normalized_name"),
    )
    if drop_empty:
        out = out.filter(F.length("normalized_name") > 0)
    return out
