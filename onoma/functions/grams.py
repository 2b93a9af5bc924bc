"""Character n-grams (N6) and token sets (N7) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_ngrams(c: Column | str, n: int = 3) -> Column:
    """All windows of ``n`` characters, spaces included, duplicates kept.

    Empty key -> []; a key of at most ``n`` characters is its own single gram.
    The windows come from one regex scan with a capturing lookahead (each
    match is zero-width, so matches overlap); per-position ``substr`` would
    rescan the string from its start for every window.
    """
    key = _col(c)
    length = F.length(key)
    windows = F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
    return (
        F.when(key.isNull(), F.lit(None))
        .when(length == 0, F.array().cast("array<string>"))
        .when(length <= n, F.array(key))
        .otherwise(windows)
    )


def distinct_grams(c: Column | str, n: int = 3) -> Column:
    return F.array_distinct(char_ngrams(c, n))


def token_set(c: Column | str) -> Column:
    """Distinct whitespace tokens, sorted by code point."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(_col(c), " "), "")))
