"""Data-quality profile of a name table (D4) and mode comparison.

Both are documented-only in the reference (an analysis notebook that is not
part of it), so the exact figures are defined here:

* with_accents: the name holds a character whose fold is an ASCII letter
  without being one (``é``, ``Ñ``, ``ﬁ`` ...) or a combining mark;
* with_titles: a leading title is removed by the standard key;
* with_symbols: the folded name holds a character other than an ASCII letter
  or whitespace (digits, punctuation, symbols);
* with_extra_spaces: leading/trailing whitespace or a run of two;
* duplicate_rows: rows whose non-empty key was already taken by another row
  (rows minus distinct non-empty keys).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.functions.fold_tables import fold_tables, java_char_class, whitespace_chars
from onoma.functions.normalize import fold, is_ascii, normalize_name, strip_space, strip_title
from onoma.functions.similarity import py_round


@functools.lru_cache(maxsize=1)
def accent_chars() -> str:
    """Characters that fold to an ASCII letter without being one, plus dropped marks."""
    matching, replace, expansions = fold_tables()
    chars = []
    for i, ch in enumerate(matching):
        target = replace[i] if i < len(replace) else ""
        if ch.isascii():
            continue
        if target == "" or (target.isascii() and target.isalpha()):
            chars.append(ch)
    for ch, out in expansions.items():
        if not ch.isascii() and any(c.isascii() and c.isalpha() for c in out):
            chars.append(ch)
    return "".join(chars)


def profile_names(names: DataFrame) -> DataFrame:
    """One row of counts and shares over ``(id, full_name)``."""
    name = F.col("full_name")
    ws = java_char_class(whitespace_chars())
    folded = fold(strip_space(name))
    flags = names.select(
        (~is_ascii(name) & (F.length(F.translate(name, accent_chars(), "")) < F.length(name))).alias("accent"),
        (strip_title(folded) != folded).alias("title"),
        folded.rlike("[^a-zA-Z" + ws[1:-1] + "]").alias("symbol"),
        name.rlike(f"^{ws}|{ws}(?:{ws}|$)").alias("space"),
        normalize_name(name).alias("key"),
    )
    counts = flags.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("accent").alias("with_accents"),
        F.count_if("title").alias("with_titles"),
        F.count_if("symbol").alias("with_symbols"),
        F.count_if("space").alias("with_extra_spaces"),
        F.count_if(F.col("key") == "").alias("empty_keys"),
        F.count_distinct(F.when(F.col("key") != "", F.col("key"))).alias("distinct_keys"),
    )
    keyed_rows = F.col("rows") - F.col("empty_keys")
    out = counts.withColumn("duplicate_rows", keyed_rows - F.col("distinct_keys"))

    def share(c: str) -> F.Column:
        return py_round(F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(F.col(c) / F.col("rows")), 4)

    return out.select(
        "*",
        *[share(c).alias(f"{c}_share") for c in ("with_accents", "with_titles", "with_symbols", "with_extra_spaces", "duplicate_rows")],
    )
