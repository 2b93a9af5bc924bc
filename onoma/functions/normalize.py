"""Name standardisation as one native Column expression (no UDF).

Steps, in this order (the order matters, see the tests):

1. drop whitespace at both ends (any Unicode whitespace),
2. fold every character: lower-case, NFKD, drop combining marks
   (``translate`` for one-to-one folds and deletions, a literal map for the
   few characters that fold to several),
3. drop one leading title followed by whitespace,
4. every run of characters other than ``a-z``/``A-Z`` becomes one space,
5. trim.

Null stays null.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from onoma.functions.fold_tables import fold_tables, java_char_class, whitespace_chars

# The leading titles removed by the standard key, in the
# reference's order. Matching is case-insensitive.
TITLES = ["dr", "dra", "sr", "sra", "srta", "ing", "lic", "prof"]


@functools.lru_cache(maxsize=1)
def _patterns() -> dict[str, str]:
    ws = java_char_class(whitespace_chars())
    # A case-insensitive match in Python also takes dotless i for i; Java's
    # ASCII-only (?i) does not, so the alternative is spelled out.
    alternatives = "|".join(t.replace("i", "[iı]") for t in TITLES)
    return {
        "title": f"(?i)^(?:{alternatives})\\.?{ws}+",
    }


@functools.lru_cache(maxsize=1)
def _expansion_map_sql() -> str:
    _, _, expansions = fold_tables()

    def lit(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    keys = ", ".join(lit(k) for k in expansions)
    values = ", ".join(lit(v) for v in expansions.values())
    return f"map_from_arrays(array({keys}), array({values}))"


def strip_space(c: Column) -> Column:
    return F.trim(c, F.lit(whitespace_chars()))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold(c: Column) -> Column:
    """Lower-case + NFKD + drop combining marks, character by character."""
    matching, replace, _ = fold_tables()
    # a name in ASCII only needs lower case
    folded = F.when(is_ascii(c), F.lower(c)).otherwise(F.translate(c, matching, replace))
    # The per-character map is interpreted, so only rows holding such a
    # character (ligatures, squared letters, ...) take it.
    # A hashed translate finds them in one pass (a 259-character regex class
    # would test each character against every entry).
    _, _, expansions = fold_tables()
    has_expansion = ~is_ascii(folded) & (F.length(F.translate(folded, "".join(expansions), "")) < F.length(folded))
    return F.when(has_expansion, _expand(folded)).otherwise(folded)


def _expand(value: Column) -> Column:
    mapping = F.expr(_expansion_map_sql())
    return F.array_join(
        F.transform(F.split(value, ""), lambda ch: F.coalesce(F.try_element_at(mapping, ch), ch)), ""
    )


def strip_title(c: Column) -> Column:
    return F.regexp_replace(c, _patterns()["title"], "")


def letters_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-zA-Z]+", " "))


def normalize_name(c: Column | str) -> Column:
    """The strict standard key of a full name."""
    col = F.col(c) if isinstance(c, str) else c
    return letters_only(strip_title(fold(strip_space(col))))
