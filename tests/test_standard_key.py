"""Shortcuts of the standard key and the profile agree with the definitions."""

import re

import pyref
from pyspark.sql import functions as F

from onoma.functions.fold_tables import fold_tables, java_char_class, whitespace_chars
from onoma.functions.normalize import normalize_name, strip_space
from onoma.operators.profile import accent_chars, profile_names


def test_shortcuts_hold_for_ascii():
    """ASCII folds to lower case alone and holds no accent; whitespace is few ranges, each code point in one."""
    matching, replace, expansions = fold_tables()
    assert {c: replace[i] for i, c in enumerate(matching) if c.isascii()} == {chr(c): chr(c).lower() for c in range(65, 91)}
    assert not [c for c in accent_chars() + "".join(expansions) if c.isascii()]
    ws = java_char_class(whitespace_chars())
    assert ws.count("\\x") <= len([c for c in whitespace_chars() if ord(c) < 256]) + 10
    python = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), ws))
    assert "".join(chr(c) for c in range(0x11000) if python.match(chr(c))) == whitespace_chars()


def test_ends_of_any_whitespace(spark):
    names = [f"{a}{m}{b}" for a in ("", *whitespace_chars(), " \n\u2003") for b in ("", "\n", "\u0085", "\u2029 ") for m in ("", "Dr. \u00c1na", "ing x\ty", "\ufb01n")]
    df = spark.createDataFrame(list(enumerate(names)), "id long, full_name string")
    rows = df.select("full_name", strip_space(F.col("full_name")).alias("s"), normalize_name("full_name").alias("k")).collect()
    assert [r["s"] for r in rows] == [r["full_name"].strip() for r in rows]
    assert [r["k"] for r in rows] == [pyref.normalize(r["full_name"]) for r in rows]
    spaced = sum(1 for n in names if n and (n[0].isspace() or n[-1].isspace() or re.search(r"\s\s", n)))
    assert profile_names(df).first()["with_extra_spaces"] == spaced
