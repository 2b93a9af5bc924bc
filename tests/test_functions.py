"""Unit, property and cross-implementation tests of the column functions."""

import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

import pyref
from onoma.functions.grams import char_ngrams, token_set
from onoma.functions.normalize import normalize_name
from onoma.functions.similarity import lcs_lengths, py_round

GOLDEN_KEYS = [
    ("Dr. Ana   Álvarez Fernández!!", "ana alvarez fernandez"),
    ("Dr.Ana", "dr ana"),
    ("Dr. Lic. Ana", "lic ana"),
    ("!!Dr. Ana", "dr ana"),
    ("Dr.", "dr"),
    ("dra. Ana", "ana"),
    ("DR Ana", "ana"),
    ("O'Neil-Pérez", "o neil perez"),
    ("D'Ávila  Ñuñez", "d avila nunez"),
    ("Łukasz Straße", "ukasz stra e"),
    ("ﬁna Ａna ª", "fina ana a"),
    ("İpek", "ipek"),
    ("123", ""),
    ("ıng ana", "ana"),
    ("¨dr ana", "dr ana"),
    ("ᴰᴿ ana", "ana"),
    ("™ x", "TM x"),
    ("　Dr. Ana", "ana"),
    (None, None),
]


def test_normalize_golden(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(GOLDEN_KEYS)], "i int, s string")
    got = dict(df.select("i", normalize_name("s").alias("k")).collect())
    for i, (s, want) in enumerate(GOLDEN_KEYS):
        assert got[i] == want, (s, got[i], want)
        if s is not None:
            assert pyref.normalize(s) == want


def test_normalize_matches_rules_on_code_points(spark):
    """Every assigned code point of the first planes in five contexts."""
    strs = []
    for cp in list(range(0x20, 0x3400)) + list(range(0xA000, 0xD7FF, 7)) + list(range(0xF900, 0xFFFE)) + list(range(0x1D400, 0x1D800)):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            continue
        strs += [f"x{ch}x", f"{ch}dr ana", f"dr{ch}ana", f"dr.{ch}ana", f"dr.{ch}"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strs)], "i int, s string")
    got = dict(df.select("i", normalize_name("s").alias("k")).collect())
    bad = [(strs[i], got[i], pyref.normalize(strs[i])) for i in range(len(strs)) if got[i] != pyref.normalize(strs[i])]
    assert not bad, bad[:10]


def test_normalize_idempotent_on_plain_keys(spark):
    keys = ["ana gomez", "juan carlos perez", "x", "maria"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(normalize_name("k")).collect()] == keys


def test_ngrams_and_tokens(spark):
    keys = ["", "a", "an", "ana", "ana b", "juan perez perez", "aaaa"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = df.select("k", char_ngrams("k").alias("g"), token_set("k").alias("t")).collect()
    for r in rows:
        assert len(r.g) == (len(r.k) - 2 if len(r.k) > 3 else bool(r.k))
        assert all(r.k.startswith(g, i) for i, g in enumerate(r.g))
        assert r.t == sorted(set(r.k.split()))


def test_lcs_kernel_cross_implementation():
    random.seed(7)
    a, b = [], []
    for la in [0, 1, 2, 30, 61, 62, 63, 64, 65, 100, 200]:
        for lb in [0, 1, 5, 62, 63, 64, 65, 300, 2000]:
            for _ in range(3):
                a.append("".join(random.choice("ab cdé") for _ in range(la)))
                b.append("".join(random.choice("ab cdé") for _ in range(lb)))
    got = lcs_lengths(pd.Series(a), pd.Series(b))
    for x, y, v in zip(a, b, got):
        assert v == pyref.lcs(x, y), (len(x), len(y))
    with_null = lcs_lengths(pd.Series(["ab", None]), pd.Series(["b", "x"]))
    assert with_null[0] == 1 and pd.isna(with_null[1])


GOLDEN_SCORES = [
    ("ana gz muniz", "ana gomez ruiz", 76.9231, 76.9231, 76.92),
    ("ana alvarez", "alvarez ana", 100.0, 63.6364, 87.27),
    ("juan perez", "juan carlos perez", 100.0, 74.0741, 90.93),
    ("juan perez", "maria garcia", 27.2727, 27.2727, 27.27),
    ("ana ana", "ana", 100.0, 60.0, 86.0),
    ("luis gomes", "luis gomez", 90.0, 90.0, 90.0),
    ("ana", "mariana", 60.0, 60.0, 60.0),
    ("", "", 0.0, 100.0, 35.0),
    ("", "ana", 0.0, 0.0, 0.0),
]


def test_scores_golden(spark):
    from onoma.operators.scoring import score_pairs

    rows = [(i, a, b) for i, (a, b, *_rest) in enumerate(GOLDEN_SCORES)]
    df = spark.createDataFrame(rows, "i int, q_norm string, normalized_name string")
    df = df.withColumns(
        {
            "q_tokens": token_set("q_norm"),
            "tokens": token_set("normalized_name"),
            "w_token": F.lit(0.65),
            "threshold": F.lit(0.0),
        }
    )
    got = {r.i: r for r in score_pairs(df, prune=False).collect()}
    for i, (a, b, tok, edit, sim) in enumerate(GOLDEN_SCORES):
        r = got[i]
        assert r.token_raw == pytest.approx(tok, abs=1e-4), (a, b)
        assert r.edit_raw == pytest.approx(edit, abs=1e-4), (a, b)
        assert round(r.similarity_raw, 2) == sim
        assert r.token_raw == pyref.token_set_ratio(a, b)
        assert r.edit_raw == pyref.ratio(a, b)


def test_scores_symmetric_and_bounded(spark):
    from onoma.operators.scoring import score_pairs

    random.seed(11)
    words = ["ana", "juan", "perez", "gomez", "maria", "an", "luis", "ruiz"]
    pairs = []
    for i in range(300):
        a = " ".join(random.choice(words) for _ in range(random.randint(0, 4)))
        b = " ".join(random.choice(words) for _ in range(random.randint(0, 4)))
        pairs += [(2 * i, a, b), (2 * i + 1, b, a)]
    df = spark.createDataFrame(pairs, "i int, q_norm string, normalized_name string").withColumns(
        {"q_tokens": token_set("q_norm"), "tokens": token_set("normalized_name"), "w_token": F.lit(0.65), "threshold": F.lit(0.0)}
    )
    got = {r.i: r for r in score_pairs(df, prune=False).collect()}
    for i in range(300):
        x, y = got[2 * i], got[2 * i + 1]
        assert x.token_raw == y.token_raw and x.edit_raw == y.edit_raw
        assert 0 <= x.token_raw <= 100 and 0 <= x.edit_raw <= 100
        assert x.token_raw == pyref.token_set_ratio(x.q_norm, x.normalized_name)


def test_py_round_matches_python(spark):
    random.seed(5)
    vals = [random.random() * 100 for _ in range(5000)] + [2.675, 0.125, 99.375, 1.005, 0.0, 100.0] + [k / 8 for k in range(800)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select("x", py_round(F.col("x"), 2).alias("r2"), py_round(F.col("x"), 3).alias("r3")).collect()
    for r in rows:
        assert r.r2 == round(r.x, 2) and r.r3 == round(r.x, 3), r.x
