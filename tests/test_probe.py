"""The probe's raised thresholds: fewer pairs leave the scan, the hits stay."""

import random

from pyspark.sql import functions as F

import pyref
from onoma.functions.similarity import lcs_from_patterns, lcs_lengths, pattern_masks
from onoma.operators.keyindex import Lot, build_index, lot_row, _NAMES
from onoma.operators import probe as P
from onoma.plans.match import match

NAMES = "id long, full_name string, normalized_name string"
ASKED = "request_id long, name string, threshold double, w_token double, limit int"


def keys(count):
    rng = random.Random(7)
    words = ["ana", "anna", "ruiz", "ruis", "perez", "peres", "gomez", "juan", "carlos", "luz"]
    return sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(count)})


def test_only_the_best_keys_of_a_task_leave_the_scan(spark, tmp_path):
    names = keys(600)
    index = build_index(spark.createDataFrame([(i, k, k) for i, k in enumerate(names)], NAMES), str(tmp_path))
    index.lots = index.lots.coalesce(1)
    block = [P.Query("ana ruiz gomez", ((1, 20.0, 0.65, 5),))]
    sims = {}
    for top in (False, True):
        rows = P.probe(index, block, top=top).filter("key IS NOT NULL").collect()
        sims[top] = sorted((r["similarity_raw"] for r in rows), reverse=True)
    assert sims[True][:5] == sims[False][:5]
    assert 4 * len(sims[True]) < len(sims[False])


def test_limits_and_ties_against_plain_scores(spark):
    """Several requests of a key (bounded one by one, or more than FEW at once), each with its own threshold, weight and limit."""
    names = keys(150)
    records = [(2 * i + j, k, k) for i, k in enumerate(names) for j in range(2)]
    rows, n = [], 0
    for q in ("ana ruiz", "juan carlos perez", "luz"):
        for t in (0.0, 60.0):
            for w, limit in ((0.0, 1), (0.65, 7), (1.0, 3), (0.3, 100)):
                if q != "luz" or t:  # the last one has few requests, the others many
                    rows.append((n, q, t, w, limit))
                    n += 1
    got = {}
    for r in match(spark.createDataFrame(records, NAMES), spark.createDataFrame(rows, ASKED)).display.orderBy("rank").collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    for rid, q, t, w, limit in rows:
        near = [(i, k) for i, _, k in records if pyref.share_gram(q, k)]
        scored = [(w * pyref.token_set_ratio(q, k) + (1 - w) * pyref.ratio(q, k), pyref.token_set_ratio(q, k), pyref.ratio(q, k), i) for i, k in near]
        want = [i for s, _, _, i in sorted(scored, key=lambda x: (-x[0], -x[1], -x[2], x[3])) if s >= t][:limit]
        assert got.get(rid, []) == want, (q, t, w, limit)


def test_many_patterns_at_once_give_the_lcs(spark):
    import numpy as np
    import pandas as pd

    texts = ["ana ruiz", "z" * 70 + " a", "", "juan carlos " * 12]
    lot = Lot(dict(zip(_NAMES, lot_row(["ana", "ruiz ana", "àna z", "z" * 90 + "juan", ""], [1, 1, 1, 1, 1], 3))))
    block = P._Block([P.Query(t, ((i, 0.0, 0.5, 1),)) for i, t in enumerate(texts)], 3, False)
    u, k = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(lot.n)))
    got = lcs_from_patterns(block.masks, u, lot.letters(block.alphabet, False), k, lot.lengths)
    want = lcs_lengths(pd.Series([texts[i] for i in u]), pd.Series([lot.keys[i] for i in k]))
    assert got.tolist() == want.tolist()
    assert pattern_masks([], np.zeros(0, np.int64)) == []


def test_gram_dictionary_counts_records(spark, tmp_path):
    names = [(1, "x", "ana"), (2, "x", "ana"), (3, "x", "anan"), (4, "x", ""), (5, "x", "an")]
    index = build_index(spark.createDataFrame(names, NAMES), str(tmp_path))
    assert {r["gram"]: r["n_ids"] for r in index.grams.collect()} == {"ana": 3, "nan": 1, "an": 1}
    assert index.grams.agg(F.count("*")).first()[0] == 3


def test_records_of_a_key_raise_the_bar(spark, tmp_path):
    """Ten records of the equal key fill the limit: no other key leaves the scan."""
    names = keys(600)
    rows = [(i, k, k) for i, k in enumerate([*names, *["ana ruiz gomez"] * 10])]
    index = build_index(spark.createDataFrame(rows, NAMES), str(tmp_path))
    block = [P.Query("ana ruiz gomez", ((1, 20.0, 0.65, 10),))]
    bars = P.met_bars(index, block, spark.createDataFrame([], P.PROBE_SCHEMA))
    assert bars == {1: (100.0, 100.0, 100.0)}
    left = P.probe(index, block, bars=bars).filter("key IS NOT NULL").collect()
    assert [(r["key"], r["members"]) for r in left] == [("ana ruiz gomez", 10 + ("ana ruiz gomez" in names))]


def test_equal_similarities_are_told_apart_by_the_edit_score(spark, tmp_path):
    """With a token weight of 1 many keys reach 100; only those that may be hits leave the scan."""
    names = keys(600)
    index = build_index(spark.createDataFrame([(i, k, k) for i, k in enumerate(names)], NAMES), str(tmp_path))
    index.lots = index.lots.coalesce(1)
    block = [P.Query("ana", ((1, 20.0, 1.0, 3),))]
    left = {top: P.probe(index, block, top=top).filter("similarity_raw = 100").orderBy(F.desc("edit_raw")).collect() for top in (False, True)}
    assert [r["edit_raw"] for r in left[True]][:3] == [r["edit_raw"] for r in left[False]][:3]
    assert 2 * len(left[True]) < len(left[False])


def test_waves_give_the_same_hits(spark, tmp_path, monkeypatch):
    from onoma.operators import keyindex
    from onoma.plans import match as M

    monkeypatch.setattr(keyindex, "WAVE_LOTS", 4)
    monkeypatch.setattr(keyindex, "WAVE_ENDS", (1, 2))
    names = keys(600)
    records = [(3 * i + j, k, k) for i, k in enumerate(names) for j in range(1 + i % 3)]
    index = build_index(spark.createDataFrame(records, NAMES), str(tmp_path))
    assert index.lots.select("wave").distinct().count() > 1
    texts = ["ana ruiz gomez", "juan", "luz perez carlos anna", "xyz", names[5]]
    rows = [(10 * i + j, q, t, w, limit) for i, q in enumerate(texts) for j, (t, w, limit) in enumerate([(70.0, 0.65, 10), (0.0, 1.0, 4), (40.0, 0.0, 100)])]
    got = []
    for start in (1 << 60, 0):
        monkeypatch.setattr(M, "WAVES_FROM", start)
        res = M.match_index(index, spark.createDataFrame(rows, ASKED))
        got.append((sorted(res.hits.collect()), sorted(res.summary.collect())))
    assert got[0] == got[1] and len(got[0][0]) > 100


def test_lots_hold_the_plain_postings():
    from onoma.operators.keyindex import key_grams, key_tokens

    texts = ["", "a", "ab", "b a b", "abc abc", "à é ab", "\U0001f600 x", "ab"]
    for n in (1, 2, 3, 5, 40):
        row = dict(zip(_NAMES, lot_row(texts, [1] * len(texts), n)))
        for what, of in (("token", key_tokens), ("gram", lambda k: key_grams(k, n))):
            lot = Lot(row)
            names, ends, rows = (getattr(lot, f"{what}_{x}") for x in ("names", "ends", "rows"))
            got = {x: rows[a:b].tolist() for x, a, b in zip(names.to_pylist(), ends, ends[1:])}
            assert got == {x: [i for i, t in enumerate(texts) if x in of(t)] for x in sorted(set().union(*map(of, texts)))}


def test_repeated_tokens_do_not_loosen_the_bounds_of_a_lot():
    """Joined distinct tokens of one key are short: only its band needs few common letters."""
    import numpy as np

    rng = random.Random(3)
    texts = sorted({" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(5)) for _ in range(400)} | {" ".join(["ab"] * 11)}, key=lambda k: (len(k), k))
    lot = Lot(dict(zip(_NAMES, lot_row(texts, [1] * len(texts), 3))))
    block = P._Block([P.Query(texts[7], ((1, 90.0, 0.65, 10),)), P.Query("ab ab ab", ((2, 0.0, 0.65, 10),))], 3, False)
    least, _ = block.needed(lot)
    view = P._View(lot, block)
    flat, letters = view.common(np.arange(2), least)
    near = flat[flat < lot.n]
    shared = [sum(min(texts[7].count(c), k.count(c)) for c in set(texts[7])) for k in texts]
    assert dict(zip(flat.tolist(), letters.tolist())).items() >= {7: shared[7]}.items()
    assert [shared[k] for k in near] == letters[flat < lot.n].tolist()
    # exact scores reach the threshold only where the letters do
    want = [i for i, k in enumerate(texts) if 0.65 * pyref.token_set_ratio(texts[7], k) + 0.35 * pyref.ratio(texts[7], k) >= 90]
    assert set(want) <= set(near.tolist()) and 2 * len(near) < lot.n
    assert sorted(flat[flat >= lot.n] - lot.n) == list(range(lot.n))


def test_columns_of_sorted_tokens():
    import numpy as np

    texts = ["", " ", "b a b", "zz", "juan à juan ana", "ana  b"]
    lot = Lot(dict(zip(_NAMES, lot_row(texts, [1] * len(texts), 3))))
    for alphabet in ("abnuj ", "à", "abnujà"):
        at = sorted(map(ord, alphabet))
        columns = lot.letters(np.array(at, np.int64), True)
        for i, k in enumerate(texts):
            want = [at.index(ord(c)) + 1 if ord(c) in at else 0 for c in " ".join(sorted(set(k.split(" ")) - {""}))]
            assert columns[:, i].tolist() == want + [0] * (len(columns) - len(want))


def test_lots_are_cut_where_keys_meet(spark, tmp_path):
    """No copy of the keys and no second shuffle: each file holds lots of all lengths."""
    import os

    names = [(i, "x", "ab" * (1 + i % 40) + str(i)) for i in range(2000)]
    index = build_index(spark.createDataFrame(names, NAMES), str(tmp_path))
    assert not os.path.exists(f"{index.path}/keys")
    got = index.lots.select(F.explode("keys").alias("k"), "shortest", "longest")
    assert got.count() == 2000 and got.filter("length(k) < shortest OR length(k) > longest").isEmpty()
    bars = P.met_bars(index, [P.Query("abab1", ((1, 20.0, 0.65, 1),))], spark.createDataFrame([], P.PROBE_SCHEMA))
    assert bars == {1: (100.0, 100.0, 100.0)}
