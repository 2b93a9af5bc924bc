"""Substring dedup against a plain set of windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from onoma.llm import substrings
from test_operators import EDGE


def brute(rows, window=20):
    seen, out = set(), []
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    longest = [0] * len(words)
    size = window
    while True:
        held = {}
        for i, (_, w) in enumerate(words):
            for p in range(len(w) - size + 1):
                held.setdefault(tuple(w[p : p + size]), []).append(i)
        again = [v for v in held.values() if len(v) > 1]
        if not again:
            break
        for v in again:
            for i in v:
                longest[i] = size
        size *= 2
    for (d, w), far in zip(words, longest):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), far))
    return sorted(out, key=str)


def got(df, window=20):
    return sorted((tuple(r) for r in substrings.dedup_substrings(df, window).collect()), key=str)


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [[rng.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 45, 200)]
    rows = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(1000, "a " * 300), (1001, None), (1002, ""), (1003, "x y z " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_bytes", [2_000, 1 << 22])
def test_matches_brute_force(session, monkeypatch, chunk_bytes):
    """Passages of 19 to 200 words, runs of one word, many chunks and one."""
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk_bytes)
    rows = passages(1)
    assert got(session.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


@pytest.mark.parametrize("window", [7, 12])
def test_other_windows(session, window):
    rows = passages(2)[:60]
    assert got(session.createDataFrame(rows, "doc_id long, text string"), window) == brute(rows, window)


def test_many_shards_and_short_keys(session, monkeypatch):
    """One word text slices, and shards of a few keys, give the same rows."""
    monkeypatch.setattr(substrings, "SHARD_KEYS", 16)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 8)
    rows = passages(3)[:40]
    assert got(session.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_edges(session, odd, none):
    assert got(odd) == brute([(d, t) for d, t, *_ in EDGE])
    assert got(none) == []


def test_rows_of_one_id_have_one_result_in_any_order(session):
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefgh") * 3 + str(i) for i in range(60))
    rows = [(1, text + " one"), (1, text + " two"), (1, text + " two"), (None, text), (None, text)]
    results = []
    for _ in range(3):
        rng.shuffle(rows)
        results.append(got(session.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert results[0] == results[1] == results[2]
    assert sum(r[2] == 0 for r in results[0]) == 1


def test_tables_do_not_stay(session):
    before = session.catalog.listTables()
    got(session.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert session.catalog.listTables() == before
