"""Spelling variant grouping against plain neighbour sets."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from onoma.llm import spelling
from test_operators import EDGE


def brute_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in spelling.spelling_forms(df).collect()), key=str)


def misspelt(seed, alphabet="abé", n=60):
    """Few letters, so that runs of a letter, ties and chains come up often."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 9))) for _ in range(n)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(60):
            w = words[min(int(rng.expovariate(0.08)), n - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1 :]])
            text.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((d, rng.choice([" ", "1", ". "]).join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(session, seed):
    rows = misspelt(seed)
    assert got(session.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_many_ranges(session, monkeypatch):
    """Ranges of a few letters: nodes that begin ranges earlier keep their number."""
    monkeypatch.setattr(spelling, "RANGE_CHARS", 12)
    rows = misspelt(3, "ab", 40)
    assert got(session.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_nodes_are_prefixes(session, ranges):
    """Two words have the same number at a depth exactly when they share that prefix."""
    rng = random.Random(ranges)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(90)} | {"a" * n for n in range(12)} | {"é", "Ā😀"}
    df = session.createDataFrame([(w,) for w in words], "key string")
    rows = spelling.number_nodes(df, ranges, 5).collect()
    assert [r["key"] for r in sorted(rows, key=lambda r: r["number"])] == sorted(words)
    node_of, prefix_of = {}, {}
    for r in rows:
        assert len(r["nodes"]) == len(r["key"]) + 1
        for d, node in enumerate(r["nodes"]):
            assert node_of.setdefault(r["key"][:d], node) == node
            assert prefix_of.setdefault(node, r["key"][:d]) == r["key"][:d]


def test_chains_are_followed_to_their_end(session):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (40, 5)]
    rows = spelling.follow(session.createDataFrame(links, "id long, form long")).collect()
    assert {r["id"]: r["root"] for r in rows} == {i: 20 for i in [*range(20), 40]} | {30: 31}


def test_edges(session, odd, none):
    rows = [(d, t) for d, t, *_ in EDGE]
    assert got(odd) == brute(rows)
    three = odd.unionByName(odd).unionByName(odd)
    assert got(three) == brute(rows * 3)
    assert got(none) == []


def test_long_word(session):
    word = "".join(random.Random(5).choice("abcdefgh") for _ in range(20_000))
    rows = [(1, f"{word} {word} {word} {word}x {word}x {word}x {word[1:]} " * 3)]
    found = {len(w): (len(form or ""), n_near) for w, form, _, _, n_near, _ in got(session.createDataFrame(rows, "doc_id long, text string"))}
    assert found == {len(w): (len(f or ""), k) for w, f, _, _, k, _ in brute(rows)}


def test_null_ids(session):
    rows = [(None, "hello world hello world hello world"), (None, "hello hallo hallo hallo"), (2, "hello")]
    assert got(session.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert got(session.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x"))) == brute(rows)
