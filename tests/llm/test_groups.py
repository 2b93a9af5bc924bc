"""Components and kept rows of near duplicates, one small case at a time."""

from __future__ import annotations

import random

import pytest

from onoma.llm import jaccard
from test_operators import brute_groups, got_groups

TEXT = "doc_id long, text string"


def roots(edges):
    at = {n: n for e in edges for n in e}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return {n: find(n) for n in at}


def chain(seed, n):
    names = random.Random(seed).sample(range(100), n)
    return list(zip(names, names[1:]))


def tree(seed, n):
    rng = random.Random(seed)
    names = rng.sample(range(100), n)
    return [(names[i], names[rng.randrange(i)]) for i in range(1, n)]


@pytest.mark.parametrize(
    "edges",
    [[(1, 10), (10, 5), (5, 11), (11, 2)], [(1, 2)], [(3, 1), (3, 2)]]
    + [chain(s, n) for s, n in ((1, 5), (2, 6), (3, 7), (4, 8), (5, 12))]
    + [tree(s, 7) for s in range(4)],
)
def test_each_node_has_one_component(session, edges):
    """A component that is alone: nothing else keeps the rounds going."""
    rows = [(r["node"], r["comp"]) for r in jaccard.components(session.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(rows) == sorted(roots(edges).items())


def shifted(n, step=5, words=43, seed=1):
    """Texts of which each shares most shingles with the next only."""
    rng = random.Random(seed)
    stream = [f"w{rng.randrange(10**9)}" for _ in range(words + step * n)]
    return [" ".join(stream[i * step : i * step + words]) for i in range(n)]


def test_chain_of_documents_is_one_group(session):
    texts = shifted(5, 4)
    for order in ([0, 3, 1, 4, 2], [4, 0, 3, 1, 2]):
        rows = [(d, texts[i]) for d, i in enumerate(order)]
        df = session.createDataFrame(rows, TEXT)
        assert got_groups(df) == brute_groups(rows)
        assert {c for _, _, c in got_groups(df)} == {"0"}
        assert [r["doc_id"] for r in jaccard.keep_one(df).collect()] == [0]


def test_unlike_texts_under_one_id_or_none_stay(session):
    texts = ["a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z 1 2"]
    rows = list(zip([None, None, 3, 3], texts)) + [(3, texts[2]), (9, texts[0]), (5, None), (5, " ")]
    kept = jaccard.keep_one(session.createDataFrame(rows, TEXT)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted(
        [("9", texts[0]), ("None", texts[1]), ("3", texts[2]), ("3", texts[3]), ("5", ""), ("5", " ")]
    )


def test_a_text_without_id_links_others(session):
    texts = shifted(3, 4)
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2])]
    assert got_groups(session.createDataFrame(rows, TEXT)) == brute_groups(rows)
    assert [r["doc_id"] for r in jaccard.keep_one(session.createDataFrame(rows, TEXT)).collect()] == [1]
