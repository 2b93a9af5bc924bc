"""Benchmark decontamination by CGK embedding and bit sampling (operator 10).

A document is contaminated by an item when some passage of it is within
``MAX_EDIT`` x (item length) edits of the item; both are compared as lower
case words joined by single spaces.

1. Windows. An item with at most e edits keeps at least two of its e+2 equal
   pieces intact, shifted against each other by at most e. An Aho-Corasick
   pass over the whole text finds all pieces, and each piece with such a
   partner fixes one item-sized window. Places without two pieces cannot
   match: nothing is lost by leaving them out.
2. CGK embedding. Windows and items walk at random through their characters,
   repeating some, for three times the item's length; edit distance k becomes
   Hamming distance O(k^2) with constant probability per walk.
3. Bit sampling. Each table compares ``SAMPLED`` positions of one walk;
   ``tables`` gives the number of tables for ``RECALL`` at ``HAMMING`` differing
   positions. Recall falls with the square of the edits, so the tables only
   set the order: windows that meet their item in some table come first.
4. Exact edit verification (Myers' bit vectors, free ends) of the windows with
   their margins gives distance and place. An exact copy ends the search for
   its item; otherwise the windows that met in no table are verified too,
   overlapping ones in one search, so every match is found.

The benchmark is the stated query set: it is taken in blocks of about
``BLOCK_CHARS`` characters, each tested against all rows in one pass without
a shuffle. Items shorter than ``MIN_CHARS`` characters match only word for
word, where no letter or digit adjoins them; null items and items without a
word are left out, and null and empty documents match nothing. Repeated rows are judged one by one, repeated items give a row
each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDIT = 0.1
MIN_CHARS = 24
WALKS = 6
SAMPLED = 6
HAMMING = 0.3
RECALL = 0.99
BLOCK_CHARS = 1 << 20
PAD = 0


def tables(recall: float = RECALL, hamming: float = HAMMING, sampled: int = SAMPLED) -> int:
    """Tables after which a pair at ``hamming`` has been met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - hamming) ** sampled))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(length: int, edits: int) -> list[tuple[int, int]]:
    """edits + 2 equal pieces of an item."""
    n = edits + 2
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


class Walks:
    """Random walks: the bit for (step, character class) is the same for items and windows."""

    def __init__(self, seed: int = 11):
        self.seed = seed
        self._bits: dict[int, np.ndarray] = {}

    def bits(self, walk: int, steps: int) -> np.ndarray:
        """Bits of the walk's first steps, drawn in lots of 1024 steps."""
        have = self._bits.get(walk, np.empty((0, 256), np.int8))
        while len(have) < steps:
            lot = np.random.default_rng([self.seed, walk, len(have)]).integers(0, 2, (1024, 256), dtype=np.int8)
            have = self._bits[walk] = np.concatenate([have, lot])
        return have

    def embed(self, rows: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """Embeddings (rows x steps) of padded code-point rows (0 = end)."""
        n = rows.shape[1]
        wide = np.concatenate([rows, np.zeros((len(rows), 1), rows.dtype)], axis=1).ravel()
        start = np.arange(len(rows)) * (n + 1)
        at, last = start.copy(), start + n
        out = np.empty((steps, len(rows)), rows.dtype)
        bits = self.bits(walk, steps)
        for j in range(steps):
            c = wide[at]
            out[j] = c
            at = np.minimum(at + bits[j][c & 255], last)
        return out


def points(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint32)
    for i, t in enumerate(texts):
        got = np.frombuffer(t[:width].encode("utf-32-le", "replace"), np.uint32)
        out[i, : len(got)] = got
    return out


def edit_search(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of ``text`` nearest to ``item``, if within ``most``."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Block:
    """One block of items with its automaton and their tables; built once per worker."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float):
        import ahocorasick

        self.items = items
        self.edits = [int(max_edit * len(t)) if len(t) >= MIN_CHARS else 0 for _, t in items]
        self.walks = Walks()
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(items):
            for a, b in pieces(len(t), self.edits[k]) if len(t) >= MIN_CHARS else [(0, len(t))]:
                places[t[a:b]].append((k, a))
        self.auto = ahocorasick.Automaton()
        for piece, at in places.items():
            self.auto.add_word(piece, (len(piece), tuple(at)))
        self.auto.make_automaton()
        n = tables()
        # positions per table, as fractions of the walk
        self.spots = np.random.default_rng(5).random((n, SAMPLED))
        self.own: dict[tuple[int, int], np.ndarray] = {}

    def windows(self, text: str) -> list[tuple[int, int]]:
        """(item, start) of every window that holds two pieces where the item has them, and of a short item's first place."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[int, int] = {}
        for end, (size, at) in self.auto.iter(text):
            begin = end + 1 - size
            for k, a in at:
                if len(self.items[k][1]) >= MIN_CHARS:
                    hits[k].append((begin - a, a))
                elif k not in short and not any(map(str.isalnum, text[max(begin - 1, 0) : begin] + text[end + 1 : end + 2])):
                    short[k] = begin
        out = list(short.items())
        for k, found in hits.items():
            if len(found) > 1:
                found.sort()
                for i, (x, a) in enumerate(found):
                    for y, b in found[i + 1 :]:
                        if y - x > self.edits[k]:
                            break
                        out += [(k, x), (k, y)] if a != b else []
        return sorted(set(out))

    def meets(self, at: list[tuple[int, str]]) -> np.ndarray:
        """Which windows (item, text) meet their item in some table."""
        width = max(len(self.items[k][1]) for k, _ in at)
        rows = points([t for _, t in at], width)
        sizes = np.array([3 * len(self.items[k][1]) for k, _ in at])
        hit = np.zeros(len(at), bool)
        for w in range(WALKS):
            left = np.flatnonzero(~hit)
            if not len(left):
                break
            steps = int(sizes[left].max())
            got = self.walks.embed(rows[left], w, steps)
            kinds, of = np.unique([at[i][0] for i in left], return_inverse=True)
            own = np.zeros((steps, len(kinds)), rows.dtype)
            for j, k in enumerate(kinds):
                own[: 3 * len(self.items[k][1]), j] = self.item_walk(int(k), w)
            cols = np.arange(len(left))
            for t in range(w, len(self.spots), WALKS):
                same = np.ones(len(left), bool)
                for spot in self.spots[t]:
                    place = (spot * sizes[left]).astype(np.int64)
                    same &= got[place, cols] == own[place, of]
                hit[left] |= same
        return hit

    def item_walk(self, k: int, w: int) -> np.ndarray:
        if (k, w) not in self.own:
            item = self.items[k][1]
            self.own[k, w] = self.walks.embed(points([item], len(item)), w, 3 * len(item))[:, 0]
        return self.own[k, w]

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end) of the best place of every matching item."""
        at = [(i, k, s) for i, text in enumerate(texts) for k, s in self.windows(text)]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        rest: dict[tuple[int, int], list[int]] = defaultdict(list)
        for lot in range(0, len(at), 4096):
            part = at[lot : lot + 4096]
            hit = self.meets([(k, texts[i][max(s, 0) : max(s, 0) + len(self.items[k][1])]) for i, k, s in part])
            for (i, k, s), yes in zip(part, hit):
                if yes:
                    self.verify(texts[i], i, k, s, s, best)
                else:
                    rest[i, k].append(s)
        for (i, k), starts in rest.items():
            first = last = starts[0]
            for s in starts[1:]:
                if s > last + len(self.items[k][1]):
                    self.verify(texts[i], i, k, first, last, best)
                    first = s
                last = s
            self.verify(texts[i], i, k, first, last, best)
        return [(i, k, d, end) for (i, k), (d, end) in best.items()]

    def verify(self, text: str, i: int, k: int, first: int, last: int, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Search the windows that start from ``first`` to ``last``, with their margins; keep the nearest, leftmost place."""
        had = best.get((i, k))
        if had and had[0] == 0:
            return
        e, item = self.edits[k], self.items[k][1]
        low = max(first - e, 0)
        got = edit_search(item, text[low : last + len(item) + e], e)
        if got and (had is None or (got[0], low + got[1]) < had):
            best[i, k] = (got[0], low + got[1])


def benchmark_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The normalised items in blocks of about ``BLOCK_CHARS`` characters (at least one item)."""
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("i"), "text").orderBy("i", "text")
    for r in rows.toLocalIterator():  # the stated query set, block by block
        t = normal(r["text"])
        if not t:
            continue
        if size and size + len(t) > BLOCK_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append((r["i"], t))
        size += len(t)
    return [b for b in blocks if b]


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """``doc_id, item_id, distance, item_chars, end_char``: one row per document and matching item.

    ``end_char`` is where the best match ends in the normalised text.
    """
    schema = "doc_id long, item_id long, distance long, item_chars long, end_char long"

    def one(items: list[tuple[int, str]]) -> DataFrame:
        kept: list[Block] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not kept:
                kept.append(Block(items, max_edit))
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [
                    (ids[i], items[k][0], d, len(items[k][1]), end)
                    for i, k, d, end in kept[0].matches([normal(t) for t in b.column(1).to_pylist()])
                ]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "item_chars", "end_char"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

    found = [one(items) for items in benchmark_blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """The rows of ``docs`` (columns of documents) without a match: one pass per block, no join."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    out = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long"))

    def one(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        kept: list[Block] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not kept:
                kept.append(Block(items, max_edit))
            for b in batches:
                hit = {i for i, *_ in kept[0].matches([normal(t) for t in b.column("text").to_pylist()])}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        return rows.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")

    return reduce(one, benchmark_blocks(benchmark), out).select(*cols)
