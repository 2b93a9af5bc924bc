"""Candidate probe of a request block against the stored lots (C2-C4), with exact bounds.

A request batch is the stated query set; it is taken in blocks of bounded
size, and each block meets the lots of the key index in one scan, without a
shuffle and without materialising the pairs. For a request and a lot:

1. the posting lists of the request's grams, as bitmaps, give the candidates
   (a request without any candidate in the whole table is taken again by the
   caller with ``need_gram=False``);
2. from the lot's lengths and letter maxima follow the fewest common letters
   and the least shared tokens that a key of the lot needs; a request that
   can't have them passes the lot by. Common letters are counted for many
   requests at once as the common bits of unary codes; keys that share enough
   tokens hold one besides the frequent tokens that are too few by themselves;
3. bounds of both scores from shared tokens, lengths and letter counts leave
   out more;
4. the LCS with the request as the pattern (any length) gives the exact edit
   score, and the bound is applied again;
5. what is left gets its exact token score.

A key is no hit where the keys of ``limit`` records rank strictly higher. A task
therefore raises the bar of a request to the scores (similarity, token, edit) of
the ``limit``-th best record that it has met; equal ones stay, since ids decide
on them later. A table of some size is taken in waves: the bars that a few lots
and the equal keys give are the ones that the other lots start from. Pairs
that are dropped could not be among the hits, so the result is complete. At the default threshold an edit of three letters in ten
may spoil every gram, so no prefix of rare grams is safe; counts and lengths
are what bounds the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onoma.functions.similarity import lcs_from_patterns, lcs_lengths, pattern_masks
from onoma.operators.keyindex import KeyIndex, Lot, joined_length, key_grams, key_tokens, letter_counts, spread

BLOCK_REQUESTS = 4000
BLOCK_CHARS = 1 << 20
#: Pairs that are bounded and scored at a time.
PAIRS = 100_000
#: Requests of one key up to which each has a bound of its own.
FEW = 4
#: Pairs of requests and keys whose letters are compared at a time, and those that are looked through together.
TILE, GROUP = 1 << 16, 1 << 20
#: Bytes of a lot's gram bitmaps; above, postings are marked request by request.
BITMAP_BYTES = 1 << 25
SLACK = 1e-9

PROBE_SCHEMA = (
    "request_id long, key string, members long, candidates long, bounded long, scored long, token_raw double, edit_raw double, similarity_raw double"
)


@dataclass(frozen=True)
class Query:
    """Equal request keys with each request's id, threshold, token weight and limit."""

    text: str
    asked: tuple[tuple[int, float, float, int], ...]


#: A request's bar: similarity, token and edit score of a record that is as good as its last hit.
Bar = tuple[float, float, float]


def request_blocks(requests: DataFrame) -> Iterator[list[Query]]:
    """Blocks of the batch, streamed from ``request_id, q_norm, threshold, w_token, limit`` in key order."""
    block: list[Query] = []
    text, asked, size = None, [], 0
    for r in requests.select("q_norm", "request_id", "threshold", "w_token", "limit").orderBy("q_norm", "request_id").toLocalIterator():
        if r["q_norm"] != text or len(asked) >= BLOCK_REQUESTS:
            if asked:
                block.append(Query(text, tuple(asked)))
            if size >= BLOCK_CHARS or sum(len(q.asked) for q in block) >= BLOCK_REQUESTS:
                yield block
                block, size = [], 0
            text, asked = r["q_norm"], []
            size += len(text)
        asked.append((r["request_id"], r["threshold"], r["w_token"], r["limit"]))
    if asked:
        block.append(Query(text, tuple(asked)))
    if block:
        yield block


def _token_score(nq, nk, shared, x_len, y_len, sect, lcs):
    """Token-set ratio from its lengths; ``lcs`` exact or an upper bound."""
    gap = (sect > 0).astype(np.int64)
    a, b = sect + gap + x_len, sect + gap + y_len

    def ratio(dist, total):
        return np.where(total == 0, 100.0, 100.0 - 100.0 * dist / np.maximum(total, 1))

    diff = ratio(x_len + y_len - 2 * lcs, a + b)
    best = np.maximum(np.maximum(diff, ratio(gap + x_len, sect + a)), ratio(gap + y_len, sect + b))
    out = np.where(sect == 0, diff, best)
    out = np.where((shared > 0) & ((x_len == 0) | (y_len == 0)), 100.0, out)
    return np.where((nq == 0) | (nk == 0), 0.0, out)


def _ranks(scores: np.ndarray, bar: Bar) -> np.ndarray:
    """Whether (similarity, token, edit) rank no lower than ``bar``."""
    sim, token, edit = scores.T
    return (sim > bar[0]) | ((sim == bar[0]) & ((token > bar[1]) | ((token == bar[1]) & (edit >= bar[2]))))


def _numbered(sets: list[set[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct strings, ends of the sets, their strings' numbers)."""
    names = sorted(set().union(*sets))
    number = {x: i for i, x in enumerate(names)}
    ends = np.cumsum([0, *map(len, sets)])
    return pa.array(names, pa.string()), ends, np.fromiter((number[x] for own in sets for x in own), np.int64, int(ends[-1]))


def _numbers_in(names: pa.Array, where: pa.Array) -> np.ndarray:
    """Place of each name in ``where``; -1 for none."""
    return pc.fill_null(pc.index_in(names, value_set=where), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class _Block:
    """The requests of a block as arrays: one unit for each request, or for the many requests of one key."""

    def __init__(self, block: list[Query], n: int, top: bool, bars: dict[int, Bar] | None = None):
        bars = bars or {}
        self.asked = [part for q in block for part in ([(a,) for a in q.asked] if len(q.asked) <= FEW else [q.asked])]
        self.texts = [q.text for q in block for _ in (q.asked if len(q.asked) <= FEW else (q,))]
        self.gram_names, self.gram_ends, self.gram_ids = _numbered([key_grams(t, n) for t in self.texts])
        self.tokens = [key_tokens(t) for t in self.texts]
        self.token_names, self.token_ends, self.token_ids = _numbered(self.tokens)
        self.token_sizes = pc.utf8_length(self.token_names).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.counts = letter_counts(self.texts)  # (class, unit)
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.n_tokens = np.array([len(t) for t in self.tokens], np.int64)
        self.joined = np.array([joined_length(t) for t in self.tokens], np.int64)
        self.many = np.array([len(a) > 1 for a in self.asked], bool)
        self.w = np.array([a[0][2] for a in self.asked], float)
        self.token_first = ~self.many & (self.w >= 0.5)
        self.top = top
        #: by unit and request: its bar and (similarity, token, edit) of the best records met, at most as many as its limit
        self.best = [[(max((t, -np.inf, -np.inf), bars.get(i, (t,))), np.zeros((0, 3))) for i, t, _, _ in a] for a in self.asked]
        self.bar = np.zeros(len(self.asked))
        #: edit score that is needed besides: where the token score is the similarity and no more is possible
        self.least_edit = np.full(len(self.asked), -np.inf)
        for u in range(len(self.asked)):
            self._set_bar(u)
        self.alphabet = np.array(sorted({ord(c) for t in self.texts for c in t}), np.int64)
        self.masks = pattern_masks(self.texts, self.alphabet)
        self.token_masks = pattern_masks([" ".join(sorted(t)) for t in self.tokens], self.alphabet)

    def _set_bar(self, u: int) -> None:
        self.bar[u] = min(bar[0] for bar, _ in self.best[u])
        if not self.many[u] and self.w[u] == 1.0 and self.bar[u] >= 100.0:
            self.least_edit[u] = self.best[u][0][0][2]

    def score(self, u: np.ndarray, token, edit) -> np.ndarray:
        """Weighted score; of many requests at once, the most that any weight gives."""
        w = self.w[u]
        return np.where(self.many[u], np.maximum(token, edit), w * token + (1.0 - w) * edit)

    def reached(self, u: np.ndarray, token, edit) -> np.ndarray:
        """Whether scores, or bounds of them, may be those of a hit."""
        return (self.score(u, token, edit) >= self.bar[u] - SLACK) & (edit >= self.least_edit[u] - SLACK)

    def hits(self, u: int, k: int, scores: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Which of these (similarity, token, edit) may be hits of a request; they raise its bar."""
        limit = self.asked[u][k][3]
        bar, best = self.best[u][k]
        at = np.flatnonzero(_ranks(scores, bar))
        if not self.top or limit < 1 or not len(at):
            return at
        best = np.concatenate([best, np.repeat(scores[at], np.minimum(members[at], limit), axis=0)])
        best = best[np.lexsort(best.T[::-1])[::-1][:limit]]
        if len(best) >= limit:
            bar = max(bar, tuple(best[-1].tolist()))
        self.best[u][k] = bar, best
        self._set_bar(u)
        return at[_ranks(scores[at], bar)]

    def needed(self, lot: Lot) -> tuple[np.ndarray, np.ndarray]:
        """((unit, band) fewest common letters with blanks, by unit least joined length of shared tokens) of a key of the
        lot that reaches its unit's threshold by the one or the other; infinite where none can.

        With c common letters and blanks the token difference is at most 200 c / (joined lengths), since the tokens of a
        text have no more blanks between them, and the edit score 200 c / (lengths). With shared tokens of joined
        length s the token score is at most the former or 200 s / (s + shorter joined length).
        """
        common = np.minimum(lot.most[:, None].astype(np.int64), self.counts).sum(axis=0)
        bar, w = self.bar - 1e-6, self.w
        order, ends = lot.bands
        starts = np.r_[0, ends[:-1]]
        joined, lengths = (np.minimum.reduceat(x[order].astype(np.int64), starts) for x in (lot.joined, lot.lengths))
        token, edit = 200.0 / np.maximum(np.add.outer(self.joined, joined), 1), 200.0 / np.maximum(np.add.outer(self.length, lengths), 1)
        letters = bar[:, None] / np.where(self.many[:, None], np.maximum(token, edit), w[:, None] * token + (1 - w[:, None]) * edit)
        letters = np.where(np.add.outer(self.length, lengths) == 0, 0, np.maximum(np.ceil(letters - 1e-6), 0))
        letters = np.where(letters > common[:, None], np.inf, letters)

        edit = 200.0 / np.maximum(self.length + lot.shortest, 1)
        edit = np.where(self.length + lot.shortest == 0, 100.0, edit * np.minimum(common, np.minimum(self.length, lot.longest)))
        token = np.where(self.many, bar, np.where(w > 0, (bar - (1 - w) * np.minimum(edit, 100.0)) / np.maximum(w, 1e-300), np.inf))
        token = np.minimum(token, 200.0)
        shared = np.where(token > 100.0, np.inf, token * np.minimum(self.joined, lot.least_tokens) / (200.0 - np.minimum(token, 100.0)))
        shared = np.maximum(np.ceil(shared - 1e-6), 1)
        out = edit < self.least_edit - 1e-6
        return np.where(out[:, None], np.inf, letters), np.where(out | (shared > self.joined), np.inf, shared)


def _held(lot: Lot, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap over the keys that share a gram, number of their records) by unit."""
    width = -(-lot.n // 64) * 8
    held = np.zeros((len(block.texts), width), np.uint8)
    bits = lot.gram_bits(width) if lot.n_grams * width <= BITMAP_BYTES else None
    numbers = _numbers_in(block.gram_names, lot.gram_names)[block.gram_ids]
    there = np.flatnonzero(numbers >= 0)
    ends = np.searchsorted(there, block.gram_ends)
    numbers = numbers[there]
    for u in np.flatnonzero(np.diff(ends)).tolist():
        at = numbers[ends[u] : ends[u + 1]]
        if bits is not None:
            np.bitwise_or.reduce(bits[at], axis=0, out=held[u].view(np.uint64))
        else:
            flags = np.zeros(8 * width, bool)
            for i in at:
                flags[lot.gram_keys(i)] = True
            held[u] = np.packbits(flags, bitorder="little")
    found = np.bitwise_count(held.view(np.uint64)).sum(axis=1, dtype=np.int64)
    copies = np.flatnonzero(lot.members > 1)
    for at in range(0, len(copies), 1024):
        k = copies[at : at + 1024]
        more = ((held[:, k >> 3] >> (k & 7).astype(np.uint8)) & 1).astype(float) @ (lot.members[k] - 1).astype(float)
        found += more.astype(np.int64)
    return held, found


class _View:
    """A lot as a block sees it: unary codes of the letter counts, and the block's tokens that it holds."""

    def __init__(self, lot: Lot, block: _Block):
        self.lot, self.block = lot, block
        self.n_bits, self.keys, self.units = _unary(lot.counts, block.counts)
        self.numbers = _numbers_in(block.token_names, lot.token_names)
        self.present = np.flatnonzero(self.numbers >= 0)
        self.starts = lot.token_ends[self.numbers[self.present]]
        self.sizes = lot.token_ends[self.numbers[self.present] + 1] - self.starts
        place = np.full(len(self.numbers), -1)
        place[self.present] = np.arange(len(self.present))
        unit, token = np.repeat(np.arange(len(block.texts)), np.diff(block.token_ends)), place[block.token_ids]
        unit, token = unit[token >= 0], token[token >= 0]
        order = np.lexsort((-self.sizes[token], unit))
        #: by unit: its tokens of the lot, the frequent ones first
        self.unit, self.token = unit[order], token[order]
        self.weight = block.token_sizes[self.present]
        weight = np.cumsum(self.weight[self.token])
        before = np.r_[0, weight][np.searchsorted(self.unit, self.unit)]
        #: size of a token and of those that are more frequent
        self.most = weight - before

    @cached_property
    def key_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(ends by key, the block's tokens of the keys)."""
        keys = self.lot.token_rows[spread(self.starts, self.sizes)]
        order = np.argsort(keys, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(keys, minlength=self.lot.n))]
        return ends, np.repeat(np.arange(len(self.present)), self.sizes)[order]

    def common(self, units: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of unit * keys + key, common letters) with at least as many common letters and blanks as the key's band needs."""
        n = self.lot.n
        order, ends = self.lot.bands
        kind = np.dtype(np.uint8 if self.n_bits < 255 else np.int32)
        least = np.minimum(least, self.n_bits + 1).astype(kind)
        keys, sizes = self.keys[:, order], np.diff(ends, prepend=0)
        size = max(1, TILE // n)
        flat, letters = [], []
        for a in range(0, len(units), size):
            own = self.units[:, units[a : a + size]]
            total = np.zeros((own.shape[1], n), kind)
            for mine, theirs in zip(own, keys):
                total += np.bitwise_count(mine[:, None] & theirs)
            at = np.flatnonzero(total >= np.repeat(least[a : a + size], sizes, axis=1))
            flat.append((at // n + a) * n + order[at % n])
            letters.append(total.ravel()[at].astype(np.int64))
        return np.concatenate(flat), np.concatenate(letters)

    def letters(self, u: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Common letters and blanks of pairs."""
        out = np.zeros(len(u), np.int64)
        for mine, theirs in zip(self.units, self.keys):
            out += np.bitwise_count(mine[u] & theirs[k])
        return out

    def sharing(self, units: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Bits (number of unit, key) of keys that may share tokens of this joined length.

        The frequent tokens whose sizes add up to no more are not enough, so a key needs another one.
        """
        n = self.lot.n
        out = np.zeros(len(units) * n, bool)
        a, b = np.searchsorted(self.unit, units), np.searchsorted(self.unit, units, "right")
        at, row = spread(a, b - a), np.repeat(np.arange(len(units)), b - a)
        rest = self.most[at] > least[row]
        at, row = at[rest], row[rest]
        starts, sizes = self.starts[self.token[at]], self.sizes[self.token[at]]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + GROUP, GROUP))
        for a, b in zip(cuts, cuts[1:]):
            keys = self.lot.token_rows[spread(starts[a : b + 1], sizes[a : b + 1])]
            out[np.repeat(row[a : b + 1] * n, sizes[a : b + 1]) + keys] = True
        return out

    def shared(self, units: np.ndarray, row: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Joined length of shared tokens plus one, or 0, of pairs (number in ``units``, key)."""
        out = np.zeros(len(k), np.int64)
        if not len(k) or not len(self.present):
            return out
        a, b = np.searchsorted(self.unit, units), np.searchsorted(self.unit, units, "right")
        own = np.zeros((len(units), len(self.present)), np.int32)
        at = spread(a, b - a)
        own[np.repeat(np.arange(len(units)), b - a), self.token[at]] = self.weight[self.token[at]]
        own, width = own.ravel(), len(self.present)
        ends, tokens = self.key_tokens
        for at in range(0, len(k), PAIRS):
            keys = k[at : at + PAIRS]
            sizes = ends[keys + 1] - ends[keys]
            theirs = tokens[spread(ends[keys], sizes)]
            sums = np.r_[0, np.cumsum(own[np.repeat(row[at : at + PAIRS] * width, sizes) + theirs], dtype=np.int64)]
            last = np.cumsum(sizes)
            out[at : at + PAIRS] = sums[last] - sums[last - sizes]
        return out


def _unary(theirs: np.ndarray, ours: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, codes of a lot's counts, codes of a block's) as (64 bits a word, column): whether a count reaches a level.

    Common bits are the sum of the lesser counts.
    """
    levels = np.minimum(theirs.max(axis=1, initial=0), ours.max(axis=1, initial=0)).astype(np.int64)
    n_bits = int(levels.sum())
    kind = np.repeat(np.arange(len(levels)), levels)
    level = np.arange(n_bits) - np.repeat(np.cumsum(levels) - levels, levels) + 1

    def code(counts: np.ndarray) -> np.ndarray:
        bits = np.zeros((64 * max(1, -(-n_bits // 64)), counts.shape[1]), bool)
        np.greater_equal(counts[kind], level[:, None].astype(counts.dtype), out=bits[:n_bits])
        packed = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T)
        return np.ascontiguousarray(packed.view("<u8").T)

    return n_bits, code(theirs), code(ours)


class _Scan:
    """A block on its way past the lots."""

    def __init__(self, block: _Block, need_gram: bool):
        self.block, self.need_gram = block, need_gram
        self.work = np.zeros((3, len(block.texts)), np.int64)  # candidate records, keys bounded, keys scored

    def rows(self, lot: Lot) -> Iterator[tuple]:
        """Columns (request ids, keys, members, token, edit, similarity) of the pairs of a lot that may be hits."""
        block = self.block
        least_letters, least_shared = block.needed(lot)
        open_ = np.isfinite(least_letters).any(axis=1) | np.isfinite(least_shared)
        held = None
        if self.need_gram:
            held, found = _held(lot, block)
            self.work[0] += found
            open_ &= found > 0
        units = np.flatnonzero(open_)
        if not len(units):
            return
        self.work[1, units] += lot.n
        view = _View(lot, block)
        step = max(1, GROUP // max(lot.n, len(view.present)))
        waiting, size = [], 0
        for at in range(0, len(units), step):
            part = self._near(view, units[at : at + step], least_letters, least_shared, held)
            for cut in range(0, len(part[0]), PAIRS):
                waiting.append(tuple(x[cut : cut + PAIRS] for x in part))
                size += len(waiting[-1][0])
                if size >= PAIRS:
                    yield from self._scored(view, waiting)
                    waiting, size = [], 0
        if waiting:
            yield from self._scored(view, waiting)

    def _near(self, view: _View, units: np.ndarray, least_letters: np.ndarray, least_shared: np.ndarray, held: np.ndarray | None) -> tuple:
        """(unit, key, common letters and blanks, joined length of shared tokens plus one or 0) of pairs that have what they need."""
        n = view.lot.n

        def sharing_gram(flat: np.ndarray) -> np.ndarray:
            if held is None:
                return np.ones(len(flat), bool)
            u, k = units[flat // n], flat % n
            return (held[u, k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1

        least = least_letters[units]
        rows = np.flatnonzero(np.isfinite(least).any(axis=1))
        flat = letters = np.zeros(0, np.int64)
        if len(rows):
            flat, letters = view.common(units[rows], least[rows])
            flat += (rows - np.arange(len(rows)))[flat // n] * n
            kept = self._enough(view.lot, units[flat // n], flat % n, letters)
            flat, letters = flat[kept], letters[kept]
            kept = sharing_gram(flat)
            flat, letters = flat[kept], letters[kept]
        shared = view.shared(units, flat // n, flat % n)

        least = least_shared[units]
        if np.isfinite(least).any():
            by_token = view.sharing(units, least)
            by_token[flat] = False
            others = np.flatnonzero(by_token)
            others = others[sharing_gram(others)]
            theirs = view.shared(units, others // n, others % n)
            kept = theirs > least[others // n]
            others, theirs = others[kept], theirs[kept]
            flat, shared = np.concatenate([flat, others]), np.concatenate([shared, theirs])
            letters = np.concatenate([letters, view.letters(units[others // n], others % n)])
        return units[flat // n], flat % n, letters, shared

    def _enough(self, lot: Lot, u: np.ndarray, k: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Pairs whose common letters reach the threshold (single precision, hence the slack)."""
        block = self.block
        lengths, joined, blanks, gaps = (x.astype(np.float32) for x in (block.length, block.joined, block.counts[0], np.maximum(block.n_tokens - 1, 0)))
        w = block.w.astype(np.float32)[u]
        theirs = lot.singles
        edit = letters.astype(np.float32)
        token = edit - np.minimum(theirs[2][k], blanks[u]) + np.minimum(theirs[3][k], gaps[u])
        token /= np.maximum(theirs[1][k] + joined[u], np.float32(1))
        total = theirs[0][k] + lengths[u]
        edit /= np.maximum(total, np.float32(1))
        short = 200 * (w * token + (1 - w) * edit) < (block.bar - 0.01).astype(np.float32)[u]
        return ~short | block.many[u] | (total == 0)

    def _scored(self, view: _View, waiting: list[tuple]) -> Iterator[tuple]:
        block, lot = self.block, view.lot
        u, k, letters, shared = (np.concatenate(x) for x in zip(*waiting))
        length, n_q = lot.lengths[k], block.n_tokens[u]
        n_k = lot.n_tokens[k]
        x_len, y_len = np.maximum(block.joined[u] - shared, 0), np.maximum(lot.joined[k] - shared, 0)
        sect = np.maximum(shared - 1, 0)
        blanks = np.minimum(lot.counts[0][k], block.counts[0, u])
        # repeated tokens count once in x and y and more often in the letters: still an upper bound
        most = np.maximum(np.minimum(np.minimum(x_len, y_len), letters - blanks - shared + np.minimum(n_q, n_k) - 1), 0)
        token = _token_score(n_q, n_k, shared, x_len, y_len, sect, most)
        total = block.length[u] + length
        common = np.minimum(letters, np.minimum(block.length[u], length))
        edit = np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))
        ok = np.flatnonzero(block.reached(u, token, edit))
        if not len(ok):
            return
        u = u[ok]
        self.work[2] += np.bincount(u, minlength=len(block.texts))
        numbers = np.array([k[ok], total[ok], most[ok], n_q[ok], n_k[ok], shared[ok], x_len[ok], y_len[ok], sect[ok]], np.int32)
        # the score of more weight goes first
        heavy = block.token_first[u]
        for by_token in (True, False):
            at = np.flatnonzero(heavy == by_token)
            if len(at) == len(u):
                yield from self._exact(lot, by_token, u, numbers, token[ok], edit[ok])
            elif len(at):
                yield from self._exact(lot, by_token, u[at], numbers[:, at], token[ok[at]], edit[ok[at]])

    def _exact(self, lot: Lot, by_token: bool, u: np.ndarray, numbers: np.ndarray, token: np.ndarray, edit: np.ndarray) -> Iterator[tuple]:
        """Hits among pairs with upper bounds of their scores: one LCS after the other, then the exact token score."""
        block = self.block
        for kind in (by_token, not by_token):
            k, total, most, *parts = numbers
            if kind:
                # x and y are parts of the sorted tokens, all of them where none is shared
                lcs = lcs_from_patterns(block.token_masks, u, lot.letters(block.alphabet, True), k, lot.joined)
                token = _token_score(*parts, np.minimum(most, lcs))
            else:
                lcs = lcs_from_patterns(block.masks, u, lot.letters(block.alphabet, False), k, lot.lengths)
                edit = np.where(total == 0, 100.0, (1.0 - (total - 2 * lcs) / np.maximum(total, 1)) * 100.0)
            left = np.flatnonzero(block.reached(u, token, edit))
            if not len(left):
                return
            u, numbers, token, edit = u[left], numbers[:, left], token[left], edit[left]
        k, _, _, *parts = numbers
        yield from self._hits(lot, u, k, self._token_exact(lot, u, k, token, parts), edit)

    def _token_exact(self, lot: Lot, u, k, token, parts) -> np.ndarray:
        # where the bound is no more than what needs no LCS, it is the score
        known = _token_score(*parts, np.zeros(len(u), np.int64))
        unsure = np.flatnonzero((token > known) & (parts[2] > 0))
        known = np.where(parts[2] > 0, known, token)
        if len(unsure):
            theirs = [lot.key_tokens(i) for i in k[unsure]]
            ours = [self.block.tokens[i] for i in u[unsure]]
            xs, ys = (
                pd.Series([" ".join(sorted(a - b)) for a, b in zip(one, two)], dtype=object) for one, two in ((ours, theirs), (theirs, ours))
            )
            known[unsure] = _token_score(*[x[unsure] for x in parts], lcs_lengths(xs, ys).to_numpy(np.int64))
        return known

    def _hits(self, lot: Lot, u: np.ndarray, k: np.ndarray, token: np.ndarray, edit: np.ndarray) -> Iterator[tuple]:
        block = self.block
        order = np.argsort(u, kind="stable")
        u, k, token, edit = u[order], k[order], token[order], edit[order]
        starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(u)]):
            unit = int(u[a])
            for i, (request_id, _, w, _) in enumerate(block.asked[unit]):
                scores = np.array([w * token[a:b] + (1.0 - w) * edit[a:b], token[a:b], edit[a:b]]).T
                hit = block.hits(unit, i, scores, lot.members[k[a:b]])
                if len(hit):
                    at = k[a + hit]
                    yield np.full(len(hit), request_id), [lot.keys[j] for j in at], lot.members[at], token[a + hit], edit[a + hit], scores[hit, 0]


def probe(
    index: KeyIndex, block: list[Query], need_gram: bool = True, top: bool = True, lots: DataFrame | None = None, bars: dict[int, Bar] | None = None
) -> DataFrame:
    """Rows of ``PROBE_SCHEMA``: scored pairs that may be hits, and rows with a null key that carry a task's
    number of candidate records, bounded keys and scored keys per request.

    With ``top`` a request's pairs below the best ``limit`` records of the task, or below its entry of ``bars``, are
    left out; without it every pair that reaches its threshold is returned. ``lots`` are some of the index's lots.
    """
    n = index.ngram_n
    lots = (index.lots if lots is None else lots).drop("wave")
    columns = lots.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in PROBE_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 3]
        scan = None

        def batch(cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            for at in range(b.num_rows):
                scan = scan or _Scan(_Block(block, n, top, bars), need_gram)
                cells = (c[at] for c in b.columns)
                lot = Lot({x: c.values if isinstance(c, pa.ListScalar) else c.as_py() for x, c in zip(columns, cells)})
                found, size = [], 0
                for part in scan.rows(lot):
                    found.append(part)
                    size += len(part[0])
                    if size >= PAIRS:
                        yield batch(_joined_columns(found))
                        found, size = [], 0
                if found:
                    yield batch(_joined_columns(found))
        if scan is not None:
            counted = [(r[0], c) for asked, c in zip(scan.block.asked, scan.work.T) if c.any() for r in asked]
            work = [[int(c[i]) for _, c in counted] for i in range(3)]
            yield batch([[r for r, _ in counted], *[[None] * len(counted)] * 2, *work, *[[None] * len(counted)] * 3])

    return lots.mapInArrow(run, PROBE_SCHEMA)


def _joined_columns(found: list[tuple]) -> list:
    ids, keys, members, *scores = zip(*found)
    ids = np.concatenate(ids)
    return [ids, [x for part in keys for x in part], np.concatenate(members), *[[None] * len(ids)] * 3, *map(np.concatenate, scores)]


def met_bars(index: KeyIndex, block: list[Query], scored: DataFrame) -> dict[int, Bar]:
    """Scores of the ``limit``-th best record of each request among the scored pairs and the keys that equal it."""
    spark = index.records.sparkSession
    asked = [(i, q.text, t, w, limit) for q in block for i, t, w, limit in q.asked]
    asked = F.broadcast(spark.createDataFrame(asked, "request_id long, text string, threshold double, w double, limit int"))
    scores = ("similarity_raw", "token_raw", "edit_raw")
    pairs = scored.filter("key IS NOT NULL").select("request_id", "key", "members", *scores).join(asked.select("request_id", "limit"), "request_id")
    # a key that equals its request has both scores at 100; without a token it has not
    full = F.col("w") * 100.0 + (1.0 - F.col("w")) * 100.0
    keys = index.lots.select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("members"))))
    equal = keys.join(asked.filter(F.trim("text") != ""), F.col("key") == F.col("text")).select(
        "request_id", "key", "members", full.alias(scores[0]), F.lit(100.0).alias(scores[1]), F.lit(100.0).alias(scores[2]), "limit", "threshold"
    )
    equal = equal.filter(F.col(scores[0]) >= F.col("threshold")).drop("threshold")
    best = Window.partitionBy("request_id").orderBy(*[F.col(c).desc() for c in scores])
    met = F.sum("members").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = pairs.unionByName(equal).dropDuplicates(["request_id", "key"]).withColumn("met", met).filter("limit > 0 AND met >= limit")
    return {r[0]: tuple(r[1]) for r in rows.groupBy("request_id").agg(F.max(F.struct(*scores))).collect()}
