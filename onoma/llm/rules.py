"""Quality rules as a short-circuit cascade (operator 7).

A rule looks at lazily computed measures of one document and says whether it
rejects. ``estimate`` runs every rule on a bounded sample and measures its
cost (seconds per document, the measures it is the first to need included)
and its selectivity (share rejected). ``order_rules`` sorts by rejection per
cost. ``cascade`` then applies the rules in that order and stops at the first
that rejects, so dear rules see only what cheap ones let through. The order
changes the work, never ``kept``: a document is kept when no rule rejects it.

Null and empty texts have no words: every count is 0 and ``short`` rejects
them. Repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import SPACES, map_rows, sampled_texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Documents (lowest hash of doc_id) on which costs and selectivities are estimated.
SAMPLE_ROWS = 256


class Measures:
    """Measures of one text, computed when first asked for and then kept."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._kept: dict[str, object] = {}

    def __getattr__(self, name: str):
        kept = self.__dict__["_kept"]
        if name not in kept:
            if name not in MEASURES:
                raise AttributeError(name)
            kept[name] = MEASURES[name](self)
        return kept[name]


def _words(m: Measures) -> list[bytes]:
    # bytes.split() splits on exactly the six ASCII spaces
    return m.text.encode("utf-8", "surrogatepass").split()


def _word_chars(m: Measures) -> int:
    return len(m.text) - sum(map(m.text.count, SPACES))


def _n_symbols(m: Measures) -> int:
    return sum(map(m.text.count, SYMBOLS))


def _lines(m: Measures) -> list[str]:
    return [x for x in m.text.split("\n") if x.strip(SPACES)]


def _windows_repeat(ids: np.ndarray) -> np.ndarray:
    """For each window start, whether the window's words occur twice or more.

    Equal windows have equal sums, so a text without equal sums is done at
    once; otherwise windows are numbered exactly by doubling (2, 4, 8 words).
    """
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
    n = len(ids) - WINDOW + 1
    u = ids.astype(np.uint64)
    u = (u + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    u ^= u >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += u[k : k + n] * mult[k]
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return np.zeros(n, bool)
    cur, width = ids.astype(np.int64), 1
    while width < WINDOW:
        pair = cur[:-width] * np.int64(len(ids) + 1) + cur[width:]
        cur = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.bincount(cur)[cur] > 1


def _n_repeat_words(m: Measures) -> int:
    words = m.words
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    rep = _windows_repeat(ids)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-WINDOW] += rep
    edge[WINDOW:] -= rep
    return int((np.cumsum(edge[:-1]) > 0).sum())


MEASURES: dict[str, Callable[[Measures], object]] = {
    "words": _words,
    "n_words": lambda m: len(m.words),
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "lines": _lines,
    "n_lines": lambda m: len(m.lines),
    "n_dup_lines": lambda m: len(m.lines) - len(set(m.lines)),
    "n_repeat_words": _n_repeat_words,
    "n_upper_words": lambda m: sum(map(bytes.isupper, m.words)),
    "n_stressed": lambda m: m.text.count("!"),
    "top_word_count": lambda m: max(Counter(m.words).values(), default=0),
}


@dataclass(frozen=True)
class Rule:
    """``rejects(m)`` over the measures of a document."""

    name: str
    rejects: Callable[[Measures], bool]


#: The base rules come from the contract; the others are the method's own.
BASE_RULES = (
    Rule("short", lambda m: m.n_words < 20),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
OWN_RULES = (
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > 2 * m.n_words),
    Rule("dup_lines", lambda m: 10 * m.n_dup_lines > 3 * m.n_lines),
    Rule("stressed", lambda m: 10 * m.n_stressed > 3 * m.n_words),
    Rule("one_word", lambda m: 10 * m.top_word_count > 4 * m.n_words),
    Rule("capitals", lambda m: 10 * m.n_upper_words > 5 * m.n_words),
)
RULES = BASE_RULES + OWN_RULES


def estimate(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost and selectivity of each rule on the ``sample_rows`` rows of lowest doc_id hash.

    Runs on the workers, each on the sampled rows of its own part of the table
    (``common.sampled_texts``). Empty tables give cost 0 and selectivity 0.
    """
    sample = sampled_texts(docs, sample_rows)

    def run(cols: dict[str, list]) -> dict[str, list]:
        out = {"rule": [], "n": [], "rejected": [], "seconds": []}
        for rule in rules:
            began, hits = time.perf_counter(), 0
            for text in cols["text"]:
                hits += bool(rule.rejects(Measures(text)))
            for k, v in zip(out, (rule.name, len(cols["text"]), hits, time.perf_counter() - began)):
                out[k].append(v)
        return out

    rows = (
        map_rows(sample, run, "rule string, n long, rejected long, seconds double")
        .groupBy("rule")
        .agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
        .collect()  # one row per rule
    )
    by = {r["rule"]: r for r in rows}
    out = []
    for rule in rules:
        r = by.get(rule.name)
        n = r["n"] if r else 0
        out.append({"rule": rule.name, "cost": r["seconds"] / n if n else 0.0, "selectivity": r["rejected"] / n if n else 0.0})
    return out


def order_rules(stats: list[dict], rules=RULES) -> list[Rule]:
    """Highest rejection per cost first; ties keep the given order."""
    rate = {s["rule"]: s["selectivity"] / max(s["cost"], 1e-9) for s in stats}
    return sorted(rules, key=lambda r: -rate.get(r.name, 0.0))


def cascade(docs: DataFrame, rules=RULES, report: tuple[str, ...] = (), stats: list[dict] | None = None) -> DataFrame:
    """``doc_id, kept, rejected_by`` (first rejecting rule in the estimated order).

    ``report`` names measures to return for every document; a measure a rule
    has already needed is not computed again.
    """
    ordered = order_rules(estimate(docs, rules) if stats is None else stats, rules)

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "kept": [], "rejected_by": []}
        out |= {name: [] for name in report}
        for text in cols["text"]:
            m = Measures(text)
            by = next((r.name for r in ordered if r.rejects(m)), None)
            out["kept"].append(by is None)
            out["rejected_by"].append(by)
            for name in report:
                out[name].append(getattr(m, name))
        return out

    schema = "doc_id long, kept boolean, rejected_by string" + "".join(f", {name} long" for name in report)
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns: measures, base verdict and the cascade's verdict."""
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = cascade(docs, report=measured)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *measured, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))
