"""Personal data by a semi-Markov conditional random field (operator 5).

A text is cut at white space into tokens. Tokens without a digit or ``@``
cannot be part of an entity, so the lattice covers only regions around the
others; outside them the label is O and costs nothing. In a region every
candidate segment of up to ``MAX_TOKENS`` tokens is scored as a whole (shape,
digit count, Luhn sum, octet range, domain form, neighbours) for every type,
and dynamic programming over segment ends chooses boundaries and types
together; a transition weight links neighbouring segments. Time is linear in
the tokens of the regions.

``train`` fits the weights by gradient ascent on the exact conditional
likelihood (forward-backward over segments) of a bounded sample: regions of
the ``SAMPLE_DOCS`` documents of lowest hash that hold a digit or ``@``
(``DOC_REGIONS`` of each, cut after ``REGION_TOKENS`` tokens; at most
``MAX_REGIONS`` different ones), labelled by the base patterns. These bounds
hold for fitting only; every text is searched whole. To the rows come copies
whose phone numbers have lost their country prefix, so that national numbers
are learned too, and rows in which a span stands two or three times in a row
or beside a short number (``in_runs``): the base card pattern takes such a run
for one long number and drops it, the field finds each number in it.

A model span counts if its own segment score is at least ``MIN_SCORE``.

``base_spans`` are the contract's patterns; the result of a text is the base
spans plus the model's spans that meet none of them. ``redact`` replaces
spans by placeholders. Null texts are empty and have no spans. Repeated rows
are judged one by one; extra columns are ignored. On an empty table the model
has no weights and adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import map_rows, sampled_texts

#: Kinds in the contract's order.
KINDS = ("email", "ip", "card", "phone")

SAMPLE_DOCS = 400
MAX_REGIONS = 600
DOC_REGIONS = 8
MAX_TOKENS = 5
REGION_TOKENS = 4 * MAX_TOKENS
EPOCHS = 12
#: Smallest score of a model span: the weights of its segment, transitions apart.
MIN_SCORE = 2.0

# The contract's patterns. The e-mail pattern is anchored at
# each @ (its local part is the run of local characters before it) and the
# digit runs are possessive, which finds the same matches in linear time.
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(parts: tuple[str, ...]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the contract's order."""
    if not _HINT.search(text):
        return []
    out = []
    pos, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > pos and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    for m in _IP.finditer(text):
        if _octets(m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _only_digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- lattice --------------------------------------------------------------

_OPEN, _CLOSE = "([{<\"'", ".,;:!?)]}>\"'"


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Token offsets around digits and @: gaps of up to two plain tokens stay inside."""
    out: list[list[tuple[int, int]]] = []
    last = None
    tokens = [m.span() for m in _TOKEN.finditer(text)] if _HINT.search(text) else []
    for i, (a, b) in enumerate(tokens):
        if _HINT.search(text, a, b):
            if last is None or i - last > 3:
                out.append([])
                start = i
            else:
                start = last + 1
            out[-1].extend(tokens[start : i + 1])
            last = i
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    """Brackets and sentence marks around a segment aren't part of it."""
    while b > a and text[b - 1] in _CLOSE:
        b -= 1
    while b > a and text[a] in _OPEN and not (text[a] == "(" and ")" in text[a:b]):
        a += 1
    return a, b


def features(text: str, a: int, b: int, n: int) -> list[str]:
    """Features of the whole segment text[a:b] of n tokens."""
    s = text[a:b]
    digits = _only_digits(s)
    k = len(digits)
    shape = re.sub(r"[^\W0-9_]+", "a", re.sub(r"[0-9]+", "9", s))
    out = [f"tokens={n}", f"digits={min(k, 20) if k < 8 else min(k, 20) // 2 * 2}", "shape=" + (shape if len(shape) <= 24 else "long")]
    if k and k + sum(c in " +().-" for c in s) == len(s):
        out.append("numeric")
        out.append("phone_size" if 9 <= k <= 15 else "card_size" if 12 <= k <= 19 else "other_size")
        if 10 <= k <= 15 and re.search(r"[0-9][ ().-]+[0-9]", s):
            out.append("grouped")
    if s.startswith("+"):
        out.append("plus")
    if 12 <= k <= 19 and re.fullmatch(r"[0-9 -]+", s):
        out.append("luhn" if luhn(digits) else "not_luhn")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append("octets" if _octets(tuple(parts)) else "not_octets")
    if s.count("@") == 1:
        local, domain = s.split("@")
        out.append("mail" if _LOCAL_RUN.fullmatch(local) and _DOMAIN.fullmatch(domain) else "not_mail")
    elif "@" in s:
        out.append("many_at")
    return out


class Lattice:
    """Candidate segments of a region: (first token, next token, start, end, features)."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.n = len(tokens)
        self.into: list[list[tuple[int, int, int, list[str]]]] = [[] for _ in range(self.n + 1)]
        live = [bool(_HINT.search(text, a, b)) for a, b in tokens]
        for i in range(self.n):
            if not live[i]:
                continue
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                if not live[j - 1]:
                    continue
                a, b = _trim(text, tokens[i][0], tokens[j - 1][1])
                if a < b:
                    self.into[j].append((i, a, b, features(text, a, b, j - i)))

    def scored(self, w: dict[str, float]) -> list[list[tuple[int, int, float]]]:
        """For each end: (first token, type, score); type 0 is O and one token long."""
        out = []
        for j, cand in enumerate(self.into):
            row = [(j - 1, 0, 0.0)] if j else []
            for i, _, _, fs in cand:
                for t in range(1, len(KINDS) + 1):
                    row.append((i, t, sum(w.get(f"{t}|{f}", 0.0) for f in fs) + w.get(f"{t}|bias", 0.0)))
            out.append(row)
        return out

    def decode(self, w: dict[str, float]) -> list[tuple[int, int, int, float]]:
        """Best segmentation's entities: (type, start, end, score)."""
        types = range(len(KINDS) + 1)
        best = [[-math.inf] * len(types) for _ in range(self.n + 1)]
        back: list[list[tuple[int, int] | None]] = [[None] * len(types) for _ in range(self.n + 1)]
        best[0][0] = 0.0
        scored = self.scored(w)
        for j in range(1, self.n + 1):
            for i, t, s in scored[j]:
                for p in types:
                    v = best[i][p] + s + w.get(f"{p}>{t}", 0.0)
                    if v > best[j][t]:
                        best[j][t], back[j][t] = v, (i, p)
        out = []
        j, t = self.n, max(types, key=lambda x: best[self.n][x])
        while j > 0:
            i, p = back[j][t]
            if t:
                a, b = next((a, b) for k, a, b, _ in self.into[j] if k == i)
                out.append((t, a, b, next(s for k, u, s in scored[j] if (k, u) == (i, t))))
            j, t = i, p
        return out[::-1]

    def gradient(self, w: dict[str, float], gold: dict[tuple[int, int], int], grad: dict[str, float]) -> float:
        """Adds d log-likelihood to ``grad``; returns the log-likelihood."""
        types = range(len(KINDS) + 1)
        scored = self.scored(w)
        fwd = [[-math.inf] * len(types) for _ in range(self.n + 1)]
        fwd[0][0] = 0.0
        for j in range(1, self.n + 1):
            got = defaultdict(list)
            for i, t, s in scored[j]:
                for p in types:
                    if fwd[i][p] > -math.inf:
                        got[t].append(fwd[i][p] + s + w.get(f"{p}>{t}", 0.0))
            for t, vs in got.items():
                fwd[j][t] = _logsum(vs)
        z = _logsum([v for v in fwd[self.n] if v > -math.inf])
        bwd = [[-math.inf] * len(types) for _ in range(self.n + 1)]
        bwd[self.n] = [0.0] * len(types)
        feats = {(i, j): fs for j, c in enumerate(self.into) for i, _, _, fs in c}
        for j in range(self.n, 0, -1):
            for i, t, s in scored[j]:
                if bwd[j][t] == -math.inf:
                    continue
                for p in types:
                    if fwd[i][p] == -math.inf:
                        continue
                    edge = s + w.get(f"{p}>{t}", 0.0)
                    prob = math.exp(fwd[i][p] + edge + bwd[j][t] - z)
                    if prob > 1e-9:
                        grad[f"{p}>{t}"] -= prob
                        if t:
                            grad[f"{t}|bias"] -= prob
                            for f in feats[i, j]:
                                grad[f"{t}|{f}"] -= prob
                    v = edge + bwd[j][t]
                    bwd[i][p] = v if bwd[i][p] == -math.inf else _logsum([bwd[i][p], v])
        total, p, j = 0.0, 0, 0
        while j < self.n:
            nxt = next(((i, k, t) for (i, k), t in gold.items() if i == j), (j, j + 1, 0))
            i, k, t = nxt
            total += next(s for a, u, s in scored[k] if (a, u) == (i, t)) + w.get(f"{p}>{t}", 0.0)
            grad[f"{p}>{t}"] += 1.0
            if t:
                grad[f"{t}|bias"] += 1.0
                for f in feats[i, k]:
                    grad[f"{t}|{f}"] += 1.0
            p, j = t, k
        return total - z


def _logsum(vs: list[float]) -> float:
    top = max(vs)
    return top + math.log(sum(math.exp(v - top) for v in vs))


def _gold(lattice: Lattice, spans: list[tuple[str, int, int]]) -> dict[tuple[int, int], int]:
    """Segments that are base spans; the longest wins where two meet."""
    found: dict[tuple[int, int], int] = {}
    taken: set[int] = set()
    where = {(a, b): (i, j) for j, c in enumerate(lattice.into) for i, a, b, _ in c}
    for kind, a, b in sorted(spans, key=lambda s: (s[1] - s[2], s[1], s[0])):
        at = where.get((a, b))
        if at and taken.isdisjoint(range(*at)):
            found[at] = KINDS.index(kind) + 1
            taken.update(range(*at))
    return found


def _national(text: str) -> str:
    return re.sub(r"\+[0-9]{1,3}[ .-]+(?=[(0-9])", "", text)


def in_runs(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Rows of one span of ``text`` repeated and of one beside a short number, with the spans to find.

    One span of each kind is used, the first.
    """
    out = []
    for kind in KINDS:
        span = next((text[a:b] for k, a, b in spans if k == kind), None)
        if span is None:
            continue
        step = len(span) + 1
        for times in (2, 3):
            out.append((" ".join([span] * times), [(kind, i * step, i * step + len(span)) for i in range(times)]))
        out.append((f"27 {span}", [(kind, 3, 3 + len(span))]))
        out.append((f"{span} 27", [(kind, 0, len(span))]))
    return out


def region_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Region texts of the sampled documents; at most ``MAX_REGIONS``, cut on the workers."""
    sample = sampled_texts(docs.filter(F.col("text").rlike("[0-9@]")), sample_docs)

    def run(cols: dict[str, list]) -> dict[str, list]:
        out = []
        for text in cols["text"]:
            for tokens in regions(text or "")[:DOC_REGIONS]:
                tokens = tokens[:REGION_TOKENS]
                out.append(text[tokens[0][0] : tokens[-1][1]])
        return {"region": out}

    rows = map_rows(sample, run, "region string").distinct().orderBy(F.xxhash64("region"), "region").limit(MAX_REGIONS).collect()
    return [r["region"] for r in rows]


def train(docs: DataFrame) -> dict[str, float]:
    """Weights of the field by AdaGrad over the bounded sample (no region: no weights)."""
    cases = []
    for text in region_texts(docs):
        spans = base_spans(text)
        variants = [(text, spans)]
        plain = _national(text)
        if plain != text and not any(k == "card" for k, _, _ in spans):
            shifted = []
            for k, a, b in spans:
                cut = _national(text[a:b])
                at = plain.find(cut)
                if at >= 0:
                    shifted.append((k, at, at + len(cut)))
            variants.append((plain, shifted))
        variants += in_runs(text, spans)
        for t, found in variants:
            for tokens in regions(t):
                lattice = Lattice(t, tokens)
                cases.append((lattice, _gold(lattice, found)))
    w: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(float)
    for _ in range(EPOCHS):
        for lattice, gold in cases:
            grad: dict[str, float] = defaultdict(float)
            lattice.gradient(w, gold, grad)
            for f, g in grad.items():
                g -= 0.002 * w[f]
                seen[f] += g * g
                w[f] += 0.5 * g / math.sqrt(seen[f] + 1e-8)
    return {f: v for f, v in w.items() if abs(v) > 1e-6}


def model_spans(text: str, w: dict[str, float]) -> list[tuple[str, int, int]]:
    if not w:
        return []
    out = []
    for tokens in regions(text):
        lattice = Lattice(text, tokens)
        if any(lattice.into):
            out += [(KINDS[t - 1], a, b) for t, a, b, s in lattice.decode(w) if s >= MIN_SCORE]
    return out


def all_spans(text: str, w: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base spans and the model's that meet none of them)."""
    base = base_spans(text)
    if not _HINT.search(text):
        return base, base
    own = [s for s in model_spans(text, w) if all(s[2] <= a or b <= s[1] for _, a, b in base)]
    return base, sorted(base + own, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes one placeholder named after its first kind."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256`` and ``spans`` of every row."""
    w = train(docs) if weights is None else weights

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"]} | {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for text in cols["text"]:
            base, every = all_spans(text or "", w)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
        return out

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text"), run,
        "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string",
    )


def redact(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` (columns of documents) with spans replaced and ``n_chars`` brought up to date."""
    w = train(docs) if weights is None else weights
    cols = ["doc_id", "text", "lang", "source", "n_chars"]

    def run(got: dict[str, list]) -> dict[str, list]:
        text = [t if t is None else redacted(t, all_spans(t, w)[1]) for t in got["text"]]
        n = [old if t is None else len(t) for t, old in zip(text, got["n_chars"])]
        return got | {"text": text, "n_chars": n}

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")), run,
        "doc_id long, text string, lang string, source string, n_chars long",
    ).select(*cols)
