"""SQL text builders for the DuckDB oracles.

The oracle restates each job in plain SQL over the same parquet tables. The
pieces Spark and DuckDB lack natively are spelled out here too:

* ``lcs``: bit-parallel LCS over up to ``WORDS`` 62-bit words, the state a
  list of BIGINT words with explicit carries, folded over the longer
  string's characters with ``list_reduce``;
* ``pyround``: half-even rounding on the exact binary value (two-product
  error term), as in the Spark job.
"""

from __future__ import annotations

# Written out here, not imported from the code under test.
TITLES = ("dr", "dra", "sr", "sra", "srta", "ing", "lic", "prof")
SPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

WORDS = 6
BITS = 62
MASK = (1 << BITS) - 1

SEGMENT_RE = "[.!?;:,|\\n]+"


def dbl(v: float | int) -> str:
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS DOUBLE)"


def norm(x: str) -> str:
    """Standard key in DuckDB (``strip_accents`` stands in for NFKD + mark removal)."""
    ws = SPACE
    titles = "|".join(t.replace("i", "[iı]") for t in TITLES)
    s = f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"
    s = f"strip_accents(lower({s}))"
    s = f"regexp_replace({s}, '(?i)^(?:{titles})\\.?{ws}+', '')"
    return f"trim(regexp_replace({s}, '[^a-zA-Z]+', ' ', 'g'))"


def grams(x: str, n: int = 3) -> str:
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN length({x}) = 0 THEN []::VARCHAR[] "
        f"WHEN length({x}) <= {n} THEN [{x}] "
        f"ELSE list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n})) END)"
    )


def tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> '')))"


def _lcs_words(s: str, l: str, words: int) -> str:
    """LCS(s, l) with ``words`` 62-bit words; s is the shorter string."""
    zero = "0::BIGINT"
    word_mask = (
        f"list_reduce(list_transform(range({BITS} * w, least({BITS} * w + {BITS}, length({s}))), "
        f"lambda p: CASE WHEN {s}[p + 1] = c THEN (1::BIGINT << (p - {BITS} * w)) ELSE {zero} END), "
        f"lambda x, y: x | y, {zero})"
    )
    masks = (
        f"map_from_entries(list_transform(list_distinct(string_split({s}, '')), "
        f"lambda c: {{'k': c, 'v': list_transform(range({words}), lambda w: {word_mask})}}))"
    )
    full = [
        f"((1::BIGINT << greatest(0, least({BITS}, length({s}) - {BITS * w}))) - 1)" for w in range(words)
    ]
    init = "[" + ", ".join(full) + "]"
    zeros = "[" + ", ".join([zero] * words) + "]"
    # the longer string as a list of per-character mask lists, built once
    mapped = f"list_transform(string_split({l}, ''), lambda ch: coalesce(__m[ch], {zeros}))"
    carry = "0::BIGINT"
    out = []
    for w in range(words):
        u = f"(st[{w + 1}] & mk[{w + 1}])"
        total = f"(st[{w + 1}] + {u} + {carry})"
        out.append(f"((({total} & {MASK}) | (st[{w + 1}] & ~{u})) & {full[w]})")
        carry = f"({total} >> {BITS})"
    step = "[" + ", ".join(out) + "]"
    popcount = " + ".join(f"bit_count(__s[{w + 1}])" for w in range(words))
    return (
        f"list_transform([{masks}], lambda __m: list_transform([list_reduce({mapped}, lambda st, mk: {step}, {init})], "
        f"lambda __s: length({s}) - ({popcount}))[1])[1]"
    )


def _lcs_short_first(s: str, l: str) -> str:
    """LCS(s, l) for length(s) <= WORDS*BITS; s must be the shorter string."""
    branches = " ".join(
        f"WHEN length({s}) <= {BITS * w} THEN {_lcs_words(s, l, w)}" for w in range(1, WORDS + 1)
    )
    return f"(CASE WHEN length({s}) = 0 OR length({l}) = 0 THEN 0 {branches} ELSE error('string too long for the oracle') END)"


def lcs(a: str, b: str) -> str:
    return (
        f"(CASE WHEN length({a}) <= length({b}) THEN {_lcs_short_first(a, b)} "
        f"ELSE {_lcs_short_first(b, a)} END)"
    )


def pyround(x: str, digits: int) -> str:
    scale = dbl(float(10**digits))
    p = f"({x} * {scale})"
    c = f"({x} * {dbl(134217729.0)})"
    hi = f"({c} - ({c} - {x}))"
    lo = f"({x} - {hi})"
    err = f"(({hi} * {scale} - {p}) + {lo} * {scale})"
    f = f"floor({p})"
    frac = f"({p} - {f})"
    odd = f"({f} - 2 * floor({f} / 2) = 1)"
    up = f"({frac} > 0.5 OR ({frac} = 0.5 AND ({err} > 0 OR ({err} = 0 AND {odd}))))"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE ({f} + CASE WHEN {up} THEN 1 ELSE 0 END) / {scale} END)"


def segments_sql(table: str, id_col: str, text_col: str, out_id: str = "id", out_text: str = "full_name") -> str:
    return (
        f"SELECT _src * 268435456 + _pos AS {out_id}, trim(_seg) AS {out_text} FROM ("
        f"SELECT {id_col} AS _src, unnest(_parts) AS _seg, unnest(range(len(_parts))) AS _pos FROM ("
        f"SELECT {id_col}, regexp_split_to_array({text_col}, '{SEGMENT_RE}') AS _parts FROM {table})) "
        f"WHERE trim(_seg) <> ''"
    )
