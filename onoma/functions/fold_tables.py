"""Character fold tables for name standardisation.

The standard key lower-cases, applies Unicode NFKD and drops every character
with a non-zero combining class. That is a per-character function ``fold``
(lower-casing is context free here except for final sigma, which ends up as a
separator either way, and NFKD reordering only moves combining marks, which
are dropped). The tables below are generated once on the driver from Python's
``unicodedata`` and reach the executors as literals inside the plan, so the
executors' Java Unicode version plays no part.

Only entries that can change a key are kept. A character is *significant* when
it can survive into a key or steer the title rule: ASCII letters, whitespace,
``.`` and dotless ``ı`` (which a case-insensitive title match treats as ``i``).
Any other character is a separator in the end, so a fold from one such
character to others is left out.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

_SIGNIFICANT = re.compile(r"[A-Za-z.\sı]")


def fold_char(ch: str) -> str:
    decomposed = unicodedata.normalize("NFKD", ch.lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def _is_significant(text: str) -> bool:
    return bool(_SIGNIFICANT.search(text))


@functools.lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """Return ``(matching, replace, expansions)``.

    ``matching``/``replace`` feed ``translate``: the first ``len(replace)``
    characters map one to one, the rest are deleted. ``expansions`` maps the
    characters whose fold is several characters long.
    """
    one_from: list[str] = []
    one_to: list[str] = []
    dropped: list[str] = []
    expansions: dict[str, str] = {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        out = fold_char(ch)
        if out == ch:
            continue
        if not out:
            dropped.append(ch)
        elif not (_is_significant(ch) or _is_significant(out)):
            continue
        elif len(out) == 1:
            one_from.append(ch)
            one_to.append(out)
        else:
            expansions[ch] = out
    return "".join(one_from) + "".join(dropped), "".join(one_to), expansions


@functools.lru_cache(maxsize=1)
def whitespace_chars() -> str:
    """Every character Python's ``str.isspace`` (and ``re``'s ``\\s``) accepts."""
    return "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


def java_char_class(chars: str, negate: bool = False) -> str:
    """A Java regex character class of ``chars``: code points below 256 one by one, which Java looks up
    in a table, others as ranges, which it tests in turn."""
    parts = []
    runs: list[list[int]] = []
    for cp in sorted(set(map(ord, chars))):
        if cp < 256:
            parts.append(f"\\x{{{cp:X}}}")
        elif runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    parts += [f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs]
    return ("[^" if negate else "[") + "".join(parts) + "]"
