"""Sets of code points as sorted, disjoint, inclusive ranges."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable, Iterator

Ranges = tuple[tuple[int, int], ...]
LAST = 0x10FFFF


def make(ranges: Iterable[tuple[int, int]]) -> Ranges:
    """Ranges in order, with touching and overlapping ones joined."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


def of(*points: int) -> Ranges:
    return make((p, p) for p in points)


def union(*sets: Ranges) -> Ranges:
    return make(r for s in sets for r in s)


def complement(s: Ranges, last: int = LAST) -> Ranges:
    out, at = [], 0
    for lo, hi in s:
        if lo > at:
            out.append((at, lo - 1))
        at = hi + 1
    if at <= last:
        out.append((at, last))
    return tuple(out)


def intersection(a: Ranges, b: Ranges) -> Ranges:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo <= hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def difference(a: Ranges, b: Ranges) -> Ranges:
    return intersection(a, complement(b))


def symmetric(a: Ranges, b: Ranges) -> Ranges:
    return difference(union(a, b), intersection(a, b))


def size(s: Ranges) -> int:
    return sum(hi - lo + 1 for lo, hi in s)


def points(s: Ranges) -> Iterator[int]:
    for lo, hi in s:
        yield from range(lo, hi + 1)


ALL: Ranges = ((0, LAST),)
DIGIT = make([(48, 57)])
WORD = make([(48, 57), (65, 90), (95, 95), (97, 122)])
SPACE = make([(9, 13), (32, 32)])
# Horizontal and vertical white space.
HORIZONTAL = of(0x9, 0x20, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
VERTICAL = of(*range(0xA, 0xE), 0x85, 0x2028, 0x2029)


@functools.lru_cache(maxsize=64)
def category(prefix: str) -> Ranges:
    """Code points whose general category starts with prefix."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp)).startswith(prefix)
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append((start, cp - 1))
            start = None
    return tuple(out)


#: Long names of general categories; fixed values.
CATEGORIES = {
    "letter": "L", "cased_letter": "LC", "uppercase_letter": "Lu", "lowercase_letter": "Ll", "titlecase_letter": "Lt", "modifier_letter": "Lm", "other_letter": "Lo",
    "mark": "M", "nonspacing_mark": "Mn", "spacing_mark": "Mc", "enclosing_mark": "Me", "number": "N", "decimal_number": "Nd", "letter_number": "Nl", "other_number": "No",
    "punctuation": "P", "connector_punctuation": "Pc", "dash_punctuation": "Pd", "open_punctuation": "Ps", "close_punctuation": "Pe", "initial_punctuation": "Pi", "final_punctuation": "Pf", "other_punctuation": "Po",
    "symbol": "S", "math_symbol": "Sm", "currency_symbol": "Sc", "modifier_symbol": "Sk", "other_symbol": "So", "separator": "Z", "space_separator": "Zs", "line_separator": "Zl", "paragraph_separator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "private_use": "Co", "unassigned": "Cn",
}


def property_set(name: str) -> Ranges | None:
    """The set of a property expression: a general category, Any, ASCII, a script, block or binary property; None if unknown."""
    text = name.strip()
    negated = text.startswith("^")
    key = text.lstrip("^").split("=")[-1].split(":")[-1].strip()
    low = key.lower().replace(" ", "_").replace("-", "_").removeprefix("is_")
    if low == "any":
        found: Ranges | None = ALL
    elif low == "ascii":
        found = ((0, 127),)
    elif low in ("alphabetic", "alpha"):
        found = union(category("L"), category("Nl"))
    elif low in ("uppercase", "upper"):
        found = category("Lu")
    elif low in ("lowercase", "lower"):
        found = category("Ll")
    elif low in ("white_space", "whitespace", "space"):
        found = union(HORIZONTAL, VERTICAL) if low != "white_space" else difference(union(HORIZONTAL, VERTICAL), of(0x180E))
    elif low in CATEGORIES:
        found = union(category("Lu"), category("Ll"), category("Lt")) if low == "cased_letter" else category(CATEGORIES[low])
    elif low.capitalize() in CATEGORIES.values() or key in CATEGORIES.values():
        found = category(low.capitalize())
    else:
        found = _property(text.lstrip("^").strip())
    return None if found is None else complement(found) if negated else found


@functools.lru_cache(maxsize=32)
def _property(expression: str) -> Ranges | None:
    """A property that the regex library knows: scripts, blocks, binary properties; without the library, characters whose names begin with the word."""
    try:
        import regex
    except ImportError:
        start = expression.split("=")[-1].upper().replace("_", " ") + " "
        return make((cp, cp) for cp in range(sys.maxunicode + 1) if unicodedata.name(chr(cp), "").startswith(start)) or None
    key, sign, value = (x.strip() for x in expression.partition("="))
    known = {"sc": "Script", "scx": "Script_Extensions", "gc": "General_Category", "blk": "Block"}
    try:
        found = regex.compile(rf"[\p{{{known.get(key.lower(), key)}{sign}{value}}}]+")
    except regex.error:
        return None
    out = [(m.start(), m.end() - 1) for m in found.finditer(_everything())]
    # Surrogates stand in the text as themselves, so offsets are code points.
    return make(out) or None


@functools.lru_cache(maxsize=1)
def _everything() -> str:
    return "".join(map(chr, range(sys.maxunicode + 1)))


@functools.lru_cache(maxsize=1)
def _folds() -> dict[int, tuple[int, ...]]:
    """Code points that are equal but for case, by simple folding."""
    groups: dict[str, set[int]] = {}
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        for f in (c.casefold(), c.lower(), c.upper()):
            if len(f) == 1 and f != c:
                groups.setdefault(c.casefold() if len(c.casefold()) == 1 else c, set()).update((cp, ord(f)))
    out: dict[int, set[int]] = {}
    for g in groups.values():
        for cp in g:
            out.setdefault(cp, set()).update(g)
    return {cp: tuple(sorted(set().union(*(out[x] for x in g)))) for cp, g in out.items()}


def close_case(s: Ranges, ascii_only: bool) -> Ranges:
    """A set with the other cases of its members."""
    if ascii_only:
        lower, upper = intersection(s, ((97, 122),)), intersection(s, ((65, 90),))
        return union(s, tuple((a - 32, b - 32) for a, b in lower), tuple((a + 32, b + 32) for a, b in upper))
    if size(s) > 0x100000:
        return s if s == ALL else union(s, make((x, x) for cp, g in _folds().items() if any(a <= cp <= b for a, b in s) for x in g))
    folds = _folds()
    more = [(x, x) for cp in points(s) if cp in folds for x in folds[cp]] if size(s) < len(folds) else [(x, x) for cp, g in folds.items() if any(a <= cp <= b for a, b in s) for x in g]
    return union(s, make(more)) if more else s
