"""Encodings and encoding chains: which bytes stand for a set of code points."""

from __future__ import annotations

import codecs
import encodings.aliases
import functools
from collections.abc import Callable, Iterator

from . import sets
from .sets import Ranges

#: Bytes ranges one after another: a match of each in turn.
Sequence = tuple[tuple[int, int], ...]

_SCALARS = sets.difference(sets.ALL, ((0xD800, 0xDFFF),))
#: Names of the encodings that are built from rules; fixed values.
_NATIVE = {"us-ascii": "US-ASCII", "ascii": "US-ASCII", "ansi_x3.4-1968": "US-ASCII", "utf-8": "UTF-8", "utf8": "UTF-8", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-32le": "UTF-32LE", "utf-32be": "UTF-32BE"}
#: Codecs that keep state, write byte-order marks or aren't text; fixed values.
_UNUSABLE = ("utf_7", "utf_16", "utf_32", "utf_8_sig", "iso2022", "hz", "punycode", "idna", "unicode_escape", "raw_unicode_escape", "base64", "bz2", "hex", "quopri", "rot_13", "uu", "zlib", "mbcs", "oem", "undefined", "tactis", "utf_16_le", "utf_16_be", "utf_32_le", "utf_32_be")
_BYTE_TABLES: dict[str, bytes] = {}


class EncodingError(ValueError):
    """An unknown encoding, or code points that an encoding lacks."""


def register_byte_table(name: str, table: bytes) -> None:
    """Name a permutation of the 256 bytes, such as that of a mail store's compressible encryption (OCE), for use in chains."""
    if sorted(table) != list(range(256)):
        raise ValueError("a byte table is a permutation of 256 bytes")
    _BYTE_TABLES[name.upper()] = bytes(table)


def rotated(n: int) -> bytes:
    """The table that moves ASCII letters on by n."""
    return bytes((b - 65 + n) % 26 + 65 if 65 <= b <= 90 else (b - 97 + n) % 26 + 97 if 97 <= b <= 122 else b for b in range(256))


def xored(key: int) -> bytes:
    """The table that flips the bits of key."""
    return bytes(b ^ key for b in range(256))


def resolve(name: str) -> str:
    """The canonical name of a character encoding."""
    low = name.strip().lower()
    if low in _NATIVE:
        return _NATIVE[low]
    try:
        found = codecs.lookup(low).name
    except (LookupError, ValueError):
        raise EncodingError(f"unrecognized encoding '{name}'") from None
    if found in ("utf-8", "ascii"):
        return _NATIVE[found]
    if found.replace("-", "_").startswith(_UNUSABLE) or not codecs.lookup(low)._is_text_encoding:
        raise EncodingError(f"unrecognized encoding '{name}'")
    return found


def parse_chain(chain: str) -> tuple[str, tuple[Callable[[bytes], bytes], ...], str]:
    """The character encoding, byte transforms and full canonical name of a chain such as ``identity|UTF-8|OCE``."""
    parts = [p.strip() for p in chain.split("|")]
    while len(parts) > 1 and parts[0].lower() == "identity":
        parts = parts[1:]
    name = resolve(parts[0])
    steps: list[Callable[[bytes], bytes]] = []
    named = [name]
    for p in parts[1:]:
        up = p.upper()
        if up == "IDENTITY":
            continue
        if up in _BYTE_TABLES:
            table = _BYTE_TABLES[up]
        elif up.startswith("ROT") and up[3:].isdigit():
            table = rotated(int(up[3:]) % 26)
        elif up.startswith("XOR") and all(c in "0123456789ABCDEF" for c in up[3:]) and up[3:]:
            table = xored(int(up[3:], 16) & 255)
        else:
            raise EncodingError(f"unrecognized byte transformation '{p}'")
        steps.append(lambda b, t=table: b.translate(t))
        named.append(up)
    return name, tuple(steps), "|".join(named)


def _split(lo: int, hi: int, width: int, base: int = 256, first: int = 0) -> Iterator[Sequence]:
    """Numbers lo to hi, written in width digits, as sequences of digit ranges."""
    if width == 1:
        yield ((lo, hi),)
        return
    unit = base ** (width - 1)
    a, b = lo // unit, hi // unit
    if a == b:
        for rest in _split(lo % unit, hi % unit, width - 1, base):
            yield ((a, a), *rest)
        return
    if lo % unit:
        for rest in _split(lo % unit, unit - 1, width - 1, base):
            yield ((a, a), *rest)
        a += 1
    whole_end = b if hi % unit == unit - 1 else b - 1
    if a <= whole_end:
        yield ((a, whole_end), *(((0, base - 1),) * (width - 1)))
    if whole_end != b:
        for rest in _split(0, hi % unit, width - 1, base):
            yield ((b, b), *rest)


def _utf8(points: Ranges) -> Iterator[Sequence]:
    for first, last, width, lead in ((0, 0x7F, 1, 0), (0x80, 0x7FF, 2, 0xC0), (0x800, 0xFFFF, 3, 0xE0), (0x10000, sets.LAST, 4, 0xF0)):
        for lo, hi in sets.intersection(sets.intersection(points, _SCALARS), ((first, last),)):
            for digits in _split(lo, hi, width, 64):
                if width == 1:
                    yield ((lo, hi),)
                    break
                yield ((digits[0][0] + lead, digits[0][1] + lead), *((a + 0x80, b + 0x80) for a, b in digits[1:]))
            if width == 1:
                continue


def _utf16(points: Ranges, little: bool) -> Iterator[Sequence]:
    def order(s: Sequence) -> Sequence:
        return tuple(x for i in range(0, len(s), 2) for x in (reversed(s[i : i + 2]) if little else s[i : i + 2]))

    for lo, hi in sets.intersection(sets.intersection(points, _SCALARS), ((0, 0xFFFF),)):
        for s in _split(lo, hi, 2):
            yield order(s)
    for lo, hi in sets.intersection(points, ((0x10000, sets.LAST),)):
        for s in _split(lo - 0x10000, hi - 0x10000, 2, 1024):
            for high in _split(0xD800 + s[0][0], 0xD800 + s[0][1], 2):
                for low in _split(0xDC00 + s[1][0], 0xDC00 + s[1][1], 2):
                    yield order(high + low)


def _utf32(points: Ranges, little: bool) -> Iterator[Sequence]:
    for lo, hi in sets.intersection(points, _SCALARS):
        for s in _split(lo, hi, 4):
            yield tuple(reversed(s)) if little else s


@functools.lru_cache(maxsize=16)
def _table(name: str) -> dict[int, bytes]:
    """The bytes of each code point of a legacy encoding."""
    out = {}
    for cp in sets.points(_SCALARS):
        if cp > 0x2FFFF:
            break
        try:
            out[cp] = chr(cp).encode(name)
        except (UnicodeError, ValueError):
            continue
    return out


@functools.lru_cache(maxsize=64)
def valid_points(name: str) -> Ranges:
    """The code points that an encoding has."""
    if name == "US-ASCII":
        return ((0, 0x7F),)
    if name.startswith("UTF-"):
        return _SCALARS
    return sets.make((cp, cp) for cp in _table(name))


def collapsed(sequences: list[Sequence]) -> list[Sequence]:
    """Sequences that differ in one place only, with that place's ranges side by side, joined."""
    done = sorted(set(sequences))
    for place in (-1, 0):
        groups: dict[tuple, list[tuple[int, int]]] = {}
        for s in done:
            rest = (len(s), s[:-1] if place else s[1:])
            groups.setdefault(rest, []).append(s[place])
        done = [((*rest, r) if place else (r, *rest)) for (_, rest), ranges in groups.items() for r in sets.make(ranges)]
    return sorted(done)


def byte_sequences(points: Ranges, chain: str) -> list[Sequence]:
    """All byte sequences of a set of code points in an encoding chain; code points that the encoding lacks are left out."""
    name, steps, _ = parse_chain(chain)
    if name == "US-ASCII":
        found = [((lo, hi),) for lo, hi in sets.intersection(points, ((0, 0x7F),))]
    elif name == "UTF-8":
        found = list(_utf8(points))
    elif name.startswith("UTF-16"):
        found = list(_utf16(points, name.endswith("LE")))
    elif name.startswith("UTF-32"):
        found = list(_utf32(points, name.endswith("LE")))
    else:
        table = _table(name)
        chosen = (table[cp] for cp in sets.points(sets.intersection(points, valid_points(name))))
        found = [tuple((b, b) for b in raw) for raw in chosen]
    for step in steps:
        found = [tuple(x) for s in found for x in _mapped(s, step)]
    return collapsed(found)


def _mapped(s: Sequence, step: Callable[[bytes], bytes]) -> Iterator[tuple[tuple[int, int], ...]]:
    places = [sets.make((b, b) for b in step(bytes(range(lo, hi + 1)))) for lo, hi in s]
    out: list[tuple[tuple[int, int], ...]] = [()]
    for p in places:
        out = [(*o, r) for o in out for r in p]
    yield from out


def decoded(data: bytes, chain: str) -> str:
    """Text of bytes in a chain, undecodable bytes as U+FFFD."""
    name, steps, _ = parse_chain(chain)
    for step in reversed(steps):
        table = step(bytes(range(256)))
        back = bytearray(256)
        for i, b in enumerate(table):
            back[b] = i
        data = data.translate(bytes(back))
    return data.decode(name, "replace").replace("\0", "\ufffd")


def known_encodings() -> dict[str, list[str]]:
    """Canonical names and their other names."""
    out: dict[str, set[str]] = {}
    for alias, target in [*_NATIVE.items(), *encodings.aliases.aliases.items()]:
        try:
            out.setdefault(resolve(alias), set()).update((alias, target))
        except EncodingError:
            continue
    return {k: sorted(v - {k}) for k, v in sorted(out.items())}


def encoding_id(name: str) -> int:
    """The place of an encoding in the list, or -1."""
    try:
        return list(known_encodings()).index(resolve(name))
    except (EncodingError, ValueError):
        return -1
