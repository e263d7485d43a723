"""What stands around a hit."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytetrawl.functions import encodings


@dataclass(frozen=True)
class Context:
    """Decoded context, the hit's place in it (bytes of its UTF-8 form), the offset of its first byte, and how many values were bad."""

    context: str
    hit_begin: int
    hit_end: int
    data_offset: int
    bad: int = 0


def leading(data: bytes, start: int, before: int) -> int:
    """Where the line of start begins, or the line so many before it; start itself for -1."""
    if before < 0:
        return start
    at = start
    for _ in range(before + 1):
        nl = data.rfind(b"\n", 0, at)
        if nl < 0:
            return 0
        at = nl
    return at + 1


def trailing(data: bytes, end: int, after: int) -> int:
    """Where the line of end - 1 ends, or the line so many after it, without a carriage return before the line's end; end itself below 0."""
    if after < 0:
        return end
    at = max(end - 1, 0)
    for i in range(after + 1):
        nl = data.find(b"\n", at)
        if nl < 0:
            return len(data)
        at = nl + 1
    nl = at - 1
    if nl > end and data[nl - 1 : nl] == b"\r":
        nl -= 1
    return max(nl, end)


def text_of(data: bytes, chain: str) -> str:
    """A hit's text; bytes that can't be decoded, and null characters, are U+FFFD."""
    return encodings.decoded(data, "UTF-8" if chain == "US-ASCII" else chain)


def hit_context(data: bytes, start: int, end: int, before: int, after: int, chain: str = "UTF-8") -> Context:
    """The lines around the hit [start, end)."""
    if before < -1 or after < -1:
        before, after = max(before, -1), max(after, -1)
    a, b = leading(data, start, before), trailing(data, end, after)
    left, hit, right = (text_of(data[x:y], chain) for x, y in ((a, start), (start, end), (end, b)))
    n = len(left.encode("utf-8"))
    whole = left + hit + right
    return Context(whole, n, n + len(hit.encode("utf-8")), a, whole.count("�"))


def read_window(data: bytes, offset: int, chain: str, begin: int, end: int, pre: int, post: int) -> tuple[list[int], list[int], tuple[int, int], int]:
    """Code points and offsets of the hit [begin, end) with pre values before and post after; the hit's range of values; the number of bad ones.

    A byte that can't be decoded is -(byte) - 1. The last offset is where the window ends. Of the alignments that the values before the hit
    can have, that whose good run beside the hit is longest is taken, then that with the fewest bad values.
    """
    name = encodings.parse_chain(chain)[0]

    def decode(part: bytes, at: int) -> list[tuple[int, int]]:
        out, i = [], 0
        while i < len(part):
            for n in range(1, 5):
                try:
                    text = part[i : i + n].decode(name)
                except (UnicodeError, ValueError):
                    continue
                if len(text) == 1 and i + n <= len(part):
                    out.append((ord(text), at + i))
                    i += n
                    break
            else:
                out.append((-part[i] - 1, at + i))
                i += 1
        return out

    hit = decode(data[begin:end], begin)
    right = decode(data[end:], end)[:post] if post else []
    stop = len(data) if len(decode(data[end:], end)) <= post else decode(data[end:], end)[post][1]
    left: list[tuple[int, int]] = []
    if pre:
        best = None
        for back in range(min(begin, pre * 4), max(0, min(begin, pre * 4) - 4), -1):
            values = decode(data[begin - back : begin], begin - back)[-pre:]
            run = 0
            for v, _ in reversed(values):
                if v < 0:
                    break
                run += 1
            rank = (-run, sum(v < 0 for v, _ in values))
            if best is None or rank < best[0]:
                best = rank, values
        left = best[1] if best else []
    values = left + hit + right
    return [v for v, _ in values], [offset + o for _, o in values] + [offset + (stop if right or not post else end)], (len(left), len(left) + len(hit)), sum(v < 0 for v, _ in values)


def full_hit_context(data: bytes, start: int, end: int, chain: str = "UTF-8", window: int = 100, replacement: str = " ") -> tuple[str, int, int]:
    """Text of a hit with so many code points around it, and the hit's place in it (code points); bad values and null characters are the replacement."""
    values, _, (a, b), _ = read_window(data, 0, chain, start, end, window, window)
    return "".join(chr(v) if v > 0 and not 0xD800 <= v < 0xE000 else replacement for v in values), a, b


def with_windows(hits: DataFrame, content: str, pre: int, post: int) -> DataFrame:
    """Hits (start, end, enc_chain and the searched value in a column) with window: values, offsets, begin, end and bad, as read_window gives them. A null value has a null window."""
    kind = dict(hits.dtypes)[content]
    schema = "values array<int>, offsets array<long>, begin int, end int, bad int"

    @F.pandas_udf(schema)  # type: ignore[call-overload]
    def window(raw: pd.Series, start: pd.Series, end: pd.Series, chain: pd.Series) -> pd.DataFrame:
        rows = []
        for r, s, e, c in zip(raw, start, end, chain, strict=True):
            if r is None:
                rows.append((None, None, None, None, None))
                continue
            values, offsets, (a, b), bad = read_window(bytes(r), 0, "UTF-8" if c == "US-ASCII" else c, int(s), int(e), pre, post)
            rows.append((values, offsets, a, b, bad))
        return pd.DataFrame(rows, columns=["values", "offsets", "begin", "end", "bad"])

    raw = F.encode(content, "UTF-8") if kind == "string" else F.col(content)
    return hits.withColumn("window", window(raw, "start", "end", "enc_chain"))


def line_options(both: int | None = None, before: int | None = None, after: int | None = None) -> tuple[int, int]:
    """Lines before and after from three options; both sets the other two. ValueError below -1."""
    b, a = (both, both) if both is not None else (before if before is not None else -1, after if after is not None else -1)
    if b < -1 or a < -1:
        raise ValueError("a number of context lines must not be negative")
    return b, a
