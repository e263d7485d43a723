"""Repeated byte strings by suffix sorting in buckets, with ties resolved by difference-cover ranks.

Only strings of LENGTH bytes are compared. Each such string is put in the bucket of its anchor, the byte run of GRAM bytes in it
that has the smallest hash (the leftmost of them), so equal strings share a bucket and lie alike around the anchor. The strings
of one anchor are a block of text. Blocks of an anchor that are equal, by 96-bit digests of their bytes, are repeated as a whole, and
one of them stands for all. An anchor with one kind of block is done with that; the blocks of others are sorted, one bucket at a time. Blocks are
laid out so that anchors stand at multiples of COVER; suffixes are ordered by their first COVER bytes, and longer ties by the rank,
precomputed by doubling, of the next position that belongs to the difference cover. Equal strings have equal shifts to the cover, so
they become neighbours, and neighbours are compared on all LENGTH bytes.

A bucket of more than MOST_BLOCKS kinds is divided by further bytes: its strings are halved by how far before the anchor they start,
which makes two pieces of each block, and the strings of a piece share more bytes around the anchor than those of the block; these
bytes are the bucket of the piece. That goes on until buckets are small enough, at the latest when a piece is a single string, and pieces
without a partner are dropped on the way. Sorting is the same for buckets of any origin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INVERSE, discard, filled, mix64, powers, prepare, scratch, written

LENGTH, GRAM, COVER = 200, 64, 32
#: Blocks that are sorted together, on average; buckets of more than MOST_BLOCKS kinds are divided first.
BUCKET_BLOCKS, MOST_BLOCKS = 2000, 2000
#: Bytes whose anchors are found at once; positions there must fit in 24 bits.
PART_BYTES = 1 << 22


def difference_cover(v: int) -> np.ndarray:
    """A small set of residues such that every residue is a difference of two of them, chosen greedily."""
    chosen, have = [0], {0}
    while len(have) < v:
        best = max(range(v), key=lambda x: (len({(x - c) % v for c in chosen} | {(c - x) % v for c in chosen} | have), -x))
        have |= {(best - c) % v for c in chosen} | {(c - best) % v for c in chosen}
        chosen.append(best)
    return np.array(sorted(chosen))


_COVER = difference_cover(COVER)
#: The distance from each residue to the next position in the cover.
_SHIFT = np.array([min((c - r) % COVER for c in _COVER) for r in range(COVER)])


def anchors(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that end at limits in data: the text, anchor, first and last string start of each block, and the hash of its anchor."""
    n = len(data)
    empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if n < LENGTH:
        return empty
    byte = mix64(np.arange(1, 257, dtype=np.uint64))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(byte[data] * powers(n), out=prefix[1:])
    grams = mix64((prefix[GRAM:] - prefix[:-GRAM]) * powers(n, _INVERSE)[: n - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    # The least of each w neighbours: least to the end of a stretch of w, and from the start of the next one.
    w = LENGTH - GRAM + 1
    pad = -len(key) % w
    tiles = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(tiles, axis=1).reshape(-1)
    at = (np.minimum(ahead[: n - LENGTH + 1], behind[w - 1 : w - 1 + n - LENGTH + 1]) & low).astype(np.int64)
    start = np.arange(n - LENGTH + 1)
    text = np.searchsorted(limits, start, side="right")
    inside = start + LENGTH <= limits[np.minimum(text, len(limits) - 1)]
    start, at, text = start[inside], at[inside], text[inside]
    if not len(start):
        return empty
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    first, last = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])]
    a = at[new]
    return text[new], a, first, last, grams[a]


def digests(blocks: list[bytes], anchor: np.ndarray) -> np.ndarray:
    """96 bits of each block and the place of its anchor in it, as two numbers h0 and h1."""
    raw = b"".join(hashlib.blake2b(b, digest_size=12, salt=int(x).to_bytes(4, "little")).digest() for b, x in zip(blocks, anchor, strict=True))
    return np.frombuffer(raw, dtype=np.dtype([("h0", "<i8"), ("h1", "<i4")]))


def _parts(raw: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts joined in parts of at most PART_BYTES, unless one text is longer: (number of the first, data, limits)."""
    i = 0
    while i < len(raw):
        j, size = i + 1, len(raw[i])
        while j < len(raw) and size + len(raw[j]) <= PART_BYTES:
            size += len(raw[j])
            j += 1
        yield i, np.frombuffer(b"".join(raw[i:j]), dtype=np.uint8), np.cumsum([len(r) for r in raw[i:j]])
        i = j


def _long_parts(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text of more bytes than positions may have, in parts that overlap so that each string is in one of them."""
    step = (1 << 24) - LENGTH
    for at in range(0, max(1, len(data) - LENGTH + 1), step):
        yield at, data[at : at + step + LENGTH - 1]


def sorted_repeats(blocks: list[bytes], anchor: np.ndarray) -> list[np.ndarray]:
    """Which strings of each block, from its first on, stand in another block of the bucket too. anchor: where it stands in a block."""
    size = np.array([len(b) for b in blocks])
    begin = np.zeros(len(blocks), dtype=np.int64)
    at = COVER
    for i in range(len(blocks)):  # anchors at multiples of the cover's modulus
        begin[i] = at + (-(at + anchor[i])) % COVER
        at = begin[i] + size[i] + 1
    data = np.zeros(at + LENGTH + 4 * COVER, dtype=np.uint8)
    for b, s in zip(blocks, begin, strict=True):
        data[s : s + len(b)] = np.frombuffer(b, dtype=np.uint8)
    words = sliding_window_view(data, 8)[: len(data) - 7].copy().view(">u8").reshape(-1).astype(np.uint64)
    # Ranks of the positions in the cover: by COVER bytes, then doubled until they say more than LENGTH bytes.
    sample = np.flatnonzero(np.isin(np.arange(at) % COVER, _COVER))
    rank = np.zeros(len(data) + 4 * LENGTH, dtype=np.int64)

    def named(keys: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        differs = np.zeros(len(order), dtype=bool)
        for k in keys:
            differs[1:] |= k[order][1:] != k[order][:-1]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.cumsum(differs) + 1
        return out

    rank[sample] = named([words[sample + 8 * j] for j in range(COVER // 8)])
    reach = COVER
    while reach < LENGTH:
        # A rank may not look past LENGTH bytes: equal strings would differ by what follows them.
        step = min(reach, (LENGTH - reach) // COVER * COVER)
        if step <= 0:
            break
        rank[sample] = named([rank[sample], rank[sample + step]])
        reach += step
    span = size - LENGTH + 1
    owner = np.repeat(np.arange(len(blocks)), span)
    pos = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(span) - span, span)
    residue = pos % COVER
    # The tie's rank reaches from the cover position; it stays within the string where shift + reach <= LENGTH.
    shift = _SHIFT[residue]
    keys = [words[pos + 8 * j] for j in range(COVER // 8)] + [residue]
    inner = np.where(shift + reach <= LENGTH, rank[pos + shift], 0)
    tail = [words[pos + j] for j in range(COVER, LENGTH - 7, 8)]
    order = np.lexsort([words[pos + LENGTH - 8], inner, *keys[::-1]])  # ranks can end a few bytes before the string does
    # Where the rank can't be used, ties are ordered by the remaining bytes.
    open_ties = inner[order] == 0
    if open_ties.any():
        sub = order[open_ties]
        order[open_ties] = sub[np.lexsort([t[sub] for t in tail[::-1]] + [k[sub] for k in keys[::-1]])]
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    for j in range(0, LENGTH, 8):
        left = np.flatnonzero(same)
        if not len(left):
            break
        same[left] = words[pos[a[left]] + j] == words[pos[b[left]] + j]
    repeated = np.zeros(len(pos), dtype=bool)
    repeated[a[same]] = True
    repeated[b[same]] = True
    return np.split(repeated, np.cumsum(span)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, past last) of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    flags = sorted_repeats([bytes(b) for b in pdf["block"]], pdf["anchor"].to_numpy())
    for u0, u1, first, own in zip(pdf["u0"], pdf["u1"], pdf["first"], flags, strict=True):
        rows += [(u0, u1, first + s, first + e - 1 + LENGTH) for s, e in _runs(own)]
    return pd.DataFrame(rows, columns=["u0", "u1", "s", "e"])


_CUT = "key long, lo short, hi short, h0 long, h1 int, u0 long, u1 long, first int, strings short, anchor short, block binary"
_NAMES = [c.split()[0] for c in _CUT.split(", ")]
_SPAN = "u0 long, u1 long, s int, e int"


def halves(block: bytes, first: int, strings: int, anchor: int, lo: int, hi: int) -> Iterator[tuple[int, int, bytes, int, int, int, bytes]]:
    """The two pieces of a block whose strings start lo to hi bytes before the anchor: lo, hi, the bytes that all their strings share, first, strings, anchor, block."""
    middle = (lo + hi) // 2
    for low, high in ((lo, middle), (middle + 1, hi)):
        a, b = max(anchor - high, 0), min(anchor - low, strings - 1)  # first and last string
        if low <= high and a <= b:
            yield low, high, block[anchor - low : anchor + LENGTH - high], first + a, b - a + 1, anchor - a, block[a : b + LENGTH]


def _divided(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces of the blocks of large buckets, one of each kind, and the spans of those that equal another."""

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            rows: list[tuple] = []
            for key, lo, hi, u0, u1, first, strings, anchor, block in zip(*(pdf[c] for c in ("key", "lo", "hi", "u0", "u1", "first", "strings", "anchor", "block")), strict=True):
                for low, high, shared, own_first, own_strings, own_anchor, piece in halves(bytes(block), int(first), int(strings), int(anchor), int(lo), int(hi)):
                    own = hashlib.blake2b(shared, digest_size=8, salt=bytes([low, high]), key=int(key).to_bytes(8, "little", signed=True)).digest()
                    (h,) = digests([piece], np.array([own_anchor]))
                    rows.append((int.from_bytes(own, "little", signed=True), low, high, int(h['h0']), int(h['h1']), u0, u1, own_first, own_strings, own_anchor, piece))
                if len(rows) >= 4000:
                    yield pd.DataFrame(rows, columns=_NAMES)
                    rows = []
            yield pd.DataFrame(rows, columns=_NAMES)

    pieces = written(hot.select(*_NAMES).mapInPandas(divide, _CUT), "pieces")
    counted = pieces.groupBy(F.col("key").alias("k"), F.col("h0").alias("g0"), F.col("h1").alias("g1")).agg(F.count("*").alias("c"))
    same = (F.col("key") == F.col("k")) & (F.col("h0") == F.col("g0")) & (F.col("h1") == F.col("g1"))
    spans = pieces.join(counted.where("c > 1"), same, "left_semi").select("u0", "u1", F.col("first").alias("s"), (F.col("first") + F.col("strings") - 1 + LENGTH).cast("int").alias("e"))
    kinds = counted.groupBy("k").agg(F.count("*").alias("d")).where("d > 1").select("k")
    one = F.min(F.struct("u0", "u1", "first", "lo", "hi", "strings", "anchor")).alias("one")
    chosen = pieces.join(kinds, F.col("key") == F.col("k"), "left_semi").groupBy("key", "h0", "h1").agg(one).select("key", "h0", "h1", "one.*")
    at = ["key", "h0", "h1", "u0", "u1", "first"]
    return pieces.join(chosen.select(*at).distinct(), at, "left_semi").dropDuplicates(at).select(*_NAMES), spans


def repeated_spans(rows: DataFrame) -> DataFrame:
    """u0, u1 and [s, e) byte spans that repeated strings cover in the texts of rows (u0, u1, text); spans can overlap."""
    with scratch():
        return written(_repeated_spans(rows), "spans", keep=True)


def _repeated_spans(rows: DataFrame) -> DataFrame:

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            u0, u1 = pdf["u0"].to_numpy(), pdf["u1"].to_numpy()
            for i, data, limits in _parts(raw):
                begins = np.concatenate([[0], limits[:-1]])
                for off, part in _long_parts(data):
                    text, a, first, last, fp = anchors(part, limits - off if off == 0 and len(part) == len(data) else np.array([len(part)]))
                    many = len(limits) > 1
                    base = begins[text] if many else np.full(len(text), -off)
                    whole = part.tobytes()
                    h = digests([whole[x : y + LENGTH] for x, y in zip(first.tolist(), last.tolist(), strict=True)], a - first)
                    own = i + text if many else np.full(len(text), i)
                    yield pd.DataFrame({"fp": fp.astype(np.uint64).view(np.int64), "h0": h["h0"], "h1": h["h1"], "u0": u0[own], "u1": u1[own], "first": (first - base).astype(np.int32), "strings": (last - first + 1).astype(np.int16), "anchor": (a - first).astype(np.int16)})

    blocks = written(rows.mapInPandas(find, "fp long, h0 long, h1 int, u0 long, u1 long, first int, strings short, anchor short"), "anchors")
    # Most anchors stand alone. Counts and copies are summed before they are shuffled, and Spark can split the large partitions of the joins.
    counted = blocks.groupBy(F.col("fp").alias("f")).agg(F.count("*").alias("n")).where("n > 1").select("f")
    shared = written(blocks.join(counted, F.col("fp") == F.col("f"), "left_semi"), "shared")
    discard(blocks)
    one = F.min(F.struct("u0", "u1", "first", "strings", "anchor")).alias("one")
    kinds = written(shared.groupBy("fp", "h0", "h1").agg(F.count("*").alias("c"), one).select("fp", "h0", "h1", "c", "one.*"), "kinds")
    copied = kinds.where("c > 1").select(F.col("fp").alias("f"), F.col("h0").alias("g0"), F.col("h1").alias("g1"))
    same = (F.col("fp") == F.col("f")) & (F.col("h0") == F.col("g0")) & (F.col("h1") == F.col("g1"))
    spans = shared.join(copied, same, "left_semi").select("u0", "u1", F.col("first").alias("s"), (F.col("first") + F.col("strings") - 1 + LENGTH).cast("int").alias("e"))

    # Of anchors with several kinds of blocks, one block of each kind is sorted.
    several = kinds.groupBy(F.col("fp").alias("f")).agg(F.count("*").alias("d")).where("d > 1").select("f")
    wanted = kinds.join(several, F.col("fp") == F.col("f"), "left_semi")
    by_text = wanted.groupBy(F.col("u0").alias("w0"), F.col("u1").alias("w1")).agg(F.collect_list(F.struct("fp", "h0", "h1", "first", "strings", "anchor")).alias("cuts"))
    texts = rows.join(by_text, (F.col("u0") == F.col("w0")) & (F.col("u1") == F.col("w1"))).select("u0", "u1", "text", "cuts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            out: list[tuple] = []
            for u0, u1, text, cuts in zip(pdf["u0"], pdf["u1"], pdf["text"], pdf["cuts"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for c in cuts:
                    out.append((c["fp"], 0, LENGTH - GRAM, c["h0"], c["h1"], u0, u1, c["first"], c["strings"], c["anchor"], raw[c["first"] : c["first"] + c["strings"] - 1 + LENGTH]))
                    if len(out) >= 2000:
                        yield pd.DataFrame(out, columns=_NAMES)
                        out = []
            yield pd.DataFrame(out, columns=_NAMES)

    cuts = written(texts.mapInPandas(cut, _CUT), "cuts")
    while True:
        sizes = written(cuts.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("d")), "sizes")
        hot = sizes.where(F.col("d") > MOST_BLOCKS)
        n_cold, n_hot = sizes.agg(F.sum(F.when(F.col("d") <= MOST_BLOCKS, F.col("d")).otherwise(0)), F.sum((F.col("d") > MOST_BLOCKS).cast("long"))).first()
        cold = cuts.join(hot, F.col("key") == F.col("k"), "left_anti") if n_hot else cuts
        if n_cold:
            buckets = max(1, n_cold // BUCKET_BLOCKS)
            spans = spans.unionAll(cold.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(_in_bucket, _SPAN))
        if not n_hot:
            return spans
        cuts, equal = _divided(cuts.join(hot, F.col("key") == F.col("k"), "left_semi"))
        cuts = written(cuts, "cuts")
        spans = spans.unionAll(equal)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row: bytes that any repeated string covers are removed.

    A null text is empty; null doc_ids are kept; texts of fewer than LENGTH bytes stay whole, and longer ones are read whole, whatever
    their length; repeated rows repeat each other, and all places of a tie are removed; other columns are left out and may have any name; an
    empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    # A row is named by its doc_id and a hash of its text; rows that agree in doc_id and text are one and have one result.
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).cast("long").alias("u0"), F.xxhash64("text", F.col("doc_id").isNull()).alias("u1"))
    spans = repeated_spans(rows.where(F.octet_length("text") >= LENGTH).select("u0", "u1", "text"))
    by_text = spans.groupBy(F.col("u0").alias("w0"), F.col("u1").alias("w1")).agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, removed, count = hashlib.sha256(), 0, 0, 0
                end = -1
                for s, e in sorted((x["s"], x["e"]) for x in spans) if spans is not None else ():
                    if s > end:
                        count += 1
                        kept.update(raw[at:s])
                        removed += e - s
                        at = end = e
                    elif e > end:
                        removed += e - end
                        at = end = e
                kept.update(raw[at:])
                out.append((len(raw), removed, count, kept.hexdigest()))
            out = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    joined = rows.join(by_text, (F.col("u0") == F.col("w0")) & (F.col("u1") == F.col("w1")), "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
