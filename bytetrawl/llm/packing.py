"""Packing of tokenized documents into sequences by non-negative least squares.

Whole windows are cut off long documents. The remainders' lengths are put in bins; all combinations of up to three bins that fill
a window are enumerated, and how often each is used is solved by non-negative least squares against the histogram and rounded
down. Remainders that no combination takes are packed greedily: laid end to end on a tape, they first fill the gaps that the
combinations leave, and then whole windows; what is left at the end of the tape is cut at powers of two. So nothing is padded.
Positions on the tape are prefix sums over chunks of rows, so no task sees more than a chunk, a bin's chunks or a stretch of tape.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filled, prepare, written

WINDOW, BINS, PARTS = 4096, 64, 3
STEP = WINDOW // BINS
#: Appended to each document.
END_ID = 2
#: Rows in a chunk, and tokens in a stretch of tape, roughly.
CHUNK_ROWS, STRETCH = 20_000, 1 << 20

# -- tokens -------------------------------------------------------------------------------------------------------------

_low = [chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L"]
_num = [chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N"]
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{''.join(_low)}]+|[{''.join(_num)}]|[^\\t\\n\\r \\xa0{''.join(map(re.escape, _low + _num))}]+")
#: Texts with anything else are left to the tokenizer: classes and normal forms could differ there, and special tokens are its own.
_ODD = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa0-\\xac\\xae-\\u024f]|<\\|")


class Words:
    """Ids of texts by a tokenizers file that splits texts into words; the ids of words are kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                self.known.update((w, x.astype("<u2").tobytes()) for w, x in zip(part, np.split(ids, stops[:-1]), strict=True))
            else:
                for w in part:
                    self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and END_ID, as unsigned little-endian 16-bit numbers."""
        split = [None if _ODD.search(t) else _WORDS.findall(t.lower()) for t in texts]
        if len(self.known) > 800_000:
            self.known.clear()
        new = set()
        for s in split:
            if s:
                new.update(s)
        self._learn([w for w in new if w not in self.known])
        end = END_ID.to_bytes(2, "little")
        known = self.known
        return [
            (np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() if s is None else b"".join([known[w] for w in s])) + end
            for t, s in zip(texts, split, strict=True)
        ]


_OPEN: dict[str, Words] = {}


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """uid, doc_id, n and ids of each row; a null text is empty. Written, so that uid holds."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _OPEN.setdefault(path, Words(path)) if path not in _OPEN else _OPEN[path]
        for pdf in filled(batches):
            ids = words.encode([t or "" for t in pdf["text"]])
            yield pd.DataFrame({"uid": pdf["uid"], "doc_id": pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "n": [len(i) // 2 for i in ids], "ids": ids})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return written(rows.mapInPandas(encode, "uid long, doc_id long, n long, ids binary"), "ids")


# -- the plan -----------------------------------------------------------------------------------------------------------


def mixes() -> list[tuple[int, ...]]:
    """All combinations of up to PARTS bins that fill a window."""
    return [c for k in range(1, PARTS + 1) for c in combinations_with_replacement(range(1, BINS + 1), k) if sum(c) == BINS]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    on = np.zeros(a.shape[1], dtype=bool)
    tol = 1e-9 * (1 + np.abs(b).max())
    for _ in range(6 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[on] = -np.inf
        if slope.max() <= tol:
            break
        on[slope.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            low = on & (s <= tol)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            on &= x > tol
            x[~on] = 0
        x = s
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(bins, repeats) for a histogram of bins 1 to BINS, such that what is left over has at least as many tokens as all gaps."""
    every = mixes()
    a = np.zeros((BINS, len(every)))
    for j, c in enumerate(every):
        for b in c:
            a[b - 1, j] += 1
    x = nnls(a, histogram.astype(float))
    left = histogram.astype(int).copy()
    used = []
    for j in np.argsort(-x, kind="stable"):
        n = int(x[j] + 1e-6)
        for b in set(every[j]):
            n = min(n, left[b - 1] // every[j].count(b))
        if n > 0:
            used.append([every[j], n])
            for b in every[j]:
                left[b - 1] -= n
    floor = STEP * np.arange(BINS) + 1  # the shortest length in a bin

    def short() -> int:
        return sum(n * len(c) * (STEP - 1) for c, n in used) - int(left @ floor)

    while used and (lack := short()) > 0:  # give sequences back, those of the most parts first
        one = max(used, key=lambda u: len(u[0]))
        gain = len(one[0]) * (STEP - 1) + sum(int(floor[b - 1]) for b in one[0])
        n = min(one[1], -(-lack // gain))
        one[1] -= n
        for b in one[0]:
            left[b - 1] += n
        used = [u for u in used if u[1]]
    return [(c, n) for c, n in used]


def _before(df: DataFrame, value: str, order: str, chunk: str, name: str) -> DataFrame:
    """df with the sum of value over all rows before, by chunk and then order; a chunk's rows and the chunks' sums are each added up in order."""
    sums = df.groupBy(chunk).agg(F.sum(value).alias("t"))
    base = sums.select(F.col(chunk).alias("c"), (F.sum("t").over(W.orderBy(chunk).rowsBetween(W.unboundedPreceding, 0)) - F.col("t")).alias("base"))
    inside = F.sum(value).over(W.partitionBy(chunk).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    return df.withColumn("inside", inside).join(base, F.col(chunk) == F.col("c")).withColumn(name, F.col("base") + F.col("inside")).drop("c", "base", "inside")


def _overlay(rest: DataFrame, gaps: DataFrame, end: int) -> DataFrame:
    """Pieces of rest (uid, full, at, r) in gaps (seq, gap, at), both lying on the tape up to end."""

    def cut(df: DataFrame, length: str, own: Column) -> DataFrame:
        to = F.least(F.col("at") + F.col(length), F.lit(end))
        parts = F.explode(F.sequence(F.floor(F.col("at") / STRETCH), F.floor((to - 1) / STRETCH))).alias("stretch")
        d = df.where((F.col("at") < end) & (F.col(length) > 0)).select(own.alias("own"), "at", parts)
        return d.select("stretch", F.greatest(F.col("at"), F.col("stretch") * STRETCH).alias("pos"), "own")

    docs = cut(rest, "r", F.struct("uid", "full", "at")).select("stretch", "pos", F.col("own").alias("doc"), F.lit(None).cast("struct<seq:bigint,gap:bigint,at:bigint>").alias("gap"))
    holes = cut(gaps, "gap", F.struct("seq", "gap", "at")).select("stretch", "pos", F.lit(None).cast("struct<uid:bigint,full:bigint,at:bigint>").alias("doc"), F.col("own").alias("gap"))
    w = W.partitionBy("stretch").orderBy("pos")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    e = docs.unionByName(holes).select(
        "pos",
        F.last("doc", ignorenulls=True).over(so_far).alias("doc"),
        F.last("gap", ignorenulls=True).over(so_far).alias("gap"),
        F.coalesce(F.lead("pos").over(w), F.least((F.col("stretch") + 1) * STRETCH, F.lit(end))).alias("next"),
    )
    e = e.where("next > pos and doc is not null and gap is not null")
    return e.select(
        F.col("doc.uid").alias("uid"),
        (F.col("doc.full") * WINDOW + F.col("pos") - F.col("doc.at")).alias("start"),
        (F.col("next") - F.col("pos")).alias("length"),
        F.col("gap.seq").alias("seq"),
        (WINDOW - F.col("gap.gap") + F.col("pos") - F.col("gap.at")).alias("offset"),
    )


def pieces(lengths: DataFrame) -> DataFrame:
    """uid, start, length, seq and offset of each piece of the rows of lengths (uid, n)."""
    spark = lengths.sparkSession
    rows = lengths.count()
    chunks = max(1, -(-rows // CHUNK_ROWS))
    base = lengths.select("uid", F.expr(f"n div {WINDOW}").alias("full"), (F.col("n") % WINDOW).alias("r"), F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk"))
    base = base.withColumn("bin", F.ceil(F.col("r") / STEP).cast("int"))
    # Ranks of remainders in their bins: counts of earlier chunks, and row numbers in the chunk.
    counts = written(base.groupBy("chunk", "bin").agg(F.count("*").alias("k")), "counts")
    histogram = np.zeros(BINS, dtype=np.int64)
    for row in counts.groupBy("bin").agg(F.sum("k").alias("k")).where("bin > 0").collect():  # at most BINS rows
        histogram[row.bin - 1] = row.k
    used = plan(histogram)
    slots, seq, taken = [], 0, np.zeros(BINS, dtype=np.int64)
    for c, n in used:
        for k, b in enumerate(c):
            slots.append((b, int(taken[b - 1]), int(n), int(seq), k))
            taken[b - 1] += n
        seq += int(n)
    packed = seq
    before = counts.select(F.col("chunk").alias("c"), F.col("bin").alias("b"), (F.sum("k").over(W.partitionBy("bin").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")).alias("before"))
    ranked = base.withColumn("rank", F.row_number().over(W.partitionBy("chunk", "bin").orderBy("uid")) - 1)
    ranked = ranked.join(before, (F.col("chunk") == F.col("c")) & (F.col("bin") == F.col("b"))).withColumn("rank", F.col("rank") + F.col("before")).drop("c", "b", "before")
    table = spark.createDataFrame(slots or [(-1, 0, 0, 0, 0)], "b int, first long, many long, seq0 long, k int")
    at_slot = (F.col("bin") == F.col("b")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("many"))
    placed = written(ranked.join(F.broadcast(table), at_slot, "left").select("uid", "chunk", "full", "r", "k", (F.col("seq0") + F.col("rank") - F.col("first")).alias("seq")), "placed")

    w = W.partitionBy("seq").orderBy("k")
    in_mix = placed.where("seq is not null")
    mixed = in_mix.select("uid", (F.col("full") * WINDOW).alias("start"), F.col("r").alias("length"), "seq", (F.sum("r").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("r")).alias("offset"))
    gaps = in_mix.groupBy("seq").agg((WINDOW - F.sum("r")).alias("gap")).withColumn("chunk", F.expr(f"seq div {CHUNK_ROWS}"))
    gaps = written(_before(gaps, "gap", "seq", "chunk", "at").select("seq", "gap", "at"), "gaps")
    rest = written(_before(placed.where("seq is null and r > 0"), "r", "uid", "chunk", "at").select("uid", "full", "r", "at"), "rest")
    total_gap = gaps.agg(F.sum("gap")).first()[0] or 0
    total_rest = rest.agg(F.sum("r")).first()[0] or 0
    fulls = _before(placed.where("full > 0"), "full", "uid", "chunk", "at")
    n_full = placed.agg(F.sum("full")).first()[0] or 0
    whole = fulls.select("uid", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i"))
    whole = whole.select("uid", (F.col("i") * WINDOW).alias("start"), F.lit(WINDOW).cast("long").alias("length"), (packed + F.col("at") + F.col("i")).alias("seq"), F.lit(0).cast("long").alias("offset"))

    # Behind the gaps: windows, then powers of two.
    blocks, tail = divmod(max(0, total_rest - total_gap), WINDOW)
    starts = [blocks * WINDOW]
    for bit in range(WINDOW.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            starts.append(starts[-1] + (1 << bit))
    ends = F.array(*[F.lit(s).cast("long") for s in starts])  # the ends of the windows, and of each power of two

    def index(t: Column) -> Column:
        return F.when(t < blocks * WINDOW, F.floor(t / WINDOW)).otherwise(blocks + F.size(F.filter(ends, lambda s: s <= t)) - 1).cast("long")

    def begin(i: Column) -> Column:
        return F.when(i <= blocks, i * WINDOW).otherwise(F.element_at(ends, F.least(i - blocks + 1, F.lit(len(starts))).cast("int")))

    t = rest.select("uid", "full", "at", F.greatest(F.col("at"), F.lit(total_gap)).alias("a"), (F.col("at") + F.col("r")).alias("b")).where("b > a")
    t = t.select("uid", "full", "at", "a", "b", F.explode(F.sequence(index(F.col("a") - total_gap), index(F.col("b") - 1 - total_gap))).alias("i"))
    t = t.withColumn("from", begin(F.col("i")) + total_gap).withColumn("p", F.greatest("a", "from")).withColumn("q", F.least("b", begin(F.col("i") + 1) + total_gap))
    last = t.select("uid", (F.col("full") * WINDOW + F.col("p") - F.col("at")).alias("start"), (F.col("q") - F.col("p")).alias("length"), (packed + n_full + F.col("i")).alias("seq"), (F.col("p") - F.col("from")).alias("offset"))
    return mixed.unionByName(whole).unionByName(_overlay(rest, gaps, total_gap)).unionByName(last)


def packed_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece of each row of docs.

    Null and empty texts have the end id alone; null doc_ids are kept; repeated rows are packed each; an empty table gives an
    empty table; other columns are left out. Texts are tokenized whole and once.
    """
    prepare(docs.sparkSession)
    tokens = tokenized(docs, path)
    by_row = pieces(tokens.select("uid", "n")).groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct("start", "length", "seq", "offset")).alias("cuts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            rows = []
            for doc_id, n, ids, cuts in zip(pdf["doc_id"], pdf["n"], pdf["ids"], pdf["cuts"], strict=True):
                own = np.frombuffer(ids, dtype="<u2").astype("<u4")
                doc = None if doc_id is None or doc_id != doc_id else int(doc_id)
                rows += [(doc, c["start"], c["length"], zlib.crc32(own[c["start"] : c["start"] + c["length"]].tobytes()), n, c["seq"], c["offset"]) for c in cuts]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            yield out

    joined = tokens.join(by_row, F.col("uid") == F.col("u")).select("doc_id", "n", "ids", "cuts")
    return joined.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
