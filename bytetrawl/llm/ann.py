"""Approximate nearest neighbours by inner product, with randomly rotated one-bit codes in cells.

Equal vectors are one candidate with its smallest ids. Vectors are dealt to cells by centroids fitted on a bounded sample, and large
cells to blocks. A vector's residual from its centroid is rotated at random and kept as the signs of its coordinates, packed to
bits, with two correction scalars: its length, and the inner product of the rotated unit residual with its code. A query's inner
products in a cell are estimated from the bits; the error bound of the estimate chooses the vectors that can still be among the
nearest, and these are reranked by exact products in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filled, prepare, written

NEAREST, QUERY_EVERY = 20, 20
#: Centroids are fitted on at most so many vectors; a cell has CELL_ROWS vectors on average, a block at most about BLOCK_ROWS.
SAMPLE_ROWS, CELL_ROWS, MOST_CELLS, BLOCK_ROWS = 20_000, 400, 4096, 2000
#: A query visits so many cells that they hold this share of the nearest neighbours within the sample, but LEAST_VISITS at least.
IN_REACH, LEAST_VISITS, TRIAL_QUERIES = 0.97, 8, 400
#: Cells that a query visits before the others.
FIRST_CELLS = 4
#: Standard deviations in the error bound.
BOUND = 3.0


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, d)


def centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a fixed start."""
    c = sample[np.random.default_rng(3).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = (sample @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        for j in range(len(c)):
            own = sample[near == j]
            if len(own):
                c[j] = own.mean(axis=0)
    return c


def codes(x: np.ndarray, c: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of rotated residuals from c, the residuals' lengths, and their inner products with their codes."""
    d = x.shape[1]
    r = x - c
    length = np.sqrt((r * r).sum(axis=1))
    y = (r / np.maximum(length, 1e-300)[:, None]) @ turn
    return np.packbits(y > 0, axis=1), length, np.maximum(np.abs(y).sum(axis=1) / np.sqrt(d), 1e-6)


def estimates(bits: np.ndarray, length: np.ndarray, inner: np.ndarray, c: np.ndarray, q: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded vectors, and their error bounds."""
    d = q.shape[1]
    signs = (np.unpackbits(bits, axis=1)[:, :d].astype(np.float32) * 2 - 1) / np.sqrt(d)
    turned = q @ turn
    est = (turned.astype(np.float32) @ signs.T) / inner * length + (q @ c)[:, None]
    spread = length * np.sqrt(np.maximum(1 - inner**2, 0)) / inner / np.sqrt(max(d - 1, 1))
    return est, BOUND * np.sqrt((q * q).sum(axis=1))[:, None] * spread + 1e-5 * (1 + np.abs(est))


def visits_needed(sample: np.ndarray, c: np.ndarray, k: int) -> int:
    """How many cells, in the order of their centroids' inner products, hold IN_REACH of the nearest neighbours of trial queries."""
    q = sample[np.random.default_rng(4).permutation(len(sample))[:TRIAL_QUERIES]]
    cell = (sample @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    m = min(k + 1, len(sample))
    near = np.argpartition(-(q @ sample.T), m - 1, axis=1)[:, :m]
    return min(len(c), max(LEAST_VISITS, int(np.quantile(place[np.arange(len(q))[:, None], cell[near]], IN_REACH)) + 1))


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (float64 bytes) and d (dimension) of vectors without nulls, infinities and NaNs that aren't zero."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            rows = []
            for i, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                if e is None or i is None or i != i or not len(e) or any(x is None for x in e):
                    continue
                v = np.asarray(e, dtype=np.float64) + 0.0
                if np.isfinite(v).all() and v.any():
                    rows.append((int(i), v.tobytes(), len(v)))
            yield pd.DataFrame(rows, columns=["vec_id", "v", "d"])

    return written(vectors.select("vec_id", "embedding").mapInPandas(clean, "vec_id long, v binary, d int"), "vectors")


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST) -> DataFrame:
    """The k nearest vectors of each row whose vec_id is divisible by every: query_id, rank, vec_id, score.

    Null vec_ids take no part. Vectors are compared with those of their own dimension only. Repeated rows are one vector. Ties go to the
    smaller vec_id. Other columns are left out and may have any name; without usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = _usable(vectors)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.select("d").distinct().orderBy("d").collect():  # a table has one dimension, or a few
        out = out.unionByName(_nearest_of(rows.where(F.col("d") == r.d), int(r.d), every, k))
    return out


def _nearest_of(rows: DataFrame, d: int, every: int, k: int) -> DataFrame:
    """The same for vectors of one dimension."""
    spark = rows.sparkSession
    rows = rows.withColumn("key", F.md5("v"))
    first = W.partitionBy("key").orderBy("vec_id")
    some = rows.select("key", "vec_id", "v").groupBy("key", "vec_id").agg(F.first("v").alias("v")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = written(some.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")), "distinct")
    n = distinct.count()
    cells = int(min(MOST_CELLS, max(1, n // CELL_ROWS)))
    sample = matrix(distinct.orderBy("key").limit(SAMPLE_ROWS).select("v").toPandas()["v"], d)
    c, turn = centroids(sample, min(cells, len(sample))), rotation(d)
    cells = len(c)
    visits = visits_needed(sample, c, k)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            x = matrix(pdf["v"], d)
            cell = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            bits, length, inner = codes(x, c[cell], turn)
            yield pdf.assign(cell=cell.astype(np.int32), bits=[b.tobytes() for b in bits], length=length, inner=inner)

    index = written(distinct.mapInPandas(assign, "key string, ids array<long>, v binary, cell int, bits binary, length double, inner double"), "index")
    sizes = {r.cell: -(-r["count"] // BLOCK_ROWS) for r in index.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
    blocks = spark.createDataFrame([(int(a), int(b)) for a, b in sizes.items()], "cell int, blocks int")
    index = index.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
    queries = rows.where(F.col("vec_id") % every == 0).select("key", "vec_id", "v")
    asked = queries.groupBy("key").agg(F.first("v").alias("v"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            x = matrix(pdf["v"], d)
            best = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :visits]
            out = pd.DataFrame({"qkey": np.repeat(pdf["key"].to_numpy(), visits), "q": np.repeat(pdf["v"].to_numpy(), visits), "cell": best.reshape(-1).astype(np.int32), "place": np.tile(np.arange(visits, dtype=np.int32), len(x))})
            for at in range(0, len(out), 2000):
                yield out[at : at + 2000]

    routed = asked.mapInPandas(route, "qkey string, q binary, cell int, place int").join(F.broadcast(blocks), "cell")
    routed = routed.select("qkey", "q", "cell", "place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def search(index: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        columns = ["qkey", "score", "ids"]
        if not len(index) or not len(asks):
            return pd.DataFrame([], columns=columns)
        x, own = matrix(index["v"], d), c[int(index["cell"].iloc[0])]
        bits = np.frombuffer(b"".join(index["bits"]), dtype=np.uint8).reshape(len(index), -1)
        length, inner, ids = index["length"].to_numpy(), index["inner"].to_numpy(), index["ids"].to_numpy()
        least = np.array([i[0] for i in ids])
        out: list[tuple] = []
        for at in range(0, len(asks), 500):
            part = asks.iloc[at : at + 500]
            q = matrix(part["q"], d)
            est, err = estimates(bits, length, inner, own, q, turn)
            low, high = est - err, est + err
            m = min(k + 1, len(x))
            known = part["known"].to_numpy()
            bar = np.maximum(np.partition(low, len(x) - m, axis=1)[:, len(x) - m], known)
            for i, key in enumerate(part["qkey"]):
                chosen = np.flatnonzero(high[i] >= bar[i])
                exact = (x[chosen] * q[i]).sum(axis=1)
                out += [(key, float(exact[j]), ids[chosen[j]]) for j in np.lexsort((least[chosen], -exact))[: k + 1] if exact[j] >= known[i]]
        return pd.DataFrame(out, columns=columns)

    def searched(asks: DataFrame) -> DataFrame:
        return index.groupBy("cell", "block").cogroup(asks.groupBy("cell", "block")).applyInPandas(search, "qkey string, score double, ids array<long>")

    def exploded(found: DataFrame) -> DataFrame:
        return found.select("qkey", "score", F.explode("ids").alias("vec_id"))

    # The cells nearest to a query come first; their k + 1 best say what the other cells must reach.
    near = written(searched(routed.where(F.col("place") < FIRST_CELLS).withColumn("known", F.lit(float("-inf")))), "near")
    ranked = exploded(near).withColumn("n", F.row_number().over(W.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")))
    bars = ranked.where(F.col("n") == k + 1).select(F.col("qkey").alias("bar_key"), F.col("score").alias("known"))
    rest = routed.where(F.col("place") >= FIRST_CELLS).join(bars, F.col("qkey") == F.col("bar_key"), "left").drop("bar_key").fillna(float("-inf"), ["known"])
    each = exploded(near.unionByName(searched(rest)))
    best = W.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    ask = queries.select("key", F.col("vec_id").alias("query_id")).distinct()
    out = ask.join(top, F.col("key") == F.col("qkey")).select("query_id", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    return out.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
