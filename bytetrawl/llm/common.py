"""What the operators of this package share: tables, written intermediate results and hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []

#: Rows in an Arrow batch. Texts can be long, so a batch of the default 10,000 rows could take much memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"own_{i}" for i in range(n + len(taken))) if x not in taken][:n]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this process, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(f"file://{tempfile.mkdtemp(prefix='bytetrawl-')}")
    return _OWN_FOLDER[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/bytetrawl/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[tuple[SparkSession, str]]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df as a table in the shared folder: computed once, with short lineage, and safe against lost executors.

    The job runs when this is called, while the plan that reads the table is still being made. Within scratch() the table is deleted at the
    end, unless it is to be kept for what comes after it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    scopes = _SCRATCH[:-1] if keep else _SCRATCH
    if scopes:
        scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path  # type: ignore[attr-defined]
    return out


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written in here are gone afterwards, but for those that are kept."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for spark, path in _SCRATCH.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Delete a table that written() made and that no later step reads."""
    path = getattr(table, "_written_to", None)
    if path is not None:
        _delete(table.sparkSession, path)


#: Bytes up to which a table that is joined to a larger one is broadcast.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, each: Column | int) -> DataFrame:
    """df to be broadcast, if its rows take at most BROADCAST_BYTES, 32 bytes and each for a row; otherwise df, for a join by shuffling."""
    size = df.agg(F.coalesce(F.sum((F.lit(each) if isinstance(each, int) else each) + 32), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches that have rows; lists without rows would make columns of a wrong type."""
    return (pdf for pdf in batches if len(pdf))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end]: polynomial sums over mixed bytes, shifted to a common origin and mixed."""
    n = len(data)
    if not n or not len(start):
        return np.zeros(len(start), dtype=np.uint64)
    byte = mix64(np.arange(1, 257, dtype=np.uint64))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(byte[data] * powers(n), out=prefix[1:])
    sums = (prefix[end] - prefix[start]) * powers(n, _INVERSE)[np.minimum(start, n - 1)]
    return mix64(sums + (end - start).astype(np.uint64) * np.uint64(_ODD))
