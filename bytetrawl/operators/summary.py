"""Sums over hits."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Control characters and how they are written; fixed values.
ESCAPES = {"\a": "\\a", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\v": "\\v", "\f": "\\f", "\r": "\\r"}


def histogram(hits: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """How often each hit text was found by each pattern: count, hit_text, user_index, pattern. Encodings aren't told apart."""
    return hits.groupBy("hit_text", "pattern", "user_index", *more).agg(F.count("*").alias("count"))


def by_count(rows: DataFrame) -> DataFrame:
    """A histogram with the most frequent first, then by user index, text and pattern."""
    return rows.orderBy(F.desc("count"), "user_index", "hit_text", "pattern")


def hits_per_pattern(hits: DataFrame) -> DataFrame:
    """Hits of each pattern's text, whatever its label."""
    return hits.groupBy("pattern").agg(F.count("*").alias("hits"))


def total(hits: DataFrame) -> DataFrame:
    """The number of hits."""
    return hits.agg(F.count("*").alias("hits"))


def bytes_searched(df: DataFrame, column: str) -> DataFrame:
    """Rows and bytes of a column."""
    return df.agg(F.count(column).alias("rows"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long").alias("bytes"))


@dataclass(frozen=True)
class Measured:
    """What a search did: rows and bytes searched, hits, seconds."""

    rows: int
    bytes: int
    hits: int
    seconds: float

    @property
    def rate(self) -> float:
        """Megabytes (2**20 bytes) a second."""
        return self.bytes / (1 << 20) / self.seconds if self.seconds else 0.0

    def __str__(self) -> str:
        return f"{self.bytes} bytes\n{self.seconds:.3f} s\n{self.rate:.3f} MB/s avg\n{self.hits} hits"


def measured(df: DataFrame, column: str, search: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None] | None = None) -> Measured:
    """Run a search (a function from df to its hits) and say how much it read, found and took, in one pass. write: where the hits go; by default nowhere."""
    read, found = Observation(), Observation()
    began = time.perf_counter()
    hits = search(df.observe(read, F.count(column).alias("rows"), F.sum(F.octet_length(column)).alias("bytes"))).observe(found, F.count(F.lit(1)).alias("hits"))
    (write or (lambda h: h.write.format("noop").mode("overwrite").save()))(hits)
    seconds = time.perf_counter() - began
    return Measured(read.get["rows"], read.get["bytes"] or 0, found.get["hits"], seconds)


def statistics(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Least, greatest, mean, harmonic mean, lower median and population variance of measurements."""
    c = F.col(column)
    return df.groupBy(*by).agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), (F.count(c) / F.sum(1 / c)).alias("harmonic"), F.expr(f"percentile_disc(0.5) within group (order by `{column}`)").alias("median"), F.var_pop(c).alias("variance")
    )


def escaped(column: str | Column, controls: Sequence[str] = tuple(ESCAPES)) -> Column:
    """Text with control characters written out; backslashes stay."""
    out = F.col(column) if isinstance(column, str) else column
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(ESCAPES[c]))
    return out
