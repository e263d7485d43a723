"""Where hits go: tab-separated lines, histogram files, callbacks, or nowhere."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from .summary import by_count, escaped


def hit_lines(hits: DataFrame, path: str | None = None) -> DataFrame:
    """A line for each hit: [path] start end user_index pattern enc_chain, and the context if there is one."""
    cells = [F.col(path)] if path else []
    cells += [F.col(c).cast("string") for c in ("start", "end", "user_index", "pattern", "enc_chain")]
    if "context" in hits.columns:
        cells += [F.col("data_offset").cast("string"), escaped("context", ("\t", "\n", "\r"))]
    return hits.select(F.concat_ws("\t", *cells).alias("value"))


def histogram_lines(rows: DataFrame) -> DataFrame:
    """A line for each row of a histogram, in its order: count, text, user index and pattern, with control characters written out."""
    return by_count(rows).select(F.concat_ws("\t", F.col("count").cast("string"), escaped("hit_text"), F.col("user_index").cast("string"), escaped("pattern")).alias("value"))


def write_lines(lines: DataFrame, target: str) -> None:
    """Write lines as text files; '-' prints them."""
    if target == "-":
        for row in lines.toLocalIterator():
            print(row.value)
    else:
        lines.write.text(target)


def separated(lines: Iterable[str], mark: str = "--") -> Iterator[str]:
    """Lines with a separator between every two."""
    for i, line in enumerate(lines):
        if i:
            yield mark
        yield line


def show_path(positional: bool, with_name: bool = False, without_name: bool = False) -> bool:
    """Whether hit lines begin with the path."""
    if with_name and without_name:
        raise ValueError("paths can't be both shown and hidden")
    return with_name or positional and not without_name


def for_each(hits: DataFrame, callback: Callable[[Row], None]) -> None:
    """Call a function for each hit, on the executors."""
    hits.foreachPartition(lambda rows: [callback(r) for r in rows] and None)


def count_only(hits: DataFrame) -> int:
    """Compute every hit, keep none, and return their number."""
    seen = Observation()
    hits.observe(seen, F.count(F.lit(1)).alias("hits")).write.format("noop").mode("overwrite").save()
    return seen.get["hits"]


def accumulated(hits: DataFrame) -> tuple[list[dict], Counter]:
    """All hits as dictionaries, and their number by pattern; for results that fit on the driver."""
    rows = [r.asDict() for r in hits.collect()]
    return rows, Counter(r["pattern"] for r in rows)
