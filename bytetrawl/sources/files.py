"""Byte streams from files, lists of files, memory and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STDIN = "(standard input)"


#: Bytes of a file in a chunk.
CHUNK_BYTES = 8 << 20


def _listed(spark: SparkSession, paths: str | list[str], recursive: bool) -> DataFrame:
    """Files as Spark lists them. Without recursive, folders among several paths, and folders in folders, are left out."""
    reader = spark.read.format("binaryFile")
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(paths)


def read_files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """path, offset and content of each file; folders' files too, and those of their folders if recursive. Spark leaves empty files out, which have no hits. Files of 2 GiB and more need read_chunks."""
    return _listed(spark, paths, recursive).select("path", F.lit(0).cast("long").alias("offset"), "content")


def read_chunks(spark: SparkSession, paths: str | list[str], recursive: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path, chunk (its number), offset and content of each piece of files of any length, for streaming.search.search_chunks.

    Files are listed by Spark without their contents, and pieces are read where they are needed, through pyarrow's file systems.
    """
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / chunk_bytes) - 1, F.lit(0).cast("long"))))
    ranges = _listed(spark, paths, recursive).select("path", "length").select("path", "length", pieces.alias("chunk"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, length, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                local = re.sub("^file:/+", "/", path)
                system, name = (fs.LocalFileSystem(), local) if local != path else fs.FileSystem.from_uri(quote(path, safe="/:@"))
                at = chunk * chunk_bytes
                with system.open_input_file(name) as f:
                    content = f.read_at(min(chunk_bytes, max(length - at, 0)), at)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([chunk], pa.int64()), pa.array([at], pa.int64()), pa.array([content], pa.binary())], names=["path", "chunk", "offset", "content"])

    return ranges.repartition("path", "chunk").mapInArrow(read, "path string, chunk long, offset long, content binary")


def list_names(spark: SparkSession, lists: str | list[str]) -> list[str]:
    """The paths that list files name, a path on each line, in order and with repeats. A list must fit on the driver, as every path is listed there anyway."""
    return [n for one in ([lists] if isinstance(lists, str) else lists) for r in spark.read.option("wholetext", "true").text(one).collect() for n in (x.strip() for x in r.value.splitlines()) if n]


def read_lists(spark: SparkSession, lists: str | list[str], recursive: bool = False) -> DataFrame:
    """The files that list files name, with their place in the lists as the column turn; a file that is named twice is read twice."""
    out: DataFrame | None = None
    seen: dict[str, int] = {}
    rounds: dict[int, list[str]] = {}
    for n in list_names(spark, lists):
        seen[n] = seen.get(n, 0) + 1
        rounds.setdefault(seen[n], []).append(n)
    for turn, names in rounds.items():
        part = read_files(spark, names, recursive).withColumn("turn", F.lit(turn))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the lists name no files")
    return out


def from_bytes(spark: SparkSession, content: bytes, name: str = STDIN) -> DataFrame:
    """A stream in memory."""
    return spark.createDataFrame([(name, 0, bytearray(content))], "path string, offset long, content binary")


def from_chunks(df: DataFrame, stream: str, order: str, content: str) -> DataFrame:
    """One value for each stream from its chunks in order: the stream's column, offset and content. For streams that fit in a value; others are searched by search_chunks."""
    chunks = F.array_sort(F.collect_list(F.struct(order, content)))
    if dict(df.dtypes)[content] == "string":
        joined = F.encode(F.array_join(F.transform(chunks, lambda c: c[content]), ""), "UTF-8")
    else:
        joined = F.unhex(F.array_join(F.transform(chunks, lambda c: F.hex(c[content])), ""))
    return df.groupBy(stream).agg(joined.alias("content")).select(stream, F.lit(0).cast("long").alias("offset"), "content")


def pattern_text(spark: SparkSession, paths: Iterable[str]) -> list[tuple[str, str]]:
    """(path, text) of pattern files."""
    return [(p, "\n".join(r.value for r in spark.read.option("wholetext", "true").text(p).collect())) for p in paths]
