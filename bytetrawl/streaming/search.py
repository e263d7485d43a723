"""Search of streams that arrive in chunks, with exact offsets across chunk borders.

A stream's state is the automata's threads, the starts of what they may find, and hits that wait for these; no bytes are kept. A stream ends when a
chunk says so, or with close().
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bytetrawl.operators.search import BATCH_ROWS, finder
from bytetrawl.plans import automaton, emit
from bytetrawl.plans.patterns import PatternSet

#: Bytes of a stream that a batch search gathers before it goes on with the automaton alone.
GATHERED = 1 << 20
_COLUMNS = ["start", "end", "keyword_index", "user_index", "pattern", "enc_chain"]
_TYPES = "start long, end long, keyword_index int, user_index long, pattern string, enc_chain string"


class StreamSearch:
    """One stream's search: feed it chunks in order, then close it."""

    def __init__(self, patterns: PatternSet, state: str | None = None, machines: list[automaton.Machine] | None = None) -> None:
        self.labels = patterns.check().labels
        self.machines = machines or [automaton.Machine(emit.program(x.tree, x.enc_chain)) for x in self.labels]
        self.states = [automaton.State.of_json(x) for x in json.loads(state)] if state else [automaton.State() for _ in self.labels]

    def feed(self, chunk: bytes) -> list[tuple[int, int, int]]:
        """Hits (start, end, keyword_index) that are settled with this chunk."""
        return [(s, e, i) for i, (m, state) in enumerate(zip(self.machines, self.states, strict=True)) for s, e in m.feed(state, chunk)]

    def close(self) -> list[tuple[int, int, int]]:
        """The hits that were waiting for more bytes."""
        return [(s, e, i) for i, (m, state) in enumerate(zip(self.machines, self.states, strict=True)) for s, e in m.close(state)]

    @property
    def live(self) -> int:
        """The least offset at which a hit could still start."""
        return min(s.live for s in self.states)

    def state(self) -> str:
        """What to keep between chunks."""
        return json.dumps([s.as_json() for s in self.states])


def _bytes(chunk: object) -> bytes:
    return b"" if chunk is None else chunk.encode("utf-8") if isinstance(chunk, str) else bytes(chunk)  # type: ignore[call-overload]


def search_stream(chunks: DataFrame, patterns: PatternSet, stream: str, order: str, content: str, final: str) -> DataFrame:
    """Hits in streams of chunks: a streaming DataFrame with the stream's column, the chunk's order, its bytes, and whether it is the last one.

    The chunks of a stream must arrive in order over micro-batches; within one they are put in order. A null chunk is empty.
    """
    kind = dict(chunks.dtypes)[stream]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = StreamSearch(patterns, state.get[0] if state.exists else None)
        rows = pd.concat(list(parts)).sort_values(order)
        hits, closed = [], False
        for raw, end in zip(rows[content], rows[final], strict=True):
            hits += s.feed(_bytes(raw))
            closed |= bool(end)
        if closed:
            hits += s.close()
            state.remove()
        else:
            state.update((s.state(),))
        yield pd.DataFrame([(key[0], a, b, i, s.labels[i].user_index, s.labels[i].pattern, s.labels[i].enc_chain) for a, b, i in hits], columns=[stream, *_COLUMNS])

    return chunks.groupBy(stream).applyInPandasWithState(step, f"`{stream}` {kind}, {_TYPES}", "threads string", "append", GroupStateTimeout.NoTimeout)


def search_chunks(chunks: DataFrame, patterns: PatternSet, stream: str, order: str, content: str) -> DataFrame:
    """The same over a table of chunks, streams ending with their last chunk.

    Chunks are dealt by stream, sorted, and read one after the other, so that a stream of any length is never held whole: short streams
    are searched at once, and longer ones with the automaton.
    """
    spark = chunks.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    labels = list(patterns.check().labels)
    kinds = {f.name: f.dataType for f in chunks.schema}
    schema = T.StructType([T.StructField(stream, kinds[stream]), *T._parse_datatype_string(_TYPES).fields])  # type: ignore[attr-defined]
    data = F.encode(content, "UTF-8") if isinstance(kinds[content], T.StringType) else F.col(content)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [finder(x) for x in labels]
        machines: list[automaton.Machine] = []
        meta = [pa.array([x.user_index for x in labels], pa.int64()), pa.array([x.pattern for x in labels], pa.string()), pa.array([x.enc_chain for x in labels], pa.string())]
        own: pa.Scalar | None = None
        held: list[bytes] = []
        size = 0
        running: StreamSearch | None = None
        keys: list[pa.Scalar] = []
        counts: list[int] = []
        out: list[tuple[int, int, int]] = []

        def add(hits: list[tuple[int, int, int]]) -> None:
            if hits:
                keys.append(own)
                counts.append(len(hits))
                out.extend(hits)

        def end() -> None:
            nonlocal running, held, size
            if running is not None:
                add(running.feed(b"".join(held)) + running.close())
            elif held:
                whole = b"".join(held)
                add([(s, e, i) for i, f in enumerate(finders) for s, e in f(whole)])
            running, held, size = None, [], 0

        def made() -> pa.RecordBatch:
            cells = list(zip(*out, strict=True))
            which = pa.array(cells[2], pa.int32())
            names = pa.array([k.as_py() for k, n in zip(keys, counts, strict=True) for _ in range(n)], keys[0].type)
            done = pa.RecordBatch.from_arrays([names, pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), which, *[m.take(which) for m in meta]], names=schema.names)
            keys.clear(), counts.clear(), out.clear()
            return done

        for batch in batches:
            for key, part in zip(batch.column(0), batch.column(1), strict=True):
                if own is None or key != own:
                    end()
                    own = key
                raw = part.as_py() or b""
                held.append(raw)
                size += len(raw)
                if size > GATHERED:
                    if running is None:
                        machines = machines or [automaton.Machine(emit.program(x.tree, x.enc_chain)) for x in labels]
                        running = StreamSearch(patterns, machines=machines)
                    add(running.feed(b"".join(held)))
                    held, size = [], 0
            if out:
                yield made()
        end()
        if out:
            yield made()

    rows = chunks.select(F.col(stream), F.col(order).alias("__order"), data.alias("__data"))
    return rows.repartition(stream).sortWithinPartitions(stream, "__order").select(stream, "__data").mapInArrow(find, schema)
