"""Search of table columns with pattern sets.

Offsets are byte offsets, half open. Each label reports its own leftmost matches that don't overlap, as a union over labels. The
byte engine works on Arrow batches of encoded text. Python's re runs the compiled byte expression where emit.cost() bounds its time for the
value's length; otherwise the automaton does, whose time grows with the bytes. Questions that need no offsets (which rows, how many
hits, which texts) stay in the JVM where the pattern can be said in characters.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytetrawl.plans import automaton, emit
from bytetrawl.plans.patterns import Label, PatternSet

from . import context as ctx

#: Rows in an Arrow batch.
BATCH_ROWS = 1000
#: Hits in an Arrow batch that is handed on.
BATCH_HITS = 50_000
Finder = Callable[[bytes], list[tuple[int, int]]]


def _machine(label: Label) -> Callable[[], automaton.Machine]:
    """The label's automaton, made when it is first called for."""
    return functools.cache(lambda: automaton.Machine(emit.program(label.tree, label.enc_chain)))


def _by_length(label: Label, short: Finder, long: Finder) -> Finder:
    """short for values that it can search in bounded time, and long for others."""
    most = emit.RE_BYTES.get(emit.cost(label.tree), -1)
    return lambda data: short(data) if len(data) <= most else long(data)


def finder(label: Label) -> Finder:
    """A function that finds a label's hits in bytes."""
    tree = label.tree
    if (text := emit.literal(tree)) is not None and not label.options.case_insensitive and (needle := emit.literal_bytes(text, label.enc_chain)):
        return lambda data: _literal(data, needle)
    machine = _machine(label)
    expression = re.compile(emit.byte_regex(tree, label.enc_chain), re.DOTALL)
    found = _by_length(label, lambda data: [m.span() for m in expression.finditer(data)], lambda data: machine().find(data))
    need = emit.literal_bytes(emit.required(tree), label.enc_chain)
    return (lambda data: found(data) if need in data else []) if need else found


def _literal(data: bytes, needle: bytes) -> list[tuple[int, int]]:
    out, at = [], data.find(needle)
    while at >= 0:
        out.append((at, at + len(needle)))
        at = data.find(needle, at + len(needle))
    return out


def starter(label: Label) -> Finder:
    """A function that finds a label's hit at the first byte."""
    machine = _machine(label)
    expression = re.compile(b"(?:" + emit.byte_regex(label.tree, label.enc_chain) + b")", re.DOTALL)
    return _by_length(label, lambda data: [m.span()] if (m := expression.match(data)) else [], lambda data: [(0, e)] if (e := machine().at(data)) > 0 else [])


def _many(labels: Sequence[Label]) -> Callable[[bytes], Iterator[tuple[int, int, int]]] | None:
    """One pass for many plain literals of one-byte encodings, where the library for it is there."""
    try:
        import ahocorasick
    except ImportError:
        return None
    words: dict[str, list[int]] = {}
    for i, x in enumerate(labels):
        text = emit.literal(x.tree)
        if text is None or x.options.case_insensitive or "|" in x.enc_chain or x.enc_chain not in ("US-ASCII", "UTF-8"):
            return None
        words.setdefault(text.encode("utf-8").decode("latin-1"), []).append(i)
    machine = ahocorasick.Automaton()
    for w, own in words.items():
        machine.add_word(w, (len(w), tuple(own)))
    machine.make_automaton()

    def find(data: bytes) -> Iterator[tuple[int, int, int]]:
        free: dict[int, int] = {}
        for last, (n, own) in machine.iter(data.decode("latin-1")):
            start = last + 1 - n
            if start >= free.get(own[0], 0):
                free[own[0]] = last + 1
                for i in own:
                    yield start, last + 1, i

    return find


def _texts(parts: list[bytes], index: np.ndarray, labels: Sequence[Label]) -> pa.Array:
    """The texts of hits, as bytes where those are valid UTF-8 and the label's encoding says so."""
    if all(x.enc_chain in ("UTF-8", "US-ASCII") for x in labels):
        try:
            raw = pa.array(parts, pa.binary())
            if not any(b"\0" in p for p in parts):
                text = raw.cast(pa.string())
                text.validate(full=True)
                return text
        except pa.ArrowInvalid:
            pass
    known: dict[tuple[bytes, str], str] = {}
    out = []
    for p, i in zip(parts, index, strict=True):
        key = p, labels[i].enc_chain
        if key not in known:
            if len(known) > 100_000:
                known.clear()
            known[key] = ctx.text_of(*key)
        out.append(known[key])
    return pa.array(out, pa.string())


def _run(df: DataFrame, column: str, patterns: PatternSet, keys: Sequence[str], begins: bool, lines: tuple[int, int] | None, base: str | None) -> DataFrame:
    labels = list(patterns.check().labels)
    spark = df.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    kinds = {f.name: f.dataType for f in df.schema}
    data = F.encode(column, "UTF-8") if isinstance(kinds[column], T.StringType) else F.col(column)
    source = df.select(*keys, *([F.col(base).cast("long").alias("__base")] if base else []), data.alias("__data")).where(F.col("__data").isNotNull())
    fields = [T.StructField(k, kinds[k]) for k in keys]
    fields += [T.StructField(n, t) for n, t in (("start", T.LongType()), ("end", T.LongType()), ("keyword_index", T.IntegerType()), ("user_index", T.LongType()), ("pattern", T.StringType()), ("enc_chain", T.StringType()), ("hit_text", T.StringType()))]
    if lines is not None:
        fields += [T.StructField(n, t) for n, t in (("context", T.StringType()), ("data_offset", T.LongType()), ("hit_begin", T.IntegerType()), ("hit_end", T.IntegerType()), ("bad", T.IntegerType()))]
    schema = T.StructType(fields)
    n_keys = len(keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = _many(labels) if len(labels) > 16 and not begins else None
        finders = [] if many else [starter(x) if begins else finder(x) for x in labels]
        meta = [pa.array([x.user_index for x in labels], pa.int64()), pa.array([x.pattern for x in labels], pa.string()), pa.array([x.enc_chain for x in labels], pa.string())]

        def made(batch: pa.RecordBatch, rows: list[int], counts: list[int], which: list[int], spans: list[tuple[int, int]], parts: list[bytes], around: list[ctx.Context]) -> pa.RecordBatch:
            at = np.repeat(np.array(rows, dtype=np.int64), counts)
            index = np.repeat(np.array(which, dtype=np.int32), counts)
            off = batch.column(n_keys).to_numpy(zero_copy_only=False)[at] if base else 0
            both = np.array(spans, dtype=np.int64).reshape(-1, 2)
            take = pa.array(index)
            out = [batch.column(i).take(pa.array(at)) for i in range(n_keys)]
            out += [pa.array(both[:, 0] + off), pa.array(both[:, 1] + off), take, *[m.take(take) for m in meta], _texts(parts, index, labels)]
            if lines is not None:
                out += [pa.array([c.context for c in around], pa.string()), pa.array(np.array([c.data_offset for c in around], dtype=np.int64) + off)]
                out += [pa.array([getattr(c, name) for c in around], pa.int32()) for name in ("hit_begin", "hit_end", "bad")]
            return pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

        for batch in batches:
            rows: list[int] = []
            counts: list[int] = []
            which: list[int] = []
            spans: list[tuple[int, int]] = []
            parts: list[bytes] = []
            around: list[ctx.Context] = []
            for r, value in enumerate(batch.column(batch.num_columns - 1)):
                content = value.as_py()
                if many:
                    by_label: dict[int, list[tuple[int, int]]] = {}
                    for s, e, i in many(content):
                        by_label.setdefault(i, []).append((s, e))
                    found = list(by_label.items())
                else:
                    found = [(i, hits) for i, f in enumerate(finders) if (hits := f(content))]
                for i, hits in found:
                    rows.append(r)
                    counts.append(len(hits))
                    which.append(i)
                    spans += hits
                    parts += [content[s:e] for s, e in hits]
                    if lines is not None:
                        around += [ctx.hit_context(content, s, e, lines[0], lines[1], labels[i].enc_chain) for s, e in hits]
                if len(spans) >= BATCH_HITS:
                    yield made(batch, rows, counts, which, spans, parts, around)
                    rows, counts, which, spans, parts, around = [], [], [], [], [], []
            if spans:
                yield made(batch, rows, counts, which, spans, parts, around)

    return source.mapInArrow(find, schema)


def search(df: DataFrame, column: str, patterns: PatternSet, keys: Sequence[str] = (), lines: tuple[int, int] | None = None, base: str | None = None) -> DataFrame:
    """Every hit of every label in a string or binary column, with the key columns of its row.

    lines: also the context, so many lines before and after (-1: none). base: a column with the offset of the value's first byte.
    """
    return _run(df, column, patterns, keys, False, lines, base)


def starts_with(df: DataFrame, column: str, patterns: PatternSet, keys: Sequence[str] = ()) -> DataFrame:
    """The hit at the first byte of each value, for each label that has one."""
    return _run(df, column, patterns, keys, True, None, None)


def search_resolve(data: bytes, label: Label, boundary: int) -> list[tuple[int, int]]:
    """Hits that start before boundary, continued beyond it; none start at or after it."""
    return [h for h in finder(label)(data) if h[0] < boundary]


def _java(label: Label) -> str | None:
    """The expression for the JVM's backtracking engine, where its time is bounded well enough."""
    return emit.char_regex(label.tree, label.enc_chain) if emit.cost(label.tree) in (0, 1) else None


def hit_texts(df: DataFrame, column: str, patterns: PatternSet, keys: Sequence[str] = ()) -> DataFrame:
    """Each hit's text and label without offsets, in the JVM if every label allows it."""
    expressions = [(x, _java(x)) for x in patterns.check().labels]
    kind = dict(df.dtypes)[column]
    if kind != "string" or any(e is None for _, e in expressions):
        return search(df, column, patterns, keys).select(*keys, "hit_text", "keyword_index", "user_index", "pattern", "enc_chain")

    def of(x: Label, e: str) -> Column:
        meta = [F.lit(x.keyword_index).alias("keyword_index"), F.lit(x.user_index).cast("long").alias("user_index"), F.lit(x.pattern).alias("pattern"), F.lit(x.enc_chain).alias("enc_chain")]
        return F.transform(F.regexp_extract_all(column, F.lit(f"(?s)({e})"), F.lit(1)), lambda t: F.struct(t.alias("hit_text"), *meta))

    per_label = [of(x, str(e)) for x, e in expressions]
    hits = per_label[0] if len(per_label) == 1 else F.concat(*per_label)
    return df.where(F.col(column).isNotNull()).select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")


def counts(df: DataFrame, column: str, patterns: PatternSet, keys: Sequence[str] = ()) -> DataFrame:
    """The keys of each row and its number of hits of each label (hits_0, hits_1, ...): a row for each row, none for a null value.

    In the JVM if every label allows it, and else in Arrow batches, with the same result.
    """
    labels = list(patterns.check().labels)
    expressions = [_java(x) for x in labels]
    kinds = {f.name: f.dataType for f in df.schema}
    if isinstance(kinds[column], T.StringType) and None not in expressions:
        return df.select(*keys, *[F.coalesce(F.regexp_count(column, F.lit(f"(?s){e}")), F.lit(0)).cast("long").alias(f"hits_{i}") for i, e in enumerate(expressions)])
    data = F.encode(column, "UTF-8") if isinstance(kinds[column], T.StringType) else F.col(column)
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), *(T.StructField(f"hits_{i}", T.LongType()) for i in range(len(labels)))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [finder(x) for x in labels]
        for batch in batches:
            values = [v.as_py() for v in batch.column(batch.num_columns - 1)]
            found = [pa.array([0 if v is None else len(f(v)) for v in values], pa.int64()) for f in finders]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=schema.names)

    return df.select(*keys, data.alias("__data")).mapInArrow(count, schema)


def has_hit(column: str, label: Label) -> Column:
    """Whether a string value has a hit of a label; ValueError if the pattern can't be said in characters."""
    e = _java(label)
    if e is None:
        raise ValueError(f"{label.pattern} can only be searched for in bytes")
    found = F.col(column).rlike(f"(?s){e}")
    need = emit.required(label.tree)
    return F.contains(F.col(column), F.lit(need)) & found if len(need) > 1 else found


def in_order(hits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hits by keys, start, end and label."""
    return hits.orderBy(*keys, "start", "end", "keyword_index")


def with_labels(hits: DataFrame, patterns: PatternSet) -> DataFrame:
    """Hits (with keyword_index) and their labels' metadata; the label table is as small as the pattern set on the driver."""
    info = patterns.info(hits.sparkSession)
    return hits.join(F.broadcast(info), "keyword_index")
