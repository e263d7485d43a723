"""The engine's queries by name, and DuckDB SQL for the same rows.

In the SQL a label's hits come from the gaps and matches that regexp_extract_all gives in turn; their byte lengths add up to offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytetrawl.operators import search as S
from bytetrawl.operators import sinks, summary
from bytetrawl.sources import files
from bytetrawl.streaming.search import search_chunks

from . import emit, tools
from .parser import Options
from .patterns import PatternSet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits_sql(patterns: PatternSet, source: str, column: str, keys: Sequence[str], unit: str = "strlen({})", begins: bool = False) -> str:
    """Every hit of a pattern set in a column of a table or subquery; unit: the SQL of a piece's length."""
    k = "".join(f"{x}, " for x in keys)
    parts = []
    for x in patterns.labels:
        e = emit.char_regex(x.tree, "UTF-8" if x.enc_chain not in ("US-ASCII", "UTF-8") else x.enc_chain)
        assert e is not None, x.pattern
        meta = f"{x.keyword_index} AS keyword_index, CAST({x.user_index} AS BIGINT) AS user_index, {quoted(x.pattern)} AS pattern, {quoted(x.enc_chain)} AS enc_chain"
        if begins:
            parts.append(f"SELECT {k}CAST(0 AS BIGINT) AS \"start\", CAST({unit.format('h')} AS BIGINT) AS \"end\", {meta}, h AS hit_text FROM (SELECT {k}regexp_extract({column}, {quoted(f'(?s)^(?:{e})')}) AS h FROM {source}) WHERE h <> ''")
            continue
        both = quoted(f"(?s)(.*?)({e})")
        ks = "".join(f"{x} AS {x.split('.')[-1]}, " for x in keys)
        before = f"sum({unit.format('g')} + {unit.format('h')}) OVER (PARTITION BY u ORDER BY i)"
        parts.append(
            f"SELECT {k}CAST({before} - {unit.format('h')} AS BIGINT) AS \"start\", CAST({before} AS BIGINT) AS \"end\", {meta}, h AS hit_text "
            f"FROM (SELECT u, {k}unnest(gs) AS g, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT row_number() OVER () AS u, {ks}regexp_extract_all({column}, {both}, 1) AS gs, regexp_extract_all({column}, {both}, 2) AS hs FROM {source}))"
        )
    return "\nUNION ALL\n".join(parts)


def _hits(name: str, source: str, key: str, column: str, patterns: PatternSet, begins: bool = False) -> None:
    run = S.starts_with if begins else S.search
    QUERIES[name] = lambda spark, d: run(table(spark, d, source), column, patterns, [key])
    ORACLE_SQL[name] = hits_sql(patterns, source, column, [key], begins=begins)


def _made(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


_UTF8 = ["UTF-8"]
P = PatternSet.from_list
SLICE = P(["[Tt]he", "and", "[a-zA-Z]+ing"])
MULTI = P(["a(n|t)d?", "th[aeiou]", "[A-Z][a-z]+", "ing[.,]"], _UTF8)
NUMBERS = P([r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"])
ACCENTS = P([r"\w+é\w*", r"[À-ÿ]{2,}"], _UTF8, Options(unicode=True))

_hits("hits_single", "documents", "doc_id", "text", P(["[a-z]+tion"]))
_hits("hits_multi", "documents", "doc_id", "text", MULTI)
_hits("hits_overlapping_patterns", "documents", "doc_id", "text", P(["the", "he", "there?", "the"]))
_hits("hits_reluctant", "documents", "doc_id", "text", P(["t.+?e", "a[a-z]*?n", "e{1,3}?"], _UTF8))
_hits("hits_counted", "documents", "doc_id", "text", P(["[a-z]{5}", "(an){2,3}", "e.{0,10}th", "[0-9]{3,}"], _UTF8))
_hits("hits_class_ops", "documents", "doc_id", "text", P(["[a-z&&[aeiou]]{2,}", "[a-z--aeiou]{4,}", "[a-m~~h-z]{3}", "[^a-z \\n]{3,}"], _UTF8))
_hits("hits_inline_switch", "documents", "doc_id", "text", P(["(?i)the(?-i)r", "th((?i)E)r"]))
_hits("hits_case_insensitive", "documents", "doc_id", "text", P(["THE", "tion"], options=Options(case_insensitive=True)))
_hits("hits_unicode_class", "documents", "doc_id", "text", ACCENTS)
_hits("hits_escapes", "documents", "doc_id", "text", P([r"\x65\N{LATIN SMALL LETTER R}", r"\.\n", r"\x{e9}[a-z]", r"\d\d", r"\s\w{3}\s", r"\156\144"], _UTF8))
_hits("hits_space_classes", "documents", "doc_id", "text", P([r"\.\v+[A-Z]", r"[a-z]\h[a-z]\h", r"\V{40}\v", r",\H"]))
_hits("hits_alternation_order", "documents", "doc_id", "text", P(["th|the|there", "there|the|th"]))
_hits("hits_fixed", "documents", "doc_id", "text", P(["the.", "Licensed under", "a+b"], options=Options(fixed=True)))
_hits("starts_with_hits", "pages", "page_id", "html", P(["<!DOCTYPE html>", "<[!a-zA-Z]+", "html"]), begins=True)
_hits("starts_with_documents", "documents", "doc_id", "text", P(["[A-Z][a-z]+", "The", "[A-Z]"], _UTF8), begins=True)
_hits("email_addresses", "documents", "doc_id", "text", P([r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"]))
_hits("ipv4_addresses", "documents", "doc_id", "text", P([r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"]))
_hits("urls", "pages", "page_id", "url", P([r"https?", r"[a-z0-9.\-]+\.example\.(com|org|net)", r"[?&][a-z]+=[a-z0-9]+"]))
_hits("html_tags", "pages", "page_id", "html", P([r"</?[a-zA-Z][a-zA-Z0-9]*", r"<!\-\-.*?\-\->"], _UTF8))
_hits("json_keys", "events", "event_id", "props", P([r'"[a-z_]+": ?[0-9]+', r'"[a-z_]+"']))
_hits("conversation_words", "conversations", "conv_id", "text", P(["[Yy]ou", r"\?"], _UTF8))
_hits("part_names", "part", "p_partkey", "p_name", P(["[a-z]+", "o"]))
_hits("encase_patterns", "documents", "doc_id", "text", PatternSet.from_encase(["###", r"e\w0072+"]))

_SLICE_SQL = hits_sql(SLICE, "documents", "text", ["doc_id"])


@_made("histogram", f"SELECT hit_text, pattern, user_index, count(*) AS count FROM ({_SLICE_SQL}) GROUP BY ALL")
def _histogram(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a few patterns, counted by text."""
    return summary.histogram(S.hit_texts(table(spark, d, "documents"), "text", SLICE))


@_made("histogram_top", f"SELECT hit_text, pattern, user_index, count(*) AS count FROM ({_SLICE_SQL}) GROUP BY ALL ORDER BY count DESC, user_index, hit_text, pattern LIMIT 20")
def _top(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent hits."""
    return summary.by_count(_histogram(spark, d)).limit(20)


@_made("histogram_lines", f"SELECT concat_ws(chr(9), CAST(count(*) AS VARCHAR), replace(replace(hit_text, chr(10), '\\n'), chr(9), '\\t'), CAST(user_index AS VARCHAR), pattern) AS value FROM ({hits_sql(P(['[a-z]+[.][^a-z]']), 'documents', 'text', ['doc_id'])}) GROUP BY hit_text, user_index, pattern")
def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A histogram as tab-separated lines with control characters written out."""
    return sinks.histogram_lines(summary.histogram(S.hit_texts(table(spark, d, "documents"), "text", P(["[a-z]+[.][^a-z]"]))))


@_made("hits_per_pattern", f"SELECT pattern, count(*) AS hits FROM ({_SLICE_SQL}) GROUP BY ALL")
def _per_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each pattern."""
    return summary.hits_per_pattern(S.hit_texts(table(spark, d, "documents"), "text", SLICE))


@_made("total_hits", f"SELECT count(*) AS hits FROM ({_SLICE_SQL})")
def _total(spark: SparkSession, d: str) -> DataFrame:
    """All hits."""
    return summary.total(S.hit_texts(table(spark, d, "documents"), "text", SLICE))


@_made("bytes_searched", "SELECT count(text) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def _bytes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and bytes."""
    return summary.bytes_searched(table(spark, d, "documents"), "text")


@_made("hit_counts", "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, {quoted('(?s)' + str(emit.char_regex(x.tree, x.enc_chain)))})) AS BIGINT) AS hits_{i}" for i, x in enumerate(SLICE.labels)) + " FROM documents")
def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each pattern in each document."""
    return S.counts(table(spark, d, "documents"), "text", SLICE, ["doc_id"])


@_made("first_hit_per_doc", f"SELECT doc_id, min(\"start\") AS first_start, keyword_index FROM ({hits_sql(NUMBERS, 'documents', 'text', ['doc_id'])}) GROUP BY doc_id, keyword_index")
def _first(spark: SparkSession, d: str) -> DataFrame:
    """Where each pattern is first hit."""
    return S.search(table(spark, d, "documents"), "text", NUMBERS, ["doc_id"]).groupBy("doc_id", "keyword_index").agg(F.min("start").alias("first_start"))


def _matching(both: bool) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    one, two = MULTI.labels[2], MULTI.labels[3]
    e = [quoted(f"(?s){emit.char_regex(x.tree, x.enc_chain)}") for x in (one, two)]
    word = "AND" if both else "OR"

    def run(spark: SparkSession, d: str) -> DataFrame:
        a, b = S.has_hit("text", one), S.has_hit("text", two)
        return table(spark, d, "documents").where(a & b if both else a | b).select("doc_id")

    return run, f"SELECT doc_id FROM documents WHERE regexp_matches(text, {e[0]}) {word} regexp_matches(text, {e[1]})"


for _name, _both in (("docs_matching_any", False), ("docs_matching_all", True)):
    QUERIES[_name], ORACLE_SQL[_name] = _matching(_both)

for _by in ("lang", "source"):
    QUERIES[f"hits_by_{_by}"] = lambda spark, d, by=_by: S.hit_texts(table(spark, d, "documents"), "text", SLICE, [by]).groupBy(by, "pattern").agg(F.count("*").alias("hits"))
    ORACLE_SQL[f"hits_by_{_by}"] = f"SELECT {_by}, pattern, count(*) AS hits FROM ({hits_sql(SLICE, 'documents', 'text', [_by])}) GROUP BY ALL"


def _encoded(name: str, chain: str, charset: str, width: int, patterns: list[str]) -> None:
    ps = P(patterns, [chain])

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, "documents").select("doc_id", F.encode(F.regexp_replace("text", "[^\\x00-\\xff]", "?"), charset).alias("raw"))
        return S.search(df, "raw", ps, ["doc_id"])

    QUERIES[name] = run
    ORACLE_SQL[name] = hits_sql(ps, "(SELECT doc_id, regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g') AS t FROM documents)", "t", ["doc_id"], f"length({{}}) * {width}")


_encoded("hits_utf16le", "UTF-16LE", "UTF-16LE", 2, ["the", "[a-z]+é", "e{2,}"])
_encoded("hits_utf16be", "UTF-16BE", "UTF-16BE", 2, ["and[^a-z]"])
_encoded("hits_utf32be", "UTF-32BE", "UTF-32", 4, ["the", "[a-z]+é", "e{2,}"])
_encoded("hits_latin1", "iso-8859-1", "ISO-8859-1", 1, ["[À-ÿ]+", "th."])


@_made("hits_rot13", hits_sql(P(["the", "and"]), "documents", "text", ["doc_id"]).replace("'US-ASCII' AS enc_chain, h AS hit_text", "'US-ASCII|ROT13' AS enc_chain, translate(h, 'theand', 'guranq') AS hit_text"))
def _rot(spark: SparkSession, d: str) -> DataFrame:
    """Hits in text whose letters are moved on by 13."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    moved = F.translate("text", letters + letters.upper(), "".join(chr((ord(c) - 97 + 13) % 26 + 97) for c in letters) + "".join(chr((ord(c) - 97 + 13) % 26 + 65) for c in letters))
    df = table(spark, d, "documents").select("doc_id", moved.alias("t"))
    return S.search(df, "t", P(["the", "and"], ["US-ASCII|ROT13"]), ["doc_id"]).withColumn("hit_text", F.translate("hit_text", "theand", "guranq"))


def _context(name: str, before: int, after: int, pattern: str) -> None:
    ps = P([pattern])

    def run(spark: SparkSession, d: str) -> DataFrame:
        return S.search(table(spark, d, "documents"), "text", ps, ["doc_id"], lines=(before, after)).select("doc_id", "start", "end", "context", "data_offset", "hit_begin", "hit_end")

    QUERIES[name] = run
    hits = hits_sql(ps, "documents", "text", ["doc_id"])
    # Texts are cut at code points, so offsets are turned to those through the hit's text before it.
    ORACLE_SQL[name] = f"""
WITH hits AS ({hits}), parts AS (
  SELECT h.doc_id, h."start", h."end", CAST(encode(d.text) AS BLOB)[1:h."start"] AS a, CAST(encode(d.text) AS BLOB)[h."start"+1:h."end"] AS m, CAST(encode(d.text) AS BLOB)[h."end"+1:] AS z FROM hits h JOIN documents d USING (doc_id)),
texts AS (SELECT doc_id, "start", "end", decode(a) AS a, decode(m) AS m, decode(z) AS z FROM parts),
cut AS (SELECT doc_id, "start", "end", m,
  array_to_string(string_split(a, chr(10))[greatest(len(string_split(a, chr(10))) - {before}, 1):], chr(10)) AS l,
  array_to_string(string_split(z, chr(10))[1:{after + 1}], chr(10)) AS r FROM texts)
SELECT doc_id, "start", "end", l || m || r AS context, CAST("start" - strlen(l) AS BIGINT) AS data_offset, CAST(strlen(l) AS INTEGER) AS hit_begin, CAST(strlen(l) + strlen(m) AS INTEGER) AS hit_end FROM cut"""


_context("context_lines_c0", 0, 0, "[a-z]+tion[.,]")
_context("context_b1_a2", 1, 2, "Licensed")


@_made("hit_lines", f"SELECT concat_ws(chr(9), CAST(doc_id AS VARCHAR), CAST(\"start\" AS VARCHAR), CAST(\"end\" AS VARCHAR), CAST(user_index AS VARCHAR), pattern, enc_chain) AS value FROM ({hits_sql(NUMBERS, 'documents', 'text', ['doc_id'])})")
def _tsv(spark: SparkSession, d: str) -> DataFrame:
    """Hits as tab-separated lines."""
    return sinks.hit_lines(S.search(table(spark, d, "documents"), "text", NUMBERS, ["doc_id"]).withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id")


@_made("hit_statistics", f"WITH n AS (SELECT keyword_index, CAST(\"end\" - \"start\" AS DOUBLE) AS v FROM ({_SLICE_SQL})) SELECT keyword_index, min(v) AS min, max(v) AS max, avg(v) AS avg, count(v) / sum(1 / v) AS harmonic, quantile_disc(v, 0.5) AS median, var_pop(v) AS variance FROM n GROUP BY keyword_index")
def _statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of hits' lengths."""
    hits = S.search(table(spark, d, "documents"), "text", SLICE).select("keyword_index", (F.col("end") - F.col("start")).cast("double").alias("v"))
    return summary.statistics(hits, "v", ["keyword_index"])


_STREAM = P(["[a-z]+ing", "the", "t.{0,4}e"], _UTF8)


@_made("stream_hits", hits_sql(_STREAM, "(SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)", "t", ["conv_id"]).replace(", h AS hit_text", ""))
def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Hits in conversations whose turns are the chunks of a stream, by the streaming engine."""
    return search_chunks(table(spark, d, "conversations"), _STREAM, "conv_id", "turn", "text")


@_made("chunked_hits", ORACLE_SQL["stream_hits"])
def _chunked(spark: SparkSession, d: str) -> DataFrame:
    """The same by joining the chunks first."""
    joined = files.from_chunks(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return S.search(joined, "content", _STREAM, ["conv_id"]).drop("hit_text")


@_made("benchmark_passages", "SELECT d.doc_id, CAST(b.item_id AS BIGINT) AS user_index, CAST((strlen(d.text) - strlen(replace(d.text, b.text, ''))) // strlen(b.text) AS BIGINT) AS hits FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _passages(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark texts in documents, by one pass for all of them."""
    rows = table(spark, d, "benchmark").select("item_id", "text").collect()
    ps = PatternSet()
    for r in rows:
        ps.add(r.text, _UTF8, Options(fixed=True), r.item_id)
    return S.search(table(spark, d, "documents"), "text", ps, ["doc_id"]).groupBy("doc_id", "user_index").agg(F.count("*").alias("hits"))


_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''"


@_made("hits_fixed_many", f"WITH words AS ({_WORDS}) SELECT w AS pattern, CAST(sum((strlen(text) - strlen(replace(text, w, ''))) // strlen(w)) AS BIGINT) AS hits FROM documents JOIN words ON contains(text, w) GROUP BY w")
def _many(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every word of the parts' names."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).where("w <> ''").distinct()
    ps = P(sorted(r.w for r in words.collect()), _UTF8, Options(fixed=True))
    return summary.hits_per_pattern(S.search(table(spark, d, "documents"), "text", ps))


@_made("hits_with_quality", f"SELECT l.quality, h.pattern, count(*) AS hits FROM ({_SLICE_SQL}) h JOIN labels l USING (doc_id) GROUP BY ALL")
def _with_quality(spark: SparkSession, d: str) -> DataFrame:
    """Hits by the label of their document, counted before they are joined."""
    per = S.hit_texts(table(spark, d, "documents"), "text", SLICE, ["doc_id"]).groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))
    return per.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "pattern").agg(F.sum("n").alias("hits"))


_MIXED = PatternSet().add_list("foo\tUTF-8,BOGUS\n\n*bad\n[a&&]\t\tUTF-16LE\nx{2,1}\n^a\na*\n\\x{2642}\tUS-ASCII\nok+\tUTF-8,UTF-16BE\t0\t1\t0\n", "list")


def _values(rows: Sequence[tuple], names: Sequence[str]) -> str:
    cell = lambda v: "CAST(NULL AS VARCHAR)" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else quoted(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


@_made(
    "validate_errors",
    _values(
        [("unrecognized encoding 'BOGUS'", "foo", "BOGUS", "list", 0), ("repetition of non-atom by *, at [0,1)", "*bad", "US-ASCII", "list", 1), ("missing operand for &&, at [2,4)", "[a&&]", "UTF-16LE", "list", 2), ("2 > 1 in {2,1}, at [1,6)", "x{2,1}", "US-ASCII", "list", 3),
         ("assertions are not supported: ^, at [0,1)", "^a", "US-ASCII", "list", 4), ("Empty matches", "a*", "US-ASCII", "list", 5), ("code point U+2642 does not exist in US-ASCII", "\\x{2642}", "US-ASCII", "list", 6)],
        ["message", "pattern", "enc_chain", "source", "index"],
    ),
)
def _validate(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong in a pattern list."""
    return _MIXED.error_table(spark)


@_made("pattern_info", _values([(0, 0, "foo", "UTF-8", False, False, False), (1, 7, "ok+", "UTF-8", False, True, False), (2, 7, "ok+", "UTF-16BE", False, True, False)], ["keyword_index", "user_index", "pattern", "enc_chain", "fixed", "case_insensitive", "\"unicode\""]).replace("SELECT *", "SELECT keyword_index, CAST(user_index AS BIGINT) AS user_index, pattern, enc_chain, fixed, case_insensitive, \"unicode\""))
def _info(spark: SparkSession, d: str) -> DataFrame:
    """The labels of a pattern list."""
    return _MIXED.info(spark)


@_made("class_code_points", "SELECT CAST(c AS INTEGER) AS cp, chr(CAST(c AS INTEGER)) AS char FROM range(224, 256) t(c) WHERE c <> 247")
def _class(spark: SparkSession, d: str) -> DataFrame:
    """The code points of a class."""
    return tools.code_points(spark, "[à-ÿ--÷]", "iso-8859-1").select("cp", "char")


@_made("graph_edges", _values([(0, 1, "61", 0), (1, 2, "61", 0), (1, 3, "62-63", 1), (2, 2, "61", 0), (2, 3, "62-63", 1), (0, 4, "62", 0)], ["source", "target", "bytes", "priority"]))
def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the automaton of two patterns."""
    return tools.graph_tables(spark, P(["a+[bc]", "b"]))[1]


@_made("list_encodings")
def _encodings(spark: SparkSession, d: str) -> DataFrame:
    """Encodings and aliases."""
    return tools.list_encodings(spark)


@_made("program_dump")
def _program(spark: SparkSession, d: str) -> DataFrame:
    """The programs of two labels, a line a row."""
    return spark.createDataFrame(list(enumerate(P(["a+[bc]", "b|cd?"], ["UTF-8"]).listing().split("\n"))), "line int, text string")


@_made("sample_matches")
def _sample(spark: SparkSession, d: str) -> DataFrame:
    """Strings that match."""
    return spark.createDataFrame([(s,) for s in tools.sample(P(["a(b|c)d*", "[0-9]{3}x?"]), 20)], "sample string")
