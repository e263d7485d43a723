"""Search of tables, against the catalog's SQL where there is one."""

import duckdb
import pytest

from bytetrawl.operators import context, search, sinks, summary
from bytetrawl.operators.search import counts, finder
from bytetrawl.plans import catalog
from bytetrawl.plans.parser import Options
from bytetrawl.plans.patterns import PatternSet
from bytetrawl.sources import files
from bytetrawl.streaming.search import search_chunks, search_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    columns = sorted(df.columns)
    return sorted(repr([None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else str(v) for v in r]) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_context():
    text = b"0\n1\n2\n3\n4\n5\n6\n7\n8\n9\n"
    c = context.hit_context(text, 10, 11, 1, 2)
    assert (c.context, c.data_offset, c.hit_begin, c.hit_end) == ("4\n5\n6\n7", 8, 2, 3)
    assert context.hit_context(b"abc foo\r\nx", 4, 7, 0, 0).context == "abc foo"
    assert context.hit_context(b"a\xffb", 0, 1, 0, 0).bad == 1
    assert context.hit_context(b"x foo y", 2, 5, -1, -3).context == "foo"
    values, offsets, hit, bad = context.read_window(b"ab\xdfc\xf0\x9f\x92\xa9", 0, "UTF-8", 3, 4, 2, 2)
    assert (values, offsets, hit, bad) == ([0x62, -0xE0, 0x63, 0x1F4A9], [1, 2, 3, 4, 8], (2, 3), 1)
    with pytest.raises(ValueError, match="negative"):
        context.line_options(both=-5)


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"foo\tbar foo\xff")
    df = files.read_files(spark, str(tmp_path / "in"))
    ps = PatternSet.from_list(["foo", "o\tb"], options=Options())
    hits = search.search(df, "content", ps, ["path"], lines=(0, 0))
    lines = sorted(r.value.split("\t", 1)[1] for r in sinks.hit_lines(hits, "path").collect())
    assert lines == ["0\t3\t0\tfoo\tUS-ASCII\t0\tfoo\\tbar foo�", "2\t5\t1\to\tb\tUS-ASCII\t0\tfoo\\tbar foo�", "8\t11\t0\tfoo\tUS-ASCII\t0\tfoo\\tbar foo�"]
    got = [r.value for r in sinks.histogram_lines(summary.histogram(hits)).collect()]
    assert got == ["2\tfoo\t0\tfoo", "1\to\\tb\t1\to\\tb"]
    assert sinks.count_only(hits) == 3
    assert sinks.accumulated(hits)[1] == {"foo": 2, "o\tb": 1}
    assert list(sinks.separated(["a", "b"])) == ["a", "--", "b"]
    assert sinks.show_path(True) and not sinks.show_path(True, without_name=True)
    assert search.with_labels(hits.select("keyword_index"), ps).count() == 3
    ps.save(spark, str(tmp_path / "kept"))
    assert PatternSet.load(spark, str(tmp_path / "kept")).labels == ps.labels
    (tmp_path / "list").write_text(f"{tmp_path}/in/a.bin\n")
    assert files.read_lists(spark, str(tmp_path / "list")).count() == 1
    at = files.from_bytes(spark, b"ba").selectExpr("path", "4294967296L as offset", "content")
    assert [(r.start, r.end) for r in search.search(at, "content", PatternSet.from_list(["a"]), base="offset").collect()] == [(4294967297, 4294967298)]


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "aXa")], "id int, t string")
    assert [(r.id, r.start) for r in search.search(df, "t", PatternSet.from_list(["X"]), ["id"]).collect()] == [(3, 1)]
    assert search.search(df.where("id > 5"), "t", PatternSet.from_list(["X"]), ["id"]).count() == 0
    assert sorted((r.id, r.hits_0) for r in search.counts(df, "t", PatternSet.from_list(["a"]), ["id"]).collect()) == [(1, 0), (2, 0), (3, 2)]


def test_structured_stream(spark, tmp_path):
    schema = "id int, n int, part string, last boolean"
    source, out = tmp_path / "chunks", "found_hits"
    for i, row in enumerate([(1, 0, "abcdefghi", False), (1, 1, "jklmnopqr", False), (1, 2, "xaa", True)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(str(source))
        if i == 0:
            q = search_stream(spark.readStream.schema(schema).json(str(source)), PatternSet.from_list(["hijk", "a+"]), "id", "n", "part", "last").writeStream.format("memory").queryName(out).outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    assert sorted((r.start, r.end, r.keyword_index) for r in spark.table(out).collect()) == [(0, 1, 1), (7, 11, 0), (19, 21, 1)]


@pytest.mark.parametrize(("pattern", "want"), [("ab", [(1, 1), (1, 2), (None, 1), (2, 0)]), ("(ab)+", [(1, 1), (1, 2), (None, 1), (2, 0)]), ("(a?b)+", [(1, 1), (1, 2), (None, 1), (2, 0)])])
def test_counts_are_by_row(spark, pattern, want):
    """Equal keys stay rows of their own, null keys stay null, and null values have no hits, by whichever engine."""
    df = spark.createDataFrame([(1, "aab"), (1, "ab ab"), (None, "ab"), (2, None)], "k int, t string")
    got = [tuple(r) for r in counts(df, "t", PatternSet.from_list([pattern]), ["k"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_streams(spark):
    """Streams beyond what is gathered go on with the automaton, with the same hits."""
    text = ("a walking dog " * 30 + "x" * 5000) * 400
    rows = [("long", i, text[i * 3000 : i * 3000 + 3000]) for i in range(-(-len(text) // 3000))] + [("short", 0, "walk"), ("short", 1, "ing on"), ("none", 0, None)]
    assert len(text) > 2 << 20
    df = spark.createDataFrame(rows, "s string, i int, c string").repartition(5)
    ps = PatternSet.from_list(["[a-z]+ing", "x{3}"])
    got = sorted((r.s, r.start, r.end, r.keyword_index) for r in search_chunks(df, ps, "s", "i", "c").collect())
    want = [("long", *h, i) for i, x in enumerate(ps.labels) for h in finder(x)(text.encode())] + [("short", 0, 7, 0)]
    assert got == sorted(want)


def test_chunked_files(spark, tmp_path):
    """A file in pieces of any size gives the hits of the whole file."""
    content = b"one ing two walking \xff\x00" * 4000
    (tmp_path / "a b.bin").write_bytes(content)
    (tmp_path / "empty").write_bytes(b"")
    pieces = files.read_chunks(spark, str(tmp_path), chunk_bytes=7001)
    assert pieces.agg({"offset": "max"}).first()[0] == len(content) // 7001 * 7001
    ps = PatternSet.from_list(["[a-z]+ing", "g [a-z]+"])
    got = sorted((r.start, r.end, r.keyword_index) for r in search_chunks(pieces, ps, "path", "chunk", "content").collect())
    assert got == sorted((*h, i) for i, x in enumerate(ps.labels) for h in finder(x)(content))
    (tmp_path / "other").write_bytes(b"x")
    (tmp_path / "list").write_text(f"{tmp_path}/other\n\n{tmp_path}/a b.bin\n{tmp_path}/other\n")
    assert sorted((r.path.split("/")[-1], r.turn) for r in files.read_lists(spark, str(tmp_path / "list")).collect()) == [("a b.bin", 1), ("other", 1), ("other", 2)]
    assert files.list_names(spark, str(tmp_path / "list")) == [f"{tmp_path}/other", f"{tmp_path}/a b.bin", f"{tmp_path}/other"]


def test_windows_and_measures(spark):
    df = spark.createDataFrame([(1, "päx one"), (2, None)], "id int, t string")
    hits = search.search(df, "t", PatternSet.from_list(["x"], ["UTF-8"]), ["id", "t"])
    w = context.with_windows(hits, "t", 2, 3).first().window
    assert (w.values, w.offsets, w.begin, w.end, w.bad) == ([ord(c) for c in "päx on"], [0, 1, 3, 4, 5, 6, 7], 2, 3, 0)
    assert context.full_hit_context("päx one".encode(), 3, 4, window=2) == ("päx o", 2, 3)
    m = summary.measured(df, "t", lambda d: search.search(d, "t", PatternSet.from_list(["[a-z]"])))
    assert (m.rows, m.bytes, m.hits) == (1, 8, 5) and "MB/s avg" in str(m)
    bad = search.search(spark.createDataFrame([(bytearray(b"\xffx\xfe"),)], "b binary"), "b", PatternSet.from_list(["x"], ["UTF-8"]), lines=(0, 0)).first()
    assert bad.bad == 2
