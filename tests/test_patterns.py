"""The pattern language, encodings and automata, without Spark."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytetrawl.functions import encodings, sets
from bytetrawl.operators.search import finder, search_resolve, starter
from bytetrawl.plans import automaton, emit, parser, tools
from bytetrawl.plans.parser import Options, PatternError, parse, unparse
from bytetrawl.plans.patterns import PatternSet
from bytetrawl.streaming.search import StreamSearch


def hits(patterns, text, begins=False, **options):
    ps = PatternSet.from_list(patterns, options=Options(**options))
    data = text.encode("latin-1") if isinstance(text, str) else text
    return sorted((s, e, x.user_index) for x in ps.labels for s, e in (starter if begins else finder)(x)(data))


@pytest.mark.parametrize(
    ("patterns", "text", "expected"),
    [
        (["a+b|a"], "aaab", [(0, 4, 0)]),
        (["aaaa|a?a"], "aaa", [(0, 2, 0), (2, 3, 0)]),
        (["a(b|c)a", "ac+", "ab?a", "two"], "aba aa aca two", [(0, 3, 0), (0, 3, 2), (4, 6, 2), (7, 9, 1), (7, 10, 0), (11, 14, 3)]),
        (["a+?"], "aa", [(0, 1, 0), (1, 2, 0)]),
        (["a+?a", "a+?a"], "aaa", [(0, 2, 0), (0, 2, 1)]),
        (["a{10000}"], "a" * 10000, [(0, 10000, 0)]),
        (["a.b"], "a\nb", [(0, 3, 0)]),
        (["[ab&&bc]"], "abc", [(1, 2, 0), (2, 3, 0)]),
    ],
)
def test_hits(patterns, text, expected):
    assert hits(patterns, text) == expected


def test_starts_with():
    assert hits(["ab..ef", "c[a-z][a-z]", "[aA][bc][bc]"], "abcdefghijklmnop", begins=True) == [(0, 3, 2), (0, 6, 0)]


def test_switches_and_kelvin():
    ps = PatternSet().add("(?i)x((?-i)x)x", ["UTF-8"], Options(unicode=True), 0).add("(?i)k(?-i)k(?ai)k+", ["UTF-8"], Options(unicode=True), 1).add("(?i)k(?-i)k(?i)k+", ["UTF-8"], Options(unicode=True), 2)
    text = b"XXX XxX xxx Kkkk Kk\xe2\x84\xaaK"
    got = sorted((s, e, x.user_index) for x in ps.labels for s, e in finder(x)(text))
    assert got == [(4, 7, 0), (8, 11, 0), (12, 16, 1), (12, 16, 2), (17, 23, 2)]


@pytest.mark.parametrize(
    ("pattern", "message"),
    [
        ("*test", "repetition of non-atom by *, at [0,1)"),
        ("a{2,1}", "2 > 1 in {2,1}, at [1,6)"),
        ("a{2,1}?", "2 > 1 in {2,1}?, at [1,7)"),
        ("[a&&]", "missing operand for &&, at [2,4)"),
        ("[&&a]", "missing operand for &&, at [1,3)"),
        ("\\N", "invalid escape \\N, at [0,2)"),
        ("\\#", "invalid escape \\#, at [0,2)"),
        ("\\xG", "invalid escape \\xG, at [0,3)"),
        ("\\p{Letter", "invalid escape \\p{Letter, at [0,9)"),
        ("(a", "unmatched left parenthesis, at [0,1)"),
        ("[]", "empty character class, at [0,2)"),
        ("a*", "Empty matches"),
    ],
)
def test_errors(pattern, message):
    with pytest.raises(PatternError) as e:
        parse(pattern)
    assert str(e.value) == message


@pytest.mark.parametrize("pattern", ["^a", "a$", r"\bfoo", r"foo\Kbar", "(?=a)b", "(?:a)", "a|", "()", "a**", "(?m)a", r"\cA"])
def test_rejected(pattern):
    with pytest.raises(PatternError):
        parse(pattern)


def test_lists():
    text = "foo\r\nbar\n\\baz\rquux\r\n\r\n\nxyzzy"
    ps = PatternSet().add_list(text.replace("\\baz", "baz"))
    assert [(x.user_index, x.pattern) for x in ps.labels] == [(0, "foo"), (1, "bar"), (2, "baz"), (3, "quux"), (4, "xyzzy")]
    ps = PatternSet().add_list("foo\tUTF-8,BOGUS\nx+\tASCII\n(ab)*c\tBOGUS")
    assert [e.index for e in ps.errors] == [0, 2]
    ps = PatternSet().add_list("a*b+\tUTF-8,UTF-16LE\t0\t0\nJoel\tUTF-8\t1\t1")
    assert [(x.keyword_index, x.user_index) for x in ps.labels] == [(0, 0), (1, 0), (2, 1)]
    assert PatternSet.from_json(ps.to_json()) == PatternSet(ps.labels)
    with pytest.raises(ValueError, match="No valid patterns"):
        PatternSet().check()


def test_missing_code_point():
    e = PatternSet().add("\\x{2642}", ["US-ASCII"]).errors
    assert e[0].message == "code point U+2642 does not exist in US-ASCII"


@pytest.mark.parametrize("chain", ["UTF-8", "UTF-16LE", "UTF-16BE", "UTF-32LE", "UTF-32BE", "iso-8859-1", "cp1252", "koi8-r", "gbk", "UTF-8|XOR5A", "US-ASCII|ROT13"])
def test_encodings(chain):
    name, steps, _ = encodings.parse_chain(chain)
    valid = encodings.valid_points(name)
    for cp in (0x41, 0x7A, 0xE9, 0x416, 0x4E2D, 0x1F4A9):
        if sets.intersection(sets.of(cp), valid):
            raw = chr(cp).encode({"US-ASCII": "ascii"}.get(name, name))
            for s in steps:
                raw = s(raw)
            ps = PatternSet().add(f"\\x{{{cp:X}}}", [chain])
            assert finder(ps.labels[0])(b"?" * len(raw) + raw) == [(len(raw), 2 * len(raw))]


def test_whole_planes_round_trip():
    points = ((0x70, 0x90), (0x7F0, 0x810), (0xD700, 0xE010), (0xFFF0, 0x10010))
    for name in ("utf-8", "utf-16-le", "utf-32-be"):
        rx = re.compile(emit.byte_regex(parser.Set(points), name.replace("-le", "LE").replace("-be", "BE").replace("utf", "UTF")), re.DOTALL)
        for cp in range(0x10100):
            if not 0xD800 <= cp < 0xE000:
                assert bool(rx.fullmatch(chr(cp).encode(name))) == any(a <= cp <= b for a, b in points)


def test_byte_tables():
    encodings.register_byte_table("SWAP", bytes(reversed(range(256))))
    ps = PatternSet().add("ab", ["US-ASCII|SWAP"])
    assert finder(ps.labels[0])(bytes([0, 255 - 97, 255 - 98])) == [(1, 3)]


patterns = st.recursive(
    st.sampled_from(["a", "b", "c", "[ab]", "."]),
    lambda p: st.one_of(st.tuples(p, p).map("".join), st.tuples(p, p).map(lambda t: f"({t[0]}|{t[1]})"), st.tuples(p, st.sampled_from(["*", "+", "?", "*?", "+?", "??", "{2}", "{1,2}", "{1,2}?"])).map(lambda t: f"({t[0]}){t[1]}")),
    max_leaves=6,
)


@settings(max_examples=300, deadline=None)
@given(patterns, st.text("abc\n", max_size=12))
def test_engines_agree(pattern, text):
    try:
        tree = parse(pattern)
    except PatternError:
        return
    data = text.encode()
    expected = [m.span() for m in re.finditer(pattern, text, re.DOTALL)]
    assert [m.span() for m in re.finditer(emit.byte_regex(tree, "US-ASCII"), data, re.DOTALL)] == expected
    assert automaton.Machine(emit.program(tree, "US-ASCII")).find(data) == expected
    assert parse(unparse(tree)) == tree or [m.span() for m in re.finditer(emit.byte_regex(parse(unparse(tree)), "US-ASCII"), data, re.DOTALL)] == expected


@settings(max_examples=200, deadline=None)
@given(patterns, st.lists(st.binary(max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=6))
def test_stream_is_search(pattern, chunks):
    ps = PatternSet.from_list([pattern])
    if not ps.labels:
        return
    s = StreamSearch(ps)
    got = [h for c in chunks for h in s.feed(c)] + s.close()
    assert sorted((a, b) for a, b, _ in got) == finder(ps.labels[0])(b"".join(chunks))


def test_streams():
    ps = PatternSet.from_list(["mary", "lamb", "[a-z]+"], options=Options(case_insensitive=True))
    s = StreamSearch(ps)
    got = sorted([*s.feed(b"Mary had a little l"), *s.feed(b"amb"), *s.close()])
    assert [h for h in got if h[2] < 2] == [(0, 4, 0), (18, 22, 1)]
    assert (18, 22, 2) in got
    s = StreamSearch(PatternSet.from_list(["hijk"]))
    assert s.feed(b"abcdefghi") == [] and s.live == 7
    assert s.feed(b"jklmnopqr") == [(7, 11, 0)]
    assert search_resolve(b"aab aab", ps.labels[2], 2) == [(0, 3)]


def test_exploding_pattern_is_quick():
    assert hits(["(a+)+b"], "a" * 3000) == []


def test_samples_match():
    ps = PatternSet.from_list(["a(b|c)d*", "[0-9]{3}x?"])
    for s in tools.sample(ps, 50):
        assert any(re.fullmatch(emit.byte_regex(x.tree, x.enc_chain), s.encode()) for x in ps.labels)


def test_encase():
    assert [x.pattern for x in PatternSet.from_encase(["#+", "\\w0041*b"]).labels] == ["\\d{1,255}", "\\x{0041}{0,255}b"]


@pytest.mark.parametrize(("pattern", "text"), [("(a+)+b", "a"), ("(a|aa)*b", "a"), ("x[^y]*y", "x"), ("a.*z|a", "a"), (".*a.*b.*c", "a"), ("(a*b*)+c", "ab")])
def test_time_grows_with_the_bytes(pattern, text):
    """Twice the bytes take about twice the time, in values and in chunks."""
    label = PatternSet.from_list([pattern]).labels[0]

    def seconds(n):
        data = (text * n)[:n].encode()
        took = []
        for _ in range(3):
            began = time.perf_counter()
            whole = automaton.Machine(emit.program(label.tree, label.enc_chain)).find(data)
            s = StreamSearch(PatternSet.from_list([pattern]))
            parts = [h for i in range(0, n, 100) for h in s.feed(data[i : i + 100])] + s.close()
            took.append(time.perf_counter() - began)
            assert [(a, b) for a, b, _ in parts] == whole
        return min(took)

    seconds(1000)
    assert seconds(200_000) < 3 * seconds(100_000) < 15
    began = time.perf_counter()
    finder(label)((text * 100_000)[:100_000].encode())
    assert time.perf_counter() - began < 5


def test_state_is_bounded_by_the_program():
    s = StreamSearch(PatternSet.from_list(["x[^y]*y", "(ab|a)+c"]))
    sizes = []
    for _ in range(50):
        s.feed(b"x" + b"ab" * 500)
        sizes.append(len(s.state()))
    assert max(sizes) < 600


def test_engines_and_routes():
    assert [emit.cost(parse(p)) for p in ("abc", "[a-z]+,", "[a-z]+ing", "a.*b.*c", "(a+)+b", "(a|aa)*b", "(ab)+c", "er.{0,30}th")] == [0, 1, 1, 2, None, None, 1, 0]


def test_nested_byte_classes():
    for p in (r"[^b\z41]", r"[[^b\z41]]"):
        assert hits([p], "AB") == [(1, 2, 0)]
    assert hits([r"[\z41[^b\z41]]"], "ABb") == [(0, 1, 0), (1, 2, 0)]
    assert hits([r"[a-c--\z61]"], "abc") == [(0, 1, 0), (1, 2, 0), (2, 3, 0)]


def test_script_properties():
    """Scripts are the Unicode property, not the first word of names."""
    one = lambda p, cp: bool(sets.intersection(parse(p, Options(unicode=True)).points, sets.of(cp)))
    for cp in (0xAA, 0x2167, 0x212A):
        assert one(r"\p{Latin}", cp) and one(r"\p{Script=Latin}", cp) and not one(r"\P{Latin}", cp)
    assert one(r"\p{sc=Grek}", 0x3B1) and not one(r"\p{Greek}", 0x41)
