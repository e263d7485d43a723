"""The operators against plain versions on small tables, with nulls, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from bytetrawl.llm import ann, crf, decontam, graph, html_tree, minhash, packing, quality, suffix, toxicity, warc
from bytetrawl.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, u int, key string"


def invented(r, n):
    return " ".join("".join(r.choice("an er the on ti re in ou le".split()) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    base = invented(r, 120)
    words = base.split()
    near = [" ".join(w if r.random() > 0.02 else "zz" for w in words) for _ in range(12)]
    out = [base, base, *near, "", None, "one two", "one two", "One  TWO\tthree four five six", invented(r, 3000), "é" * 400, "ab" * 300, invented(r, 50) + " " + base[:260]]
    return [(i, t, "en", "s", len(t or ""), "x", 1, "k") for i, t in enumerate(out)] + [(None, base, None, None, None, None, None, None), (0, base, "en", "s", 1, "x", 1, "k")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3)


# -- personal data


def plain_base(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and crf.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], crf.KINDS.index(s[2])))


def test_base_spans():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice(["a", "@", ".", "1", "25", "4", "+", " ", "-", "(", "é", "x.y@z.w", "1.2.3.4", "+1 (222) 555-1234", "4111111111111111"]) for _ in range(r.randint(0, 14)))
        assert crf.base_spans(t) == plain_base(t), t


def test_field():
    field = crf.trained_field()
    held = crf.labelled_sentences(150, 12345)
    texts = [" ".join(w for w, _ in s) for s in held]
    assert crf.field_spans(texts, field) == [[s for s in spans if re.search(r"[0-9@=+]|AKIA", t[s[0] : s[1]])] for t, spans in zip(texts, crf.field_spans(texts, field, whole=True), strict=True)]
    right = sum(len(crf.field_spans([t], field)[0]) == sum(a.startswith("B") for _, a in s) for t, s in zip(texts, held, strict=True))
    assert right > 0.85 * len(held)


def test_pii(spark, docs):
    got = crf.pii_spans(docs).collect()
    assert len(got) == docs.count() and all(g.base_sha256 == hashlib.sha256(b"").hexdigest() for g in got)
    one = spark.createDataFrame([(1, "mail bo@ex.org or +1 (269) 555-3296 4524132264652876 password=0030ef94f364d8386a", 5)], "doc_id long, text string, n_chars long")
    g = crf.pii_spans(one).first()
    assert (g.n_email, g.n_phone) == (1, 0) and "secret:" in g.spans and "phone:" in g.spans
    assert crf.redact(one).first().text.startswith("mail [EMAIL] or [PHONE] [CARD]")
    assert crf.redact(docs).columns == docs.columns and crf.redact(docs).count() == docs.count()


def test_pii_against_plain_version(spark):
    """Every column of the query but the field's own spans, on all documents and on odd ones."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (None, "a@b.c 1.2.3.4"), rows[0], (10**6 + 2, "x" * 300_000 + " 1.2.3.4 é@é a@b-c.de. 4111 1111-1111 1111 +49 (30) 123-4567 256.1.1.1 1.2.3.4.5 @a.b a@b"), (10**6 + 3, "0a" * 100_000)]
    got = crf.pii_spans(spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, spans string")).collect()
    want = []
    for doc_id, text in rows:
        base = plain_base(text or "")
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        want.append((doc_id, *(sum(k == kind for *_, k in base) for kind in crf.KINDS[:4]), hashlib.sha256(said.encode()).hexdigest(), {said for said in said.split(",") if said}))
    assert sorted((repr((g.doc_id, g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256)) for g in got)) == sorted(repr(w[:-1]) for w in want)
    by = {(w[0], w[5]): w[-1] for w in want}
    for g in got:
        all_spans = g.spans.split(",") if g.spans else []
        kept = by[g.doc_id, g.base_sha256]
        assert kept <= set(all_spans) and len(all_spans) - len(kept) == g.n_added
        places = [(int(s.split(":")[1]), int(s.split(":")[2])) for s in all_spans]
        assert places == sorted(places, key=lambda p: p[0]) or len(set(p[0] for p in places)) < len(places)
    assert sum(w[1] + w[2] + w[3] + w[4] for w in want) > 10
    assert crf.pii_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- packing


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    odd = ["İstanbul ΣΑΣ é <|endoftext|> x\x1cy", "don't 12½ «é»", "­ soft"]
    more = spark.createDataFrame([(100 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    many = spark.createDataFrame([(1000 + i, "the " * (7 * i % 900)) for i in range(400)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionAll(more).unionAll(many)
    want = {}
    for r in rows.collect():
        want.setdefault(r.doc_id, []).append([*t.encode(r.text or "", add_special_tokens=False).ids, 2])
    got = packing.packed_pieces(rows, word_tokenizer()).toPandas()
    by = {}
    for p in got.itertuples():
        by.setdefault(None if p.doc_id != p.doc_id else int(p.doc_id), []).append(p)
    assert set(by) == set(want)
    for k, parts in by.items():
        ids = want[k][0]
        assert sum(p.length for p in parts) == sum(map(len, want[k]))
        for p in parts:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids)
    for _, s in got.groupby("sequence_id"):
        at = 0
        for p in s.sort_values("offset").itertuples():
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.packed_pieces(rows.limit(0), word_tokenizer()).count() == 0


def test_nnls():
    r = np.random.default_rng(0)
    a, x = r.random((6, 10)), np.abs(r.standard_normal(10))
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


# -- WARC


def test_warc(spark):
    pages = [(i, f"http://h/{i}", h) for i, h in enumerate(["<p>a", "<p>b", "<p>a", "", None, "é" * 50])] + [(None, None, "<p>z"), (7, "u\r\nX: y", "<p>a")]
    got = warc.archived_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)
    by = {g.page_id: g for g in got}
    assert (by[0].record_type, by[0].refers_to) == ("revisit", 7) and (by[2].refers_to, by[7].record_type, by[3].refers_to) == (7, "response", 4)
    assert by[5].payload_bytes == 100 and by[5].payload_digest == base64.b32encode(hashlib.sha1(("é" * 50).encode()).digest()).decode()


def test_salvage():
    raw = [warc.record("response", i, "u", b"payload %d WARC/1.1\r\n" % i * 5, "X", None) for i in range(6)]
    packed = [warc.member(x) for x in raw]
    assert len(warc.salvage(b"".join(packed)).records) == 6
    for parts in (raw, packed):
        for hurt in range(6):
            bad = bytearray(parts[hurt])
            bad[len(bad) // 2] ^= 0x55
            data = b"".join([*parts[:hurt], bytes(bad), *parts[hurt + 1 :]])
            s = warc.salvage(data)
            assert {h["x-page-id"] for _, h, _ in s.records} == {str(i) for i in range(6) if i != hurt}
            at = sum(map(len, parts[:hurt]))
            assert s.gaps[0][0] == at and s.gaps[-1][1] == at + len(bad)
    assert warc.salvage(b"").records == [] and warc.salvage(b"junk").gaps == [(0, 4, "no version line")]
    assert warc.salvage(packed[0] + packed[1][:-9]).gaps[0][:2] == (len(packed[0]), len(packed[0]) + len(packed[1]) - 9)


def plain_archives(rows):
    top = {}
    for page_id, _, text in rows:
        if page_id is not None:
            top[text or ""] = max(top.get(text or "", page_id), page_id)
    out = []
    for page_id, _, text in rows:
        raw = (text or "").encode()
        last = top.get(text or "")
        again = last is not None and page_id != last
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


def test_archives_against_plain_version(spark, monkeypatch):
    """Also with null and clashing columns, repeated rows, ties, a payload that fills no archive by itself, and small archives."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    noise = random.Random(3)
    rows += [(10**6 + i, None, None) for i in range(50)] + [(2 * 10**6 + i, f"u {i}", "") for i in range(3)] + [rows[0], rows[1], (7 * 10**6, "x\r\ny", "é" * 9), (None, None, "no id")]
    rows.append((8 * 10**6, "long", "".join(chr(noise.randrange(0x20, 0x3000)) for _ in range(7 << 20))))  # a member of more than 16 MiB
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "page_id long, url string, html string, sha int, last int, payload int").repartition(5)
    want = plain_archives(rows)
    assert sorted((tuple(g) for g in warc.archived_pages(df).collect()), key=repr) == want
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    monkeypatch.setattr(warc, "MAPPED_BYTES", 1 << 14)
    assert sorted((tuple(g) for g in warc.archived_pages(df).collect()), key=repr) == want
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_damaged_archives(spark, tmp_path):
    """Damage costs the records that it touches, each stretch is logged, and a strict reader, which the query is, fails."""
    rows = [(i, f"http://h/{i}", invented(random.Random(i), 40)) for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    (file,) = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    raw = bytearray(file.read_bytes())
    intact = warc.read_archives(spark, f"{tmp_path}/w").orderBy("start").collect()
    starts, ids = [r.start for r in intact], [r.page_id for r in intact]
    assert sorted(ids) == list(range(60))
    for k in (5, 6, 30):
        raw[starts[k] + 40] ^= 0xFF
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0").write_bytes(raw[: starts[59] + 20])
    got = warc.read_archives(spark, f"{tmp_path}/d").orderBy("start").collect()
    whole = {i: t for i, _, t in rows}
    assert {g.page_id for g in got if g.kind == "record"} == {r for n, r in enumerate(ids) if n not in (5, 6, 30, 59)}
    assert all(g.payload.decode() == whole[g.page_id] for g in got if g.kind == "record")
    assert [(g.start, g.end) for g in got if g.kind == "gap"] == [(starts[5], starts[7]), (starts[30], starts[31]), (starts[59], starts[59] + 20)]
    with pytest.raises(Exception, match="Damaged"):
        warc.read_archives(spark, f"{tmp_path}/d", strict=True).count()


# -- repeated strings


def plain_repeats(raws, n=200):
    seen = {}
    for b in raws:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = []
    for b in raws:
        m = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                m[i : i + n] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~m].tobytes()
        out.append((len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix(spark, docs, texts, monkeypatch):
    r = random.Random(5)
    passage = invented(r, 60)
    more = [(500 + i, invented(r, 40) + passage[r.randint(0, 60) : len(passage) - r.randint(0, 60)] + invented(r, 30)) for i in range(40)] + [(600, "a" * 900), (601, "x" + "ab" * 150)]
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    all_rows = [(t[0], t[1]) for t in texts] + more
    want = sorted(map(repr, zip((i for i, _ in all_rows), plain_repeats([(t or "").encode() for _, t in all_rows]), strict=True)))
    for most in (2000, 3):
        monkeypatch.setattr(suffix, "MOST_BLOCKS", most)
        got = suffix.without_repeats(rows).collect()
        assert sorted(repr((g.doc_id, (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256))) for g in got) == want
    assert suffix.without_repeats(rows.limit(0)).count() == 0


def test_hot_anchors(spark):
    """A passage in more texts than a bucket may hold, with other bytes on both sides, some of them shared."""
    r = random.Random(9)
    passage = invented(r, 70)[:230]
    sides = [invented(r, 8) for _ in range(300)]
    rows = [(i, f"{r.choice(sides)} {i * 7919 % 10007} {passage} {i * 104729 % 10007} {r.choice(sides)}") for i in range(suffix.MOST_BLOCKS + 300)]
    got = sorted((g.doc_id, (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256)) for g in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    want = list(zip((i for i, _ in rows), plain_repeats([t.encode() for _, t in rows]), strict=True))
    assert got == want and all(g[1][1] >= 230 for g in got)


def test_halves():
    """The pieces of a block hold each of its strings once, and the bytes that they share."""
    text = bytes(random.Random(1).randrange(256) for _ in range(336))
    todo, seen = [(text, 0, 137, 136, 0, 136)], []
    while todo:
        block, first, strings, anchor, lo, hi = todo.pop()
        for low, high, shared, f, n, a, piece in suffix.halves(block, first, strings, anchor, lo, hi):
            assert piece == text[f : f + n + 199] and f + a == 136 and all(shared in text[i : i + 200] for i in range(f, f + n))
            if n == 1 and low == high:
                assert shared == piece
                seen.append(f)
            else:
                todo.append((piece, f, n, a, low, high))
    assert sorted(seen) == list(range(137))


def test_cover():
    for v in (8, 32, 64):
        c = suffix.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v))


# -- toxicity and quality


def test_kernel():
    def plain(a, b, p=3):
        def of(w):
            x = toxicity.symbols(w)
            out = {}
            for i in range(len(x)):
                for j in range(i + 1, min(len(x), i + toxicity.SPAN)):
                    for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                        key = x[i], x[j], x[k]
                        out[key] = out.get(key, 0) + toxicity.LAMBDA ** (k - i + 1)
            return out

        f, g = of(a), of(b)
        return sum(v * g.get(k, 0) for k, v in f.items()) / np.sqrt(sum(v * v for v in f.values()) * sum(v * v for v in g.values()))

    words = ["idiot", "id-iot", "idiots", "banana", "tidiou"]
    assert np.allclose(toxicity.kernel(words, words), [[plain(a, b) for b in words] for a in words], atol=1e-6)


def test_toxicity(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = invented(r, 30).split()
        if bad:
            w[r.randrange(30)] = r.choice(["blorgfax", "krumbad"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    rows += [(1000, "so b-lorg-fax now"), (1001, None), (1002, "k r u m b a d"), (1003, "so bloxrgfax now"), (None, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {g.doc_id: g for g in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 405 and all(0 <= g.score <= 1 for g in got.values())
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(400) if got[i].held_out]) > 0.95
    assert got[1000].predicted == got[1002].predicted == got[1003].predicted == 1 and got[1001].predicted == 0
    assert got[7].held_out == (zlib.crc32(b"7") % 5 == 0)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 405


def test_toxicity_sample(spark):
    """Only copies within a class count once; a word's few clean texts don't hide it."""
    r = random.Random(9)
    texts = [invented(r, 40) + " acommonlongword" for _ in range(30)]
    rows = [(i, f"{t} onemorelongword", i % 2) for i, t in enumerate(texts)] + [(100 + i, f"{texts[i]} onemorelongword", i % 2) for i in range(10)] + [(200, f"{texts[0]} onemorelongword", 1), (201, f"{texts[0]} onemorelongword", 1)]
    got = toxicity.without_copies(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).collect()
    assert sorted((g.text, g.toxic) for g in got) == sorted({(t, y) for _, t, y in rows})
    counts = pd.DataFrame([(invented(r, 1) + str(i), 1, 4) for i in range(300)] + [("blorgfax", 30, 1)], columns=["word", "n_toxic", "n_clean"])
    margins = toxicity.Scorer(*toxicity.fit_words(counts, 100, 400), np.zeros(3)).margins(["blorgfax", "banana"])
    assert margins[0] > 0 > margins[1]


def test_quality(spark):
    r = random.Random(4)
    rows = [(i, invented(r, 60) if i % 5 else " ".join(w + "%%%" for w in invented(r, 60).split()), "en", f"s{i % 7}", 300, "x") for i in range(500)] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, accepted string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 500, 2)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 501 and np.mean([g.accepted == (g.doc_id % 5 != 0) for g in got if g.doc_id is not None and g.doc_id % 2]) > 0.97
    assert quality.quality(docs, labels.limit(0)).where("accepted").count() == 501


# -- passages


def test_decontamination(spark, docs, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [(0, " ".join((texts[0][1] or "").split()[5:30])), (1, "ONE two"), (2, None), (3, "..."), (4, "not there at all"), (5, "one two")]
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for t in texts:
        w = words(t[1])
        hit, ids = set(), set()
        for k, own in wins.items():
            for at in range(len(w) - len(k) + 1):
                if tuple(w[at : at + len(k)]) == k:
                    hit.update(range(at, at + len(k)))
                    ids |= own
        s = ",".join(sorted(map(str, ids)))
        want.append((t[0], len(w), len(hit), len(ids), hashlib.sha256(s.encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in decontam.contamination(docs, bench).collect())
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    near = spark.createDataFrame([(1, "six then five words four or three in two one")], "doc_id long, text string")
    ask = spark.createDataFrame([(9, "one two three four five six")], "item_id long, text string")
    assert decontam.proximity_matches(near, ask, slop=6).count() >= 1 and decontam.phrase_matches(near, ask).count() == 0


# -- neighbours


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 24))
    x[40:60] = x[20]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (5080, [1.0]), (None, x[0].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own.score, s[own.vec_id], atol=1e-12)
        hit += len(set(want) & set(own.vec_id))
    assert hit > 0.9 * 75 * 20 and set(got.query_id) == set(range(0, 1500, 20))
    assert list(got[got.query_id == 20].sort_values("rank").vec_id)[:5] == [40, 41, 42, 43, 44]


def test_neighbours_of_several_dimensions(spark):
    """Each dimension is searched by itself; clashing columns and an empty table are borne."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.standard_normal(3 if i % 4 else 5)], "x", 1) for i in range(200)] + [(200, [], "x", 1), (201, None, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string, d int")
    got = {(g.query_id, g.rank): (g.vec_id, g.score) for g in ann.nearest(df).collect()}
    for q, v, *_ in rows:
        if q % 20 == 0 and v:
            own = sorted(((-float((np.array(v) * np.array(w)).sum()), i) for i, w, *_ in rows if i != q and w and len(w) == len(v)))[:20]
            assert [got[q, k + 1][0] for k in range(20)] == [i for _, i in own]
    assert ann.nearest(df.limit(0)).count() == 0


def test_error_bounds():
    r = np.random.default_rng(2)
    x, q, c = r.standard_normal((500, 64)), r.standard_normal((20, 64)), np.zeros(64)
    turn = ann.rotation(64)
    est, err = ann.estimates(*ann.codes(x, c, turn), c, q, turn)
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.99


# -- main text


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a>m</a></nav><div class='sidebar'>s</div><article><header><h1>H &amp;\n1</h1></header><p>a <b>b</b><br>c<p>d<script>x</script><div class=comments>no</div></article><aside>q</aside><footer>f"
    assert html_tree.main_text(html_tree.parse(page)) == "H & 1\n\na b c\n\nd"
    rows = [(i, f"http://h.org/{i}", f"<body><div id=x1>same words here</div><div><p>text {i}<p>more {i * 7}<p>end {i}</div></body>") for i in range(8)]
    rows += [(100, None, None), (101, "::bad::[", "<p>x"), (None, "http://h.org/z", ""), (102, "http://k.org", "plain")]
    got = {g.page_id: g for g in html_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "text 3\n\nmore 21\n\nend 3" and got[3].n_chars == len(got[3].text)
    assert (got[100].text, got[101].text, got[None].text, got[102].text) == ("", "x", "", "plain")


def test_article_of_near_copies(spark):
    """What stands in a marked article stays, in whatever container, and whatever stands around the article."""
    page = "<body><div class=a><article><p>start {0}<p>then {0}<p>more {0}<ul><li>one<li>two</ul><table><tr><td>cell</table></article></div><div class=b>{1}</div></body>"
    around = "<body><div class=a><article><p>all alike</article></div>{1}</body>"
    blocks = lambda i: "".join(f"<p>own {i} {k}" for k in range(8))
    rows = [(i, f"http://h.org/{i}", page.format(i, "")) for i in range(5)] + [(10 + i, f"http://k.org/{i}", around.format(i, blocks(i))) for i in range(5)]
    got = {g.page_id: g.text for g in html_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i].split("\n\n") == [f"start {i}", f"then {i}", f"more {i}", "one", "two", "cell"]
        assert got[10 + i] == "all alike"


def plain_extraction(rows):
    """The query by dictionaries: entropies of presentations and contents by host and path, times weights."""
    tree = {}
    for _, url, source in rows:
        if html_tree.host(url) and source:
            page = html_tree.parse(source, decode=False)
            for path, (style, content, weight) in html_tree.seen_once(page).items():
                tree.setdefault((html_tree.host(url), path), set()).add((style, content, weight, html_tree.near_key(page)))

    def entropy(values):
        n = len(values)
        return 1.0 if n < 2 else -sum(values.count(v) / n * math.log(values.count(v) / n, n) for v in set(values))

    low = set()
    for key, seen in tree.items():
        seen = list(seen)
        h = entropy([c for _, c, _, _ in seen])
        if any(s for s, *_ in seen):
            h = (h + entropy([s for s, *_ in seen])) / 2
        if sum(w for *_, w, _ in seen) / len(seen) * (len(seen) * h + html_tree.FREE) / (len(seen) + html_tree.FREE) < html_tree.IMPORTANCE - 1e-9:
            low.add(key)
    out = []
    for page_id, url, source in rows:
        h = html_tree.host(url)
        page = html_tree.parse(source or "")
        text = html_tree.main_text(page, frozenset(p for k, p in low if k == h) if h else None)
        out.append((page_id, url, text, len(text)))
    return sorted(out, key=repr), low


def test_html_against_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    r = random.Random(5)
    for i in range(60):  # a site without marked articles, with boxes that differ by section, and copies
        body = "".join(f"<p>{invented(r, 12)}</p>" for _ in range(r.randint(1, 6)))
        box = f"<div id=top><span>Section {i % 2}</span></div><div class=tools><ul><li>print<li>send</ul></div>loose words"
        rows += [(1000 + i, f"http://s.org/{i}", f"<body>{box}<div class=text>{body}</div><div class=more>{body if i % 3 else 'all'}</div></body>")] * (1 + (i == 7))
    rows += [(2000, None, "<nav>x</nav><p>y"), (2001, "http://e.org", None), (None, "http://s.org/1", "<p>z"), (2002, "http://s.org/long", "<div>" + "<p>long text " * 60_000)]
    df = spark.createDataFrame([(*x, "c", "d") for x in rows], "page_id long, url string, html string, host string, removed string").repartition(4)
    want, low = plain_extraction(rows)
    assert sorted((tuple(g) for g in html_tree.extracted(df).collect()), key=repr) == want
    got = {(g.host, g.path) for g in html_tree.low_importance(df).collect()}
    assert got == low and len(got) > 30
    assert html_tree.extracted(df.limit(0)).count() == 0
    text = {g[0]: g[2] for g in want}
    assert "print" not in text[1003] and "Section" not in text[1003] and "loose" not in text[1003] and text[1003]


def test_removal_is_by_the_tree(spark, monkeypatch):
    """Without branches of low importance, menus and adverts stay."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert html_tree.importance(pages).count() > 0
    usual = {g.page_id: g.n_chars for g in html_tree.extracted(pages).collect()}
    monkeypatch.setattr(html_tree, "IMPORTANCE", 0.0)
    whole = {g.page_id: g.n_chars for g in html_tree.extracted(pages).collect()}
    assert all(whole[k] > usual[k] for k in usual)


@pytest.mark.parametrize("wrapper", ["content no-sidebar", "site has-header-menu", "entry-content search-results"])
def test_wrappers_stay(wrapper):
    page = f"<body><div class='{wrapper}'><p>some text</p></div><div class=sidebar>no</div></body>"
    assert html_tree.main_text(html_tree.parse(page)) == "some text"
    inner = "<article><h1>t</h1><div class='post related'><p>kept</div><div class=related>no</div><section id=comments><article class=comment>no</article></section></article>"
    assert html_tree.main_text(html_tree.parse(inner)) == "t\n\nkept"
    assert html_tree.main_text(html_tree.parse(f"<div class='sidebar-layout'>{inner}<p>no</div>")) == "t\n\nkept"


# -- near-duplicates


def plain_groups(texts):
    sets = []
    for t in texts:
        w = (t[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = [t[0] for t in texts]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (ids[a], ids[b]) and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                up[max(x, y)] = min(x, y)
    return sorted(repr((i, len(s), None if i is None else find(i))) for i, s in zip(ids, sets, strict=True))


def test_near_duplicates(spark, docs, texts, monkeypatch):
    assert sorted(repr((g.doc_id, g.n_shingles, g.component_id)) for g in minhash.near_duplicates(docs).collect()) == plain_groups(texts)
    r = random.Random(8)
    words = invented(r, 150).split()
    many = [(i, " ".join(w if r.random() > 0.012 else "q" + str(r.randint(0, 5)) for w in words)) for i in range(150)]
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 100)
    df = spark.createDataFrame(many, "doc_id long, text string")
    assert sorted(repr((g.doc_id, g.n_shingles, g.component_id)) for g in minhash.near_duplicates(df).collect()) == plain_groups(many)
    shared = " ".join(words[:90])  # long lists of texts that share a passage, and copies among them
    mixed = [(i, shared + " " + invented(random.Random(i % 60), 10 + i % 60 * 2) + (" end" if i > 70 else "")) for i in range(110)]
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    assert sorted(repr((g.doc_id, g.n_shingles, g.component_id)) for g in minhash.near_duplicates(df).collect()) == plain_groups(mixed)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {g.node: g.component for g in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: up[x] for x in touched}


def test_few_words(spark):
    for n in range(8):
        text = " ".join("abcdefgh"[:n])
        assert [len(s) for s in minhash.shingle_sets([text])] == [max(1, n - 4) if n else 0], n
        assert minhash.shingle_sets([text, invented(random.Random(1), 9)])[0].tolist() == minhash.shingle_sets([text])[0].tolist()
    got = minhash.near_duplicates(spark.createDataFrame([(1, "two words")], "doc_id long, text string")).collect()
    assert [tuple(g) for g in got] == [(1, 1, 1, True)]
