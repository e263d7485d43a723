"""The pipeline against its operators' plain meaning."""

import random
import zlib

import numpy as np
import pytest

from bytetrawl.llm import minhash, quality, stages
from bytetrawl.llm.queries import word_tokenizer


def test_pipeline(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = [r.doc_id for r in quality.quality(docs, spark.read.parquet(f"{data}/labels.parquet")).where("accepted").collect()]
    rows = docs
    kept = []
    for _, stage in P.STAGES[:-1]:
        rows = P.common.written(stage(spark, rows, data), "test")
        assert rows.columns == docs.columns
        kept.append([r.doc_id for r in rows.select("doc_id").collect()])
    assert sorted(kept[0]) == sorted(want)
    assert set(kept[1]) <= set(kept[0]) and set(kept[2]) <= set(kept[1]) and sorted(kept[3]) == sorted(kept[2])

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 2] for r in rows.select("doc_id", "text").collect()}
    got = P.run(spark, data).toPandas()
    assert set(got.doc_id) == set(ids)
    for p in got.itertuples():
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}


@pytest.mark.parametrize("block", [96, 8])
def test_near_duplicate_stage(spark, monkeypatch, block):
    """One document of each group that links of 0.8 or more make."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(6)
    docs, sets = [], []
    for _ in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for changes in (0, 2, 3, 4, 6):
            own = list(words)
            for at in r.sample(range(120), changes):
                own[at] = f"x{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(own), "s"))
            sets.append({tuple(own[i : i + 5]) for i in range(116)})
    up, between = list(range(len(docs))), 0
    alike = [(b, a, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(docs)) for b in range(a)]
    for b, a, s in alike:
        if s >= 0.8:
            between += s < 0.85
            up = [up[b] if x == up[a] else x for x in up] if up[b] < up[a] else [up[a] if x == up[b] else x for x in up]
    assert between >= 15
    got = stages.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), "").collect()
    assert sorted(g.doc_id for g in got) == sorted(set(up))


def test_matches():
    assert (minhash.matches(85), minhash.matches(80), minhash.matches(100)) == (10, 8, 32)


def test_stages_bear_anything(spark, tmp_path):
    """Clashing names, nulls, empty and long texts, repeated ids and rows, and empty tables."""
    import datetime

    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    r = random.Random(2)
    plain = " ".join(f"word{r.randrange(400)}" for _ in range(60))
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    extra = "kept_id long, hit_id long, text_hash long, score string, accepted string, own_0 int, OWN_1 int, key int, `a b` int, component_id date, node map<string,int>"
    more = (2**60 + 1, None, 7, "s", "no", 1, 2, 3, 4, datetime.date(2020, 1, 1), {"x": 1})
    rows = [
        (1, plain, "en", "s", 5),
        (1, plain, "en", "s", 4),  # repeated but for n_chars
        (1, plain, "en", "s", 5),
        (1, long, "en", "s", 5),  # another text with the id
        (2, plain + " end", "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (4, "", "en", "s", 0),
        (None, plain, "en", "s", 2**62 + 1),
        (5, "mail x.y@example.org x a b c d e f g h i j k y", "en", "s", 2**61 + 1),
    ]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    docs = spark.createDataFrame([x + more for x in rows], schema)
    for part in (docs, docs.limit(0)):
        for stage in (stages.accept_quality, stages.drop_near_duplicates, stages.drop_contaminated, stages.redact_personal_data):
            got = stage(spark, part, str(tmp_path))
            assert got.schema.simpleString() == docs.schema.simpleString()
            assert {tuple(g)[5:] and repr(tuple(g)[5:]) for g in got.collect()} <= {repr(more)}
    kept = sorted(((g.doc_id or 0, g.text or "", g.n_chars) for g in stages.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, plain, 4), (1, long, 5), (3, "", None), (4, "", 0), (4, "", 0), (0, plain, 2**62 + 1), (5, rows[-1][1], 2**61 + 1)], key=repr)
    assert sorted(repr(g.doc_id) for g in stages.drop_contaminated(spark, docs, str(tmp_path)).collect()) == sorted(repr(x[0]) for x in rows[:-1])
    clean = [g for g in stages.redact_personal_data(spark, docs, "").collect() if g.doc_id == 5 or g.doc_id is None]
    assert [(g.n_chars, "example" in g.text) for g in clean] == [(2**62 + 1, False), (len(clean[1].text), False)]
    assert stages.pack(spark, docs, "").groupBy().sum("length").first()[0] > 60_000 and stages.pack(spark, docs.limit(0), "").count() == 0
