"""Benchmark passages in a corpus by a positional inverted index, in DataFrame operations only.

The index is a stored table of postings (document, position, term) of all corpus tokens that are test terms; others can stand in no
match. Each test window is probed by its rarest term, by its count in the index: a posting's position less the term's offset is where
the window would start. These lists are then intersected with the second rarest term's, adjusted by its offset, and what is left with
those of the window's other terms, all of which must stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small_side, written

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _OUTSIDE), lambda w: w != "")


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows as (window, items): all runs of size words of each item, or its words if they are fewer."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    runs = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return runs.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def stored_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (doc_id, text_hash, pos, id) of terms (term, id) in docs (doc_id, text_hash, text); pos counts all words from 0."""
    tokens = docs.select("doc_id", "text_hash", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    of = terms.select(F.col("term").alias("t"), "id")
    return written(tokens.join(small_side(of, F.octet_length("t")), F.col("term") == F.col("t")).select("doc_id", "text_hash", "pos", "id"), "postings")


def _windows_by_rarity(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """(win, items, length, at): windows that can occur, at: (count, offset, id) of their terms, the rarest first."""
    counts = index.groupBy("id").agg(F.count("*").alias("count"))
    of = windows.select("win", "items", F.size("window").alias("length"), F.posexplode("window").alias("offset", "term"))
    known = of.join(terms, "term").join(counts, "id")
    best = known.groupBy("win", "length").agg(F.sort_array(F.collect_list(F.struct("count", "offset", "id"))).alias("at"), F.first("items").alias("items"))
    return written(best.where(F.size("at") == F.col("length")), "windows")


def _numbered(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Test windows (win, window, items) and their terms (term, id); numbers are hashes, of terms too, so that no task numbers them all."""
    windows = test_windows(items, size).withColumn("win", F.xxhash64("window", F.size("window")))
    windows = written(windows, "test_windows")
    terms = windows.select(F.explode("window").alias("term")).distinct().withColumn("id", F.xxhash64("term"))
    return windows, written(terms, "terms")


def _same_place(start: Column, offset: Column) -> Column:
    """Whether a posting (q_...) is of the candidate's document and at start + offset."""
    return F.col("doc_id").eqNullSafe(F.col("q_doc")) & (F.col("text_hash") == F.col("q_hash")) & (start + offset == F.col("q_pos"))


def _candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, win, length, at) where a window's rarest term stands."""
    probes = windows.select("win", "length", "at", F.col("at")[0]["id"].alias("probe"), F.col("at")[0]["offset"].alias("offset"))
    found = index.join(small_side(probes, F.size("at") * 24), F.col("id") == F.col("probe"))
    return found.select("doc_id", "text_hash", (F.col("pos") - F.col("offset")).alias("start"), "win", "length", "at").where("start >= 0")


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Exact matches of test windows: doc_id, text_hash, start (word, from 0), length, items. Rows of docs that agree in doc_id and text are one."""
    with scratch():
        return written(_phrase_matches(docs, items, size), "matches", keep=True)


def _phrase_matches(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    windows, terms = _numbered(items, size)
    index = stored_index(keyed, terms)
    ranked = _windows_by_rarity(index, windows, terms)
    found = _candidates(index, ranked)
    postings = index.select(F.col("doc_id").alias("q_doc"), F.col("text_hash").alias("q_hash"), F.col("pos").alias("q_pos"), F.col("id").alias("q_id"))
    # The second rarest terms' lists are short too.
    second = ranked.where("length > 1").select(F.col("at")[1]["id"].alias("s")).distinct()
    seconds = postings.join(small_side(second, F.lit(8)), F.col("q_id") == F.col("s"), "left_semi")
    two = F.col("at")[1]
    longer = found.where("length > 1").join(seconds, _same_place(F.col("start"), two["offset"]) & (F.col("q_id") == two["id"]), "left_semi")
    # Repeated rows of docs have repeated postings.
    longer = longer.select("doc_id", "text_hash", "start", "win").distinct()
    longer = written(longer.join(small_side(ranked.select(F.col("win").alias("w"), "length", "at"), F.size("at") * 24), F.col("win") == F.col("w")).drop("w"), "candidates")
    held = longer.select(F.col("doc_id").alias("h_doc"), F.col("text_hash").alias("h_hash")).distinct()
    of_held = F.col("q_doc").eqNullSafe(F.col("h_doc")) & (F.col("q_hash") == F.col("h_hash"))
    postings = postings.join(small_side(held, F.lit(16)), of_held, "left_semi")
    # The other terms must all have a posting at their places; each place is asked for once.
    asked = longer.where("length > 2").select("doc_id", "text_hash", "start", "win", F.explode(F.slice("at", 3, size)).alias("x")).select("doc_id", "text_hash", (F.col("start") + F.col("x.offset")).alias("place"), F.col("x.id").alias("term_id"), "start", "win")
    there = asked.join(postings, _same_place(F.col("place"), F.lit(0)) & (F.col("q_id") == F.col("term_id")), "left_semi")
    agreed = there.groupBy("doc_id", "text_hash", "start", "win").agg(F.count("*").alias("rest"))
    whole = agreed.join(small_side(ranked.where("length > 2").select(F.col("win").alias("w"), "length", "items"), F.lit(64)), (F.col("win") == F.col("w")) & (F.col("rest") == F.col("length") - 2))
    short = found.where("length = 1").unionAll(longer.where("length = 2")).select("doc_id", "text_hash", "start", "win")
    short = short.join(ranked.select(F.col("win").alias("w"), "length", "items"), F.col("win") == F.col("w"))
    columns = ["doc_id", "text_hash", "start", "length", "items"]
    return whole.select(*columns).unionAll(short.select(*columns))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 5, size: int = WINDOW) -> DataFrame:
    """Windows whose words all stand within slop words more than the window's length of an occurrence of its rarest term: doc_id, text_hash, pos, window, items."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    windows, terms = _numbered(items, size)
    index = stored_index(keyed, terms)
    ranked = _windows_by_rarity(index, windows, terms)
    reach = size + slop - 1
    found = index.join(ranked.select("win", "at", F.col("at")[0]["id"].alias("probe")), F.col("id") == F.col("probe")).select("doc_id", "text_hash", "pos", "win", F.array_distinct("at.id").alias("ids"))
    # Postings within reach are in the stretch of the occurrence or in one next to it.
    stretch = F.floor(F.col("pos") / (reach + 1))
    asked = found.select("doc_id", "text_hash", "pos", "win", F.size("ids").alias("n"), F.explode("ids").alias("term_id"), stretch.alias("own"))
    asked = asked.withColumn("part", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    postings = index.select(F.col("doc_id").alias("q_doc"), F.col("text_hash").alias("q_hash"), F.col("pos").alias("q_pos"), F.col("id").alias("q_id"), stretch.alias("q_part"))
    near = F.col("doc_id").eqNullSafe(F.col("q_doc")) & (F.col("text_hash") == F.col("q_hash")) & (F.col("term_id") == F.col("q_id")) & (F.col("part") == F.col("q_part")) & (F.abs(F.col("pos") - F.col("q_pos")) <= reach)
    held = asked.join(postings, near, "left_semi").groupBy("doc_id", "text_hash", "pos", "win", "n").agg(F.count_distinct("term_id").alias("found")).where("found = n")
    return held.join(windows, "win").select("doc_id", "text_hash", "pos", "window", "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each row's doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    Null and empty texts have no words, and an empty table gives an empty one; long texts are searched whole; a null doc_id is kept; rows
    that agree in doc_id and text get the same result, each its own row; windows that several items share (ties) count for each; without
    items nothing is hit; other columns are left out and may have any name. Items with a null item_id mark words but aren't counted.
    """
    found = phrase_matches(docs.select("doc_id", "text"), items.select("item_id", "text"), size)
    spans = found.groupBy("doc_id", "text_hash", "start").agg(F.max("length").alias("length"), F.flatten(F.collect_set("items")).alias("items"))
    one = spans.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"), F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("items")), lambda i: i.cast("string")))).alias("ids")
    )
    one = one.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.size(F.array_distinct(F.flatten("at"))).cast("long").alias("hit"), "ids")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(one, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    ids = F.coalesce("ids", F.array().cast(T.ArrayType(T.StringType())))
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE = r"""
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS s, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT row_number() OVER () AS u, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT u, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT g.u, g.i, g.n, win.item_id FROM grams g JOIN win ON g.s = win.s AND g.n = win.n),
pos AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT u, i, n FROM hits)) GROUP BY u),
ids AS (SELECT u, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS s FROM hits GROUP BY u)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (u) LEFT JOIN ids USING (u)
"""
