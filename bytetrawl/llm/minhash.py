"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

Documents with equal shingle sets are one from the start. Each distinct set has a token for each (coordinate, value) of its
signature. Two sets that agree in at least k of COORDINATES coordinates share one of their COORDINATES - k + 1 rarest tokens, so only
these are posted (the prefix); tokens that a single set has make no list, and very frequent ones come last and are mostly skipped.

Members of a list are links' candidates. Shingles that no other posted set has can't be in an intersection, so sets with too many of them
are dropped, and pairs are bounded by what is left. In each round every list is held against one of its members, its hub: pairs that agree in
k coordinates are confirmed on full sets, and confirmed ones merge components. A list whose members are in one component is
done. What is left after ROUNDS is compared exactly, in blocks: members outside of a list's largest component with each other and with
that component. Members of one component are never compared, so a group of copies costs a row for each member and round.

The similarity threshold is an argument, in percent. k is derived from it, so that a pair at the threshold has fewer matches with a
chance below MISSED.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, fresh, mix64, prepare, scratch, segment_hashes, small_side, written
from .graph import components

SHINGLE, COORDINATES, MISSED = 5, 32, 1e-11
#: Rounds of hubs before what is left of the lists is compared in blocks.
ROUNDS = 2
#: Sets in a block, and rows that a task takes at once, on average.
BLOCK, BUCKET_ROWS = 256, 1000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of five words; of all its words if they are fewer."""
    out = []
    for at in range(0, len(texts), 200):
        out += _shingle_sets(texts[at : at + 200])
    return out


def _shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    word = ~space
    start = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(word & np.concatenate([space[1:], [True]])) + 1
    h = segment_hashes(data, start, end)
    limits = np.cumsum([len(r) + 1 for r in raw])
    first = np.searchsorted(start, np.concatenate([[0], limits[:-1]]))
    last = np.searchsorted(start, limits)
    n = len(h)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        c = mix64(np.array([k + 11], dtype=np.uint64))[0] | np.uint64(1)
        runs[: max(0, n - k)] += mix64(h[k:] * c)
    runs = mix64(runs)
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            few = np.uint64(b - a)
            for x in h[a:b]:
                few = mix64(np.array([few], dtype=np.uint64))[0] ^ x
            out.append(mix64(np.array([few], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each of COORDINATES functions."""
    x = s ^ (s >> np.uint64(29))
    out = np.empty(COORDINATES, dtype=np.uint64)
    for k in range(COORDINATES):
        y = x * _SEEDS[k]
        out[k] = (y ^ (y >> np.uint64(32))).min()
    return out


def matches(least: int) -> int:
    """The most coordinates that pairs of a similarity of least percent agree in but for a chance below MISSED."""
    p, missed = least / 100, 0.0
    for k in range(COORDINATES):
        missed += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if missed >= MISSED:
            return max(1, k)
    return COORDINATES


_WORDS = [f"s{i}" for i in range(COORDINATES // 8)]


def _sets_of(texts: pd.Series) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The shingle sets of texts, and a key of each that isn't empty."""
    sets = shingle_sets(list(texts))
    return sets, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (hash of the set, null if empty), s0 to s3 (a byte for each coordinate) and tokens (a hash for each)."""
    position = np.arange(1, COORDINATES + 1, dtype=np.uint64)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            rows = []
            sets, keys = _sets_of(pdf["text"])
            for s, key in zip(sets, keys, strict=True):
                if key is not None:
                    sig = signature(s)
                    rows.append((len(s), key, *mix64(sig).astype(np.uint8).view(np.int64).tolist(), mix64(sig + position * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)))
                else:
                    rows.append((0, None, *[0] * len(_WORDS), None))
            out = pd.DataFrame(rows, columns=["n_shingles", "key", *_WORDS, "tokens"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            out.insert(1, "text_hash", pdf["text_hash"])
            yield out

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(sketch, f"doc_id long, text_hash long, n_shingles long, key binary, {', '.join(f'{w} long' for w in _WORDS)}, tokens array<long>")


def _agreement(one: str, two: str) -> Column:
    """The number of coordinates that two rows' signatures agree in; one and two are prefixes of their columns."""
    total = F.lit(COORDINATES)
    for w in _WORDS:
        x = F.col(f"{one}{w}").bitwiseXOR(F.col(f"{two}{w}"))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        total = total - F.bit_count(x)
    return total


def _prefixes(sets: DataFrame, k: int) -> DataFrame:
    """(key, post, weight): each set under the tokens of its prefix that other sets have too; weight: how often its tokens occur."""
    tokens = sets.select("key", F.explode("tokens").alias("post"))
    shared = tokens.groupBy("post").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("post", "p")
    ranked = tokens.join(shared, F.col("post") == F.col("p")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("own"), F.sum("n").alias("weight"))
    # Tokens that no other set has are the rarest and take their places in the prefix.
    places = F.lit(COORDINATES - k + 1) - (F.lit(COORDINATES) - F.size("own"))
    return ranked.where(places > 0).select("key", "weight", F.explode(F.slice("own.post", F.lit(1), F.greatest(places, F.lit(1)))).alias("post"))


def _open_lists(posts: DataFrame, turn: int, least: int) -> DataFrame:
    """The rows of lists with members of more than one component that can still be linked; a list of two is done when its one pair was held against each other."""
    smallest = posts.groupBy(F.col("post").alias("p")).agg(F.min("size").alias("smallest"))
    partner = F.greatest("smallest", F.ceil(F.lit(least) * F.col("size") / 100))
    posts = posts.join(smallest, F.col("post") == F.col("p")).where(F.lit(100 + least) * F.col("usable") >= F.lit(least) * (F.col("size") + partner)).drop("p", "smallest")
    lists = posts.groupBy(F.col("post").alias("p")).agg(F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    return posts.join(lists.where("c0 <> c1" if not turn else "c0 <> c1 and n > 2").select("p"), F.col("post") == F.col("p"), "left_semi")


def _usable(full: DataFrame, least: int) -> DataFrame:
    """(key, size, usable) of the sets that can be linked: usable is the number of shingles that another of the full sets has too.

    No intersection is larger than usable, and it must be at least least percent of the set. Each shingle is counted once, however
    many sets share it, with map-side sums.
    """
    held = full.select("k0", "k1", F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.min("k0").alias("k0"), F.min("k1").alias("k1"))
    alone = held.where("n = 1").groupBy(F.col("k0").alias("a0"), F.col("k1").alias("a1")).agg(F.count("*").alias("alone"))
    sized = full.select("key", "k0", "k1", F.size("shingles").cast("long").alias("size")).join(alone, (F.col("k0") == F.col("a0")) & (F.col("k1") == F.col("a1")), "left")
    usable = F.col("size") - F.coalesce("alone", F.lit(0))
    return sized.select(F.col("key").alias("k"), "size", usable.alias("usable")).where(F.lit(100) * F.col("usable") >= F.lit(least) * F.col("size"))


def _can_meet(one: str, two: str, least: int) -> Column:
    """Whether sizes and usable shingles of two rows allow a link: least * union <= 100 * intersection; one and two are prefixes."""
    sizes = F.col(f"{one}size") + F.col(f"{two}size")
    both = F.least(f"{one}usable", f"{two}usable", f"{one}size", f"{two}size")
    return F.lit(100 + least) * both >= F.lit(least) * sizes


def _similar(least: int) -> Column:
    """Whether the sets in columns one and two are similar enough: least * union <= 100 * intersection."""
    both = F.size(F.array_intersect("one", "two"))
    return F.lit(100) * both >= F.lit(least) * (F.size("one") + F.size("two") - both)


def _confirmed(pairs: DataFrame, full: DataFrame, least: int) -> DataFrame:
    """The links (a, b) among pairs (a, b), by their full sets."""
    one = full.select(F.col("key").alias("k1"), F.col("shingles").alias("one"))
    two = full.select(F.col("key").alias("k2"), F.col("shingles").alias("two"))
    both = pairs.join(one, F.col("b") == F.col("k1")).join(two, F.col("a") == F.col("k2"))
    return both.where(_similar(least)).select("a", "b")


def _by_component(posts: DataFrame, links: DataFrame | None) -> DataFrame:
    """posts with the component of each key in the graph of links."""
    if links is None:
        return posts.withColumn("component", F.col("key"))
    found = components(links).withColumnRenamed("node", "k")
    return posts.join(found, F.col("key") == F.col("k"), "left").drop("k").withColumn("component", F.coalesce("component", "key"))


def _held_against_hubs(posts: DataFrame, turn: int, k: int, least: int) -> DataFrame:
    """Distinct pairs (a: hub, b) of lists' members with their list's hub, if in another component and agreeing in k coordinates.

    The hub is the member whose tokens are the most frequent, which is in the middle of a group; after the first turn, of those outside
    of the list's largest component.
    """
    of = posts
    if turn:
        parts = posts.groupBy("post", "component").agg(F.count("*").alias("n"))
        main = parts.groupBy(F.col("post").alias("p")).agg(F.max(F.struct("n", "component")).alias("most")).select("p", F.col("most.component").alias("main"))
        of = posts.join(main, F.col("post") == F.col("p")).where("component <> main").drop("p", "main")
    member = F.struct("weight", "key", "component", "size", "usable", *_WORDS)
    hubs = of.groupBy(F.col("post").alias("p")).agg(F.max(member).alias("hub")).select("p", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("key", "component", "size", "usable", *_WORDS)])
    near = (F.col("post") == F.col("p")) & (F.col("component") != F.col("hub_component")) & _can_meet("", "hub_", least) & (_agreement("", "hub_") >= k)
    return posts.join(hubs, near).select(F.col("hub_key").alias("a"), F.col("key").alias("b")).distinct()


def _in_blocks(posts: DataFrame) -> DataFrame:
    """posts with i and j: the pairs of blocks of its list that a member is in, and its own block.

    Members outside of a list's largest component are in blocks 0, 1, ..., those in it in blocks -1, -2, ...; pairs of two of the
    latter are left out.
    """
    parts = posts.groupBy("post", "component").agg(F.count("*").alias("n"))
    most = parts.groupBy(F.col("post").alias("p")).agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"))
    most = most.select("p", F.col("most.component").alias("main"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("inner"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int").alias("outer"))
    within = F.col("component") == F.col("main")
    turn = F.xxhash64("key", F.lit(-1))
    own = F.when(within, -1 - F.pmod(turn, F.col("inner"))).otherwise(F.pmod(turn, F.greatest(F.col("outer"), F.lit(1)))).cast("int")
    first = F.when(within, F.lit(0)).otherwise(-F.col("inner"))
    rows = posts.join(most, F.col("post") == F.col("p")).withColumn("block", own).withColumn("other", F.explode(F.sequence(first, F.col("outer") - 1)))
    return rows.select("post", "key", "component", "usable", *_WORDS, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def block_links(keys: np.ndarray, component: np.ndarray, sig: np.ndarray, usable: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, k: int, least: int) -> list[tuple]:
    """Links (a, b) between members of first and of second that are in different components, as a spanning forest of these."""
    up: dict = {}

    def root(x: object) -> object:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    sizes = np.array([len(s) for s in sets])
    every = np.concatenate([sets[y] for y in second])
    who = np.repeat(second, sizes[second])
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    out = []
    for x in first:
        most = np.minimum(np.minimum(usable[second], usable[x]), np.minimum(sizes[second], sizes[x]))
        near = second[((100 + least) * most >= least * (sizes[second] + sizes[x])) & (component[second] != component[x])]
        near = near[(sig[near] == sig[x]).sum(axis=1) >= k]
        near = [y for y in near if root(component[y]) != root(component[x])]
        if not near:
            continue
        lo, hi = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(who[at], minlength=len(sets))
        for y in near:
            if 100 * both[y] >= least * (sizes[x] + sizes[y] - both[y]) and root(component[y]) != root(component[x]):
                up[root(component[y])] = root(component[x])
                out.append((keys[x], keys[y]))
    return out


def _compared(pdf: pd.DataFrame, k: int, least: int) -> pd.DataFrame:
    """The links that block_links finds in each pair of blocks of a bucket."""
    keys = np.array([bytes(x) for x in pdf["key"]], dtype=object)
    component = np.array([bytes(x) for x in pdf["component"]], dtype=object)
    sig = pdf[_WORDS].to_numpy(dtype=np.int64).copy().view(np.uint8)
    sets = [np.sort(np.asarray(x, dtype=np.int64)) for x in pdf["shingles"]]
    block, i, j, usable = (pdf[c].to_numpy() for c in ("block", "i", "j", "usable"))
    out: set[tuple] = set()
    for rows in pdf.groupby(["post", "i", "j"], sort=False).indices.values():
        first, second = rows[block[rows] == j[rows]], rows[block[rows] == i[rows]]
        if len(first) and len(second):
            out.update(block_links(keys, component, sig, usable, sets, first, second, k, least))
    return pd.DataFrame(sorted(out), columns=["a", "b"])


def set_links(sets: DataFrame, docs: DataFrame, least: int) -> DataFrame | None:
    """Links (a, b) of the keys of sets whose graph has the components of all pairs that are similar enough; None if there are none.

    docs: (doc_id, text), with a text of each set under its least_id; texts of other sets are left out.
    """
    k = matches(least)
    posts = written(_prefixes(sets, k), "prefixes")
    wanted = posts.select(F.col("key").alias("k")).distinct()
    ids = sets.select("key", F.col("least_id").alias("id")).join(wanted, F.col("key") == F.col("k"), "left_semi")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            sets, got = _sets_of(pdf["text"])
            own = np.array([k == bytes(w) for k, w in zip(got, pdf["key"], strict=True)])  # an id can have other texts
            halves = np.frombuffer(b"".join(pdf["key"]), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"key": pdf["key"], "k0": halves[:, 0], "k1": halves[:, 1], "shingles": [s.view(np.int64) for s in sets]})[own]

    schema = "key binary, k0 long, k1 long, shingles array<long>"
    texts = docs.join(small_side(ids, 40), F.col("doc_id") == F.col("id")).select("key", "text")
    full_sets = written(texts.mapInPandas(full, schema), "full")
    if full_sets.count() > wanted.count():  # repeated rows
        full_sets = written(full_sets.groupBy("key").agg(*[F.first(c).alias(c) for c in ("k0", "k1", "shingles")]), "full")
    signatures = sets.select(F.col("key").alias("s"), *_WORDS)
    live = posts.join(_usable(full_sets, least), F.col("key") == F.col("k")).join(signatures, F.col("key") == F.col("s")).drop("k", "s")
    live = live.withColumn("component", F.col("key"))
    links = None
    for turn in range(ROUNDS + 1):
        live = written(_open_lists(live, turn, least), "live")
        if live.isEmpty():
            return links
        if turn == ROUNDS:
            break
        new = written(_confirmed(_held_against_hubs(live, turn, k, least), full_sets, least), "links")
        links = new if links is None else links.unionAll(new)
        live = _by_component(live.drop("component"), links)
    dealt = _in_blocks(live)
    buckets = max(1, live.count() // BUCKET_ROWS)
    dealt = dealt.join(full_sets.select(F.col("key").alias("k"), "shingles"), F.col("key") == F.col("k")).drop("k")
    last = dealt.withColumn("bucket", F.pmod(F.xxhash64("post", "i", "j"), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda pdf: _compared(pdf, k, least), "a binary, b binary")
    return links.unionAll(last)


def grouped(docs: DataFrame, least: int) -> DataFrame:
    """Each row's doc_id, text_hash, n_shingles, key of its set, group (the key of its set's component) and component_id."""
    prepare(docs.sparkSession)
    with scratch():
        return written(_grouped(docs, least), "grouped", keep=True)


def _grouped(docs: DataFrame, least: int) -> DataFrame:
    all_rows = written(sketches(docs), "sketches")
    some = all_rows.where("key is not null and doc_id is not null")
    first = [F.first(c).alias(c) for c in (*_WORDS, "tokens")]
    sets = written(some.groupBy("key").agg(F.min("doc_id").alias("least_id"), *first), "sets")
    links = set_links(sets, docs.where("doc_id is not null and text is not null").select("doc_id", "text"), least)
    by_set = sets.select(F.col("key").alias("k"), F.col("least_id").alias("set_component"), F.col("key").alias("group"))
    if links is not None:
        found = written(components(links).join(by_set.drop("group"), F.col("node") == F.col("k")).select("k", "component", "set_component"), "components")
        named = found.groupBy(F.col("component").alias("c")).agg(F.min("set_component").alias("least_id"))
        found = found.join(named, F.col("component") == F.col("c")).select("k", "least_id", "component")
        by_set = by_set.join(found, "k", "left").select("k", F.coalesce("least_id", "set_component").alias("set_component"), F.coalesce("component", "group").alias("group"))
    out = all_rows.join(by_set, F.col("key") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("set_component", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "key", "group", component.alias("component_id"))


def near_duplicates(docs: DataFrame, least: int = 85) -> DataFrame:
    """Each row's doc_id, n_shingles, component_id and kept; texts are linked from a similarity of least percent (2 to 100) on.

    Null texts and texts without words have no shingles and are linked with nothing: each is its own component. A null doc_id is
    linked with nothing either: its component_id is null and it is kept. Of tied (equal) texts and repeated rows the smallest doc_id
    is kept; rows with one doc_id and different texts are judged one by one. Texts of any length are read whole. Other columns are
    left out, and may have any name; an empty table gives an empty table.
    """
    return grouped(docs, least).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, least: int) -> DataFrame:
    """The rows of docs without near-duplicates: one of each group stays, with all its columns.

    It is the one with the smallest doc_id; of rows with that doc_id, the one with the smallest hash of its text, and of rows that
    agree in both, the first by their other columns as JSON. Rows without a doc_id, a text or words stay, each of them.
    """
    rows = grouped(docs, least).where("doc_id is not null and key is not null")
    chosen = rows.groupBy(F.col("group").alias("g")).agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    mark, ident, digest, at = fresh(docs, 4)
    judged = rows.join(chosen, F.col("group") == F.col("g")).withColumn("same", F.struct("doc_id", "text_hash") == F.col("one"))
    pair = [F.col("doc_id").alias(ident), F.col("text_hash").alias(mark)]
    kept = docs.withColumn(digest, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col(ident)) & (F.col(digest) == F.col(mark))
    repeated = written(judged.where("same").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(*pair), "repeated")
    dropped = written(judged.where("not same").select(*pair).distinct(), "dropped")
    kept = kept.join(small_side(dropped, 16), same, "left_anti")
    if not repeated.isEmpty():
        order = Window.partitionBy("doc_id", digest).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        several = kept.join(repeated, same, "left_semi").withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).drop(at)
        kept = kept.join(repeated, same, "left_anti").unionByName(several)
    return kept.drop(digest)


_SPACES = r"[\x20\x09-\x0D]+"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
kinds AS (SELECT list_sort(s) AS k, min(doc_id) AS node, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
one AS (SELECT node, n, unnest(k) AS x FROM kinds),
links AS (SELECT a.node AS a, b.node AS b FROM one a JOIN one b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM pairs UNION SELECT r.node, pairs.b FROM reach r JOIN pairs ON r.other = pairs.a),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(k.node, l.m), k.node, s.doc_id) AS component_id, s.doc_id = coalesce(least(k.node, l.m), k.node, s.doc_id) AS kept
FROM s LEFT JOIN kinds k ON list_sort(s.s) = k.k LEFT JOIN least l ON k.node = l.node
"""
