"""Toxicity by a subsequence string kernel and a support vector machine with Nyström landmarks.

The kernel of two words sums, over their common subsequences of three characters, LAMBDA to the power of the lengths that the
subsequences span in either word; spans are at most SPAN, and the kernel is normalised. Inserted or gapped characters so lower
a match without ending it. Landmark words span the Nyström space in which the machine is fitted. As the fitted function is a
sum of kernels with landmarks, it equals one weight for each subsequence, by which words are scored without their kernels.
Runs of spaced single letters are joined to words first; words of one or two letters have no subsequence and say nothing.

The machine is trained on labelled texts, as bags of words: a text's margin is its highest word margin. In each round a toxic text is a
row by its word of the highest margin, and a clean text by its words of the highest margins and a random one, each text with the same
weight, until these words settle. The first round's margins come from a machine over words by how many toxic and clean texts hold them.
A text's score is a calibrated function of its highest word margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, prepare, scratch, written
from .minhash import near_duplicates

LAMBDA, SPAN, SYMBOLS, PIECE = 0.7, 6, 64, 24
#: At most so many labelled rows of each class are learnt from.
SAMPLE_ROWS = 1500
LANDMARKS = 160
#: Texts of one class from this similarity on, in percent, are copies that count as one text.
COPIES = 80
#: Rounds in which texts choose their words anew, and words by which a clean text is a row.
ROUNDS, CLEAN_WORDS = 5, 2
#: Words of either kind from which the first machine is fitted at most, and those of which variants with inserted letters are made.
FIRST_CLEAN, FIRST_TOXIC, VARIED = 6000, 1500, 400
#: A toxic word's share of the toxic texts is at least so many times its share of the clean ones.
RATIO = 20

_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?[]^_`{|}~¡¿«»“”’"
_SPACED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w){2,}(?!\w)")
#: Look-alikes, fixed values.
_FOLD = str.maketrans("01345$7@", "oieassta")
_TRIPLES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def symbols(word: str) -> list[int]:
    """Characters as small numbers: a to z, then others by code point."""
    return [ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SYMBOLS - 27) for c in word]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of each distinct subsequence of each word, with rows of length 1."""
    width = min(PIECE, max(map(len, words), default=0))
    x = np.zeros((len(words), width + SPAN), dtype=np.int64)
    for i, w in enumerate(words):
        x[i, : min(len(w), width)] = symbols(w[:width])
    ids, weights = [], []
    for a, b in _TRIPLES:
        first, second, third = x[:, :width], x[:, a : a + width], x[:, b : b + width]
        ids.append(np.where(third > 0, (first * SYMBOLS + second) * SYMBOLS + third, 0))
        weights.append(np.full((len(words), width), LAMBDA ** (b + 1)))
    ids, weights = np.concatenate(ids, axis=1), np.concatenate(weights, axis=1)
    rows, cols = np.nonzero(ids)
    key = rows * SYMBOLS**3 + ids[rows, cols]
    order = np.argsort(key, kind="stable")
    key, w = key[order], weights[rows, cols][order]
    if not len(key):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    w, key = np.add.reduceat(w, at), key[at]
    row = key // SYMBOLS**3
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(words)))
    return row, key % SYMBOLS**3, w / norm[row]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel of each word with each landmark."""
    r, f, w = subsequences(landmarks)
    held = np.unique(f)
    place = np.full(SYMBOLS**3, len(held), dtype=np.int32)  # the last row of the table is of no landmark
    place[held] = np.arange(len(held))
    table = np.zeros((len(held) + 1, len(landmarks)), dtype=np.float32)
    table[place[f], r] = w
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 250):
        r, f, w = subsequences(words[at : at + 250])
        if len(r):
            begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[at + r[begin]] = np.add.reduceat(table[place[f]] * w.astype(np.float32)[:, None], begin, axis=0)
    return out


def units(text: str) -> set[str]:
    """The distinct words of a text in the form that is scored."""
    low = text.lower()
    out = set(low.split())
    if " " in low and (spaced := _SPACED.findall(low)):
        out.update(re.sub(r"\W|_", "", s) for s in spaced)
    return out


def folded(word: str) -> list[str]:
    """A word without punctuation around it and with look-alikes as letters, in overlapping pieces if it is very long; and without punctuation within."""
    w = word.strip(_STRIP).translate(_FOLD)
    out = [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
    if not w.isalnum() and (bare := "".join(filter(str.isalnum, w))):
        out += [bare[i : i + PIECE] for i in range(0, max(1, len(bare) - PIECE // 2), PIECE // 2)]
    return out


class Scorer:
    """Margins of words and scores of texts."""

    def __init__(self, weights: np.ndarray, bias: float, platt: np.ndarray) -> None:
        self.weights, self.bias, self.platt = weights.astype(np.float32), bias, platt
        self.known: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        pieces, owner = [], []
        for i, w in enumerate(words):
            for p in folded(w):
                if len(p) > 2:
                    pieces.append(p)
                    owner.append(i)
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            r, f, w = subsequences(part)
            m = np.bincount(r, self.weights[f] * w, minlength=len(part)) + self.bias
            np.maximum.at(out, owner[at : at + 4000], m)
        return out

    def highest(self, texts: list[str]) -> np.ndarray:
        """The two highest margins of each text's distinct words."""
        bags = [units(t) for t in texts]
        new = list(set().union(*bags).difference(self.known)) if bags else []
        if len(self.known) > 400_000:
            self.known.clear()
            new = list(set().union(*bags))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, self.margins(part).tolist(), strict=True))
        out = np.full((len(texts), 2), self.bias)
        for i, bag in enumerate(bags):
            if bag:
                m = [self.known[w] for w in bag]
                best = max(m)
                out[i, 0] = best
                m.remove(best)
                out[i, 1] = max(m, default=self.bias)
        return out

    def scores(self, highest: np.ndarray) -> np.ndarray:
        z = np.clip(highest @ self.platt[:2] + self.platt[2], -30, 30)
        return 1 / (1 + np.exp(-z))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss by Newton steps; the last column of x is for the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xs, c = x[on], cost[on]
        new = np.linalg.solve(np.eye(x.shape[1]) * 0.1 + (xs * c[:, None]).T @ xs, (xs * c[:, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic function with a bias, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return w


def _with_insertion(word: str, rng: np.random.Generator) -> str:
    """A word with one more letter within."""
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + chr(97 + int(rng.integers(26))) + word[at:]


def fit_words(counts: pd.DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, float]:
    """The weight of each subsequence and the bias, from words with the numbers of toxic and clean texts that hold them, and the numbers of all such texts."""

    def toxic(c: list[int]) -> bool:
        return c[0] > 0 and c[0] * n_clean >= RATIO * c[1] * n_toxic

    by: dict[str, list[int]] = {}
    for w, a, b in zip(counts["word"], counts["n_toxic"], counts["n_clean"], strict=True):
        for p in folded(w):
            if len(p) > 2:
                c = by.setdefault(p, [0, 0])
                c[0] += int(a)
                c[1] += int(b)
    grams: dict[str, list[int]] = {}
    for w, (a, b) in by.items():
        for g in {w[i : i + 4] for i in range(max(1, len(w) - 3))}:
            c = grams.setdefault(g, [0, 0])
            c[0] += a
            c[1] += b
    least = max(3, n_toxic // 100)
    words = sorted(by)
    strength = np.array([max((grams[w[i : i + 4]][0] for i in range(max(1, len(w) - 3)) if toxic(grams[w[i : i + 4]])), default=0) if toxic(by[w]) else 0 for w in words])
    rng = np.random.default_rng(5)
    good = np.flatnonzero(strength >= least)
    weights, bias = np.zeros(SYMBOLS**3), -1.0
    if not len(good):
        return weights, bias
    for _ in range(2):
        clean = np.array([i for i, w in enumerate(words) if not toxic(by[w])], dtype=int)
        bad = rng.permutation(clean)[:FIRST_CLEAN] if len(clean) else clean
        good = good[np.argsort(-np.array([by[words[i]][0] for i in good]), kind="stable")][:FIRST_TOXIC]
        marks = [words[i] for i in [*good[: LANDMARKS // 2], *bad[: LANDMARKS // 2]]]
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        spread = [_with_insertion(words[i], rng) for i in good[:VARIED] for _ in range(2)]
        x = kernel([*(words[i] for i in good), *spread, *(words[i] for i in bad)], marks) @ root
        n_good = len(good) + len(spread)
        y = np.r_[np.ones(n_good), -np.ones(len(bad))]
        cost = np.r_[np.full(n_good, 20 / n_good * 100), np.full(len(bad), 20 / max(1, len(bad)) * 300)]
        fit = squared_hinge(np.hstack([x, np.ones((len(x), 1))]), y, cost)
        alpha, bias = root @ fit[:-1], float(fit[-1])
        r, f, w = subsequences(marks)
        weights = np.bincount(f, alpha[r] * w, minlength=SYMBOLS**3)
        own = Scorer(weights, bias, np.zeros(3)).margins(words)
        good = np.array([i for i in range(len(words)) if own[i] > 0 and toxic(by[words[i]])], dtype=int)
        if not len(good):
            break
    return weights, bias


def pieces(text: str) -> list[str]:
    """The distinct pieces of words of a text that can be scored, in order."""
    return sorted({p for u in units(text) for p in folded(u) if len(p) > 2})


def fit_texts(bags: list[list[str]], y: np.ndarray) -> tuple[np.ndarray, float]:
    """The weight of each subsequence and the bias, from texts as bags of pieces, and their labels (1: toxic)."""
    y = np.asarray(y)
    n_toxic, n_clean = int((y == 1).sum()), int((y == 0).sum())
    words = sorted(set().union(*bags)) if bags else []
    place = {w: i for i, w in enumerate(words)}
    flat = np.array([place[w] for bag in bags for w in bag], dtype=np.int64)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    held = np.stack([np.bincount(flat[y[owner] == v], minlength=len(words)) for v in (1, 0)], axis=1) if len(flat) else np.zeros((0, 2), dtype=int)
    weights, bias = fit_words(pd.DataFrame({"word": words, "n_toxic": held[:, 0], "n_clean": held[:, 1]}), n_toxic, n_clean)
    if not weights.any() or not n_clean:
        return weights, bias
    likely = held[:, 0] * n_clean >= RATIO * held[:, 1] * n_toxic
    rng = np.random.default_rng(6)
    before: np.ndarray | None = None
    best_fit, best_share = (weights, bias), -1.0
    for _ in range(ROUNDS + 1):
        margin = Scorer(weights, bias, np.zeros(3)).margins(words)
        # The round that tells the labelled texts apart best is kept.
        top = np.full(len(bags), bias)
        np.maximum.at(top, owner, margin[flat])
        share = (top[y == 1] > 0).mean() + (top[y == 0] <= 0).mean()
        if share > best_share:
            best_fit, best_share = (weights, bias), share
        # Of each text its words from the highest margin on; ties by the word.
        order = np.lexsort((flat, -margin[flat], owner))
        first = np.searchsorted(owner[order], np.arange(len(bags)))
        full = np.array([len(b) for b in bags])
        best = flat[order[np.minimum(first, len(order) - 1)]]
        # A word that clean texts hold about as often doesn't make its text toxic.
        toxic = np.flatnonzero((y == 1) & (full > 0) & likely[best] & (margin[best] > bias))
        witness = best[toxic]
        if not len(witness) or before is not None and np.array_equal(before, witness):
            break
        before = witness
        rows, cost = [words[i] for i in witness], [1.0] * len(witness)
        for i in witness:
            rows += [_with_insertion(words[i], rng), _with_insertion(words[i], rng)]
            cost += [0.5, 0.5]
        n_good = len(rows)
        for k in np.flatnonzero((y == 0) & (full > 0)):
            own = [*flat[order[first[k] : first[k] + min(CLEAN_WORDS, full[k])]], flat[order[first[k] + rng.integers(full[k])]]]
            rows += [words[i] for i in own]
            cost += [1 / len(own)] * len(own)
        if len(rows) == n_good:
            break
        cost = np.array(cost)
        cost[:n_good] *= 2000 / cost[:n_good].sum()
        cost[n_good:] *= 6000 / cost[n_good:].sum()
        chosen, often = np.unique(witness, return_counts=True)
        marks = [words[i] for i in chosen[np.argsort(-often, kind="stable")][: LANDMARKS // 2]]
        clean = sorted(set(rows[n_good:]).difference(marks))
        marks += [clean[i] for i in rng.permutation(len(clean))[: LANDMARKS - len(marks)]]
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        x = kernel(rows, marks) @ root
        fit = squared_hinge(np.hstack([x, np.ones((len(x), 1))]), np.r_[np.ones(n_good), -np.ones(len(rows) - n_good)], cost)
        alpha, bias = root @ fit[:-1], float(fit[-1])
        r, f, w = subsequences(marks)
        weights = np.bincount(f, alpha[r] * w, minlength=SYMBOLS**3)
    return best_fit


def without_copies(texts: DataFrame) -> DataFrame:
    """text and toxic of one row of each group of copies and near copies in a class; copies would pass for evidence from many texts."""
    rows = written(texts.select(F.xxhash64("doc_id", "text").alias("row"), "text", "toxic"), "sample")
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), COPIES).select(F.col("doc_id").alias("r"), "component_id").distinct()
    return written(rows.join(groups, F.col("row") == F.col("r")).groupBy("component_id", "toxic").agg(F.min_by("text", "row").alias("text")).select("text", "toxic"), "distinct")


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from labelled rows; what is written on the way is gone afterwards."""
    with scratch():
        return _fit(docs, labels)


def _fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from labelled rows outside the held-out fold, at most SAMPLE_ROWS of each class, chosen by a hash of doc_id."""
    lab = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 != 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [lab.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for v in (0, 1)]
    chosen = {int(r.doc_id): int(r.toxic) for r in parts[0].unionAll(parts[1]).collect()}  # at most twice SAMPLE_ROWS rows
    spark = docs.sparkSession
    if not chosen:
        return Scorer(np.zeros(SYMBOLS**3), -1.0, np.array([0.0, 0.0, -3.0]))
    sample = spark.createDataFrame(list(chosen.items()), "doc_id long, toxic int")
    texts = without_copies(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            yield pd.DataFrame({"toxic": pdf["toxic"], "text": [" ".join(pieces(t)) for t in pdf["text"]]})

    bags = texts.mapInPandas(words, "toxic int, text string").orderBy("toxic", "text").toPandas()  # at most twice SAMPLE_ROWS rows
    weights, bias = fit_texts([t.split(" ") if t else [] for t in bags["text"]], bags["toxic"].to_numpy())
    scorer = Scorer(weights, bias, np.zeros(3))

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            h = scorer.highest(list(pdf["text"]))
            yield pd.DataFrame({"a": h[:, 0], "b": h[:, 1], "y": pdf["toxic"].to_numpy()})

    m = texts.mapInPandas(margins, "a double, b double, y int").toPandas()
    y = m["y"].to_numpy(dtype=float)
    platt = logistic(m[["a", "b"]].to_numpy(), y) if 0 < y.sum() < len(y) else np.array([0.0, 0.0, -3.0])
    scorer.platt = platt
    return scorer


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row's doc_id, held_out, score and predicted.

    A null or empty text scores as a text without words. A null doc_id is kept and is not held out. Repeated rows give repeated
    rows, other columns are left out, empty tables give an empty table, and long texts are scored whole. Without labels of both
    classes every score is low.
    """
    prepare(docs.sparkSession)
    scorer = fit(docs, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            s = scorer.scores(scorer.highest([t or "" for t in pdf["text"]]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "score": s, "predicted": (s >= 0.5).astype(int)})

    out = docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
