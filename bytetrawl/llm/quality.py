"""Quality by co-training: a classifier over a text's content and one over its page's metadata teach each other.

Both views are logistic functions. In each round either view scores every unlabelled row of the table; of those that it is sure of, a
bounded sample by a hash, of each class, joins the other view's training rows. Each view is then calibrated by a logistic function of its
log odds, and the calibrated views are combined by another, fitted on labelled rows that neither view has learnt from.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, prepare, scratch, written
from .toxicity import logistic

#: At most so many labelled rows are learnt from, chosen by a hash of doc_id; and in each round so many rows that the other view is sure of.
LABELLED_ROWS, SURE_ROWS = 6000, 150
ROUNDS, SURE = 4, 0.95
#: Rows below this score are rejected.
THRESHOLD = 0.5
META = 40


def content(text: str) -> list[float]:
    """Shares of kinds of characters and words in a whole text; for no words, a fixed row."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, len(raw))
    c = np.bincount(raw, minlength=256) / n
    words = text.split()
    m = max(1, len(words))
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:])) / m
    lines = text.split("\n")
    symbols = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum() - c[44] - c[46] - c[39] - c[45]
    upper, lower = c[65:91].sum(), c[97:123].sum()
    return [
        upper,
        upper / (upper + lower + 1e-6),
        c[48:58].sum(),
        symbols,
        math.sqrt(max(symbols, 0)),
        c[124] * 10,
        c[33] * 10,
        (c[35] + c[36] + c[37] + c[38] + c[42]) * 10,
        c[44] + c[46],
        c[128:].sum(),
        c[0:9].sum() + c[14:32].sum(),
        repeats,
        distinct / m,
        (distinct / m) * (m > 50),
        math.log1p(m) / 10,
        math.log1p(m / max(1, distinct)),
        len(set(lines)) / max(1, len(lines)),
        min(n / m, 40) / 10,
        float(not words),
    ]


def metadata(lang: object, source: object, n_chars: object) -> list[float]:
    """Hashed language and source, and the order of the length that the page states."""
    out = [0.0] * (META + 3)
    for name, value in (("lang", lang), ("source", source)):
        out[zlib.crc32(f"{name}={value}".encode()) % META] = 1.0
    n = float(n_chars) if n_chars is not None and n_chars == n_chars else 0.0
    out[META] = math.log1p(max(n, 0)) / 10
    out[META + 1] = float(n < 100)
    out[META + 2] = float(n_chars is None or n_chars != n_chars)
    return out


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -20, 20)


class Model:
    """Two views, how each is calibrated, and how they are combined."""

    def __init__(self, views: list[np.ndarray], scale: list[tuple[np.ndarray, np.ndarray]], calibration: list[np.ndarray], mix: np.ndarray) -> None:
        self.views, self.scale, self.calibration, self.mix = views, scale, calibration, mix

    def score(self, parts: list[np.ndarray]) -> np.ndarray:
        z = [odds((x - m) / s, w) for x, w, (m, s) in zip(parts, self.views, self.scale, strict=True)]
        return 1 / (1 + np.exp(-odds(np.stack([odds(x[:, None], w) for x, w in zip(z, self.calibration, strict=True)], axis=1), self.mix)))


def _views(pdf: pd.DataFrame) -> list[np.ndarray]:
    """Both views of rows whose contents are known."""
    return [np.array(pdf["a"].tolist(), dtype=float).reshape(len(pdf), len(content(""))), np.array([metadata(a, b, c) for a, b, c in zip(pdf["lang"], pdf["source"], pdf["n_chars"], strict=True)]).reshape(len(pdf), META + 3)]


def _parts(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.array([content(t or "") for t in pdf["text"]]).reshape(len(pdf), -1), np.array([metadata(a, b, c) for a, b, c in zip(pdf["lang"], pdf["source"], pdf["n_chars"], strict=True)]).reshape(len(pdf), -1)]


#: Takes the views, their scales and the round; gives each view's pupil rows (features, label).
Picker = Callable[[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]], int], list[tuple[np.ndarray, np.ndarray]]]


def cotrain(known: list[np.ndarray], y: np.ndarray, pick: Picker) -> Model | None:
    """A model from rows with labels and a way to pick rows that a view is sure of, or None where the labels are all alike."""
    if len(y) < 4 or not 0 < y.sum() < len(y):
        return None
    scale = [(x.mean(axis=0), x.std(axis=0) + 1e-3) for x in known]
    known = [(x - m) / s for x, (m, s) in zip(known, scale, strict=True)]
    held = np.arange(len(y)) % 4 == 3
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        held = np.zeros(len(y), dtype=bool)
    xs = [x[~held] for x in known]
    ys = [y[~held].astype(float)] * 2
    views = [logistic(x, t, 1.0) for x, t in zip(xs, ys, strict=True)]
    for turn in range(ROUNDS):
        for pupil, (x, t) in enumerate(pick(views, scale, turn)):
            if len(t):
                m, s = scale[pupil]
                xs[pupil], ys[pupil] = np.vstack([xs[pupil], (x - m) / s]), np.r_[ys[pupil], t]
        views = [logistic(x, t, 1.0) for x, t in zip(xs, ys, strict=True)]
    rest = held if held.any() else ~held
    truth = y[rest].astype(float)
    z = [odds(x[rest], w) for x, w in zip(known, views, strict=True)]
    calibration = [logistic(x[:, None], truth, 0.5) for x in z]
    return Model(views, scale, calibration, logistic(np.stack([odds(x[:, None], w) for x, w in zip(z, calibration, strict=True)], axis=1), truth, 0.5))


_COLUMNS = ["doc_id", "lang", "source", "n_chars"]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from a bounded sample of labelled rows, and all unlabelled rows of docs."""
    with scratch():
        return _fit(docs, labels)


def _fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS).collect()
    if not rows:
        return None
    sample = docs.sparkSession.createDataFrame([(int(r.doc_id), int(r.quality)) for r in rows], "d long, quality int")

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            yield pdf[_COLUMNS].assign(a=[content(t or "") for t in pdf["text"]])

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"{c} {kind[c]}" for c in _COLUMNS) + ", a array<double>"
    every = written(docs.select(*_COLUMNS, "text").mapInPandas(contents, schema), "contents")
    # Repeated rows of a labelled document are one row, so that the sample stays bounded.
    labelled = every.join(F.broadcast(sample), F.col("doc_id") == F.col("d")).drop("d").dropDuplicates(["doc_id", "a", "lang", "source", "n_chars"])
    known = labelled.orderBy("doc_id", "a").limit(2 * LABELLED_ROWS).toPandas()
    free = written(every.join(lab.select(F.col("doc_id").alias("d")), F.col("doc_id") == F.col("d"), "left_anti"), "unlabelled")

    def pick(views: list[np.ndarray], scale: list[tuple[np.ndarray, np.ndarray]], turn: int) -> list[tuple[np.ndarray, np.ndarray]]:
        def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in filled(batches):
                parts = _views(pdf)
                out = []
                for teacher in (0, 1):
                    m, s = scale[teacher]
                    p = 1 / (1 + np.exp(-odds((parts[teacher] - m) / s, views[teacher])))
                    for label, found in ((1, p >= SURE), (0, p <= 1 - SURE)):
                        own = pdf[found].nsmallest(SURE_ROWS, "turn")
                        out.append(own.assign(pupil=1 - teacher, label=label))
                yield pd.concat(out)[[*_COLUMNS, "a", "turn", "pupil", "label"]]

        found = free.withColumn("turn", F.xxhash64("doc_id", "a", F.lit(turn))).mapInPandas(sure, f"{schema}, turn long, pupil int, label int")
        best = Window.partitionBy("pupil", "label").orderBy("turn")
        share = known["quality"].mean()
        most = F.when(F.col("label") == 1, max(1, int(SURE_ROWS * share))).otherwise(max(1, int(SURE_ROWS * (1 - share))))
        # Spark keeps the first rows of each group in every task before they are shuffled.
        ranked = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= SURE_ROWS)
        rows = ranked.where(F.col("place") <= most).orderBy("pupil", "label", "place").toPandas()
        return [(_views(own)[pupil], own["label"].to_numpy(dtype=float)) for pupil in (0, 1) for own in [rows[rows["pupil"] == pupil]]]

    return cotrain(_views(known), known["quality"].to_numpy(), pick)


def _scores(model: Model | None, pdf: pd.DataFrame) -> np.ndarray:
    return model.score(_parts(pdf)) if model else np.ones(len(pdf))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row's doc_id, score (0 to 1, higher: better) and accepted.

    Null texts count as empty and null metadata as a value of its own; whole texts of any length are read; a null doc_id is kept;
    repeated rows give repeated rows with the same score; without labels of both classes every row scores 1. Other columns are left out; an
    empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            s = _scores(model, pdf)
            yield pdf[["doc_id"]].assign(score=s, accepted=s >= THRESHOLD)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInPandas(score, f"doc_id {kind}, score double, accepted boolean")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with their own columns and no others."""
    prepare(docs.sparkSession)
    model = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scores(model, batch.select(["text", "lang", "source", "n_chars"]).to_pandas()) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
