"""Quality classifier: naive Bayes support vectors (operator 4).

A text's features are indicators of hashed n-grams: three bytes, five character classes, and four flags of
whether a word repeats the one before it. Each indicator is scaled by the log ratio of its share in the two
classes (naive Bayes), each text's vector to length 1, and a linear hinge-loss model is fitted on these by dual
coordinate descent. A logistic curve through the margins of texts that the model was not fitted on turns
margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import crc_mod, hash_fraction, ship, tidy

#: log2 of the feature space; bounded training sample: rows of each label; passes and cost of the hinge-loss fit; smoothing of the counts.
BITS, SAMPLE_ROWS, PASSES, COST, SMOOTH = 18, 4000, 12, 1.0, 1.0
#: Characters of a text that are turned into features at once.
PIECE = 1 << 20

_SHAPE = np.full(256, 7, np.uint8)  # letters of other scripts
_SHAPE[: 0x20], _SHAPE[0x21:0x7F] = 1, 6
for _k, _chars in enumerate((b" ", b"\n\r\t", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"?()-")):
    _SHAPE[list(_chars)] = (0, 1, 2, 3, 4, 5)[_k]


def _fold(code: np.ndarray, kind: int) -> np.ndarray:
    """Hash codes of one kind of n-gram into the feature space."""
    x = (code.astype(np.uint32) + np.uint32(kind * 0x3C6EF372)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return (x >> np.uint32(32 - BITS)).astype(np.int32)


def _grams(b: np.ndarray) -> list[np.ndarray]:
    out = []
    if len(b) >= 3:
        w = b.astype(np.uint32)
        out.append(_fold((w[:-2] << 16) | (w[1:-1] << 8) | w[2:], 1))
    if len(b) >= 5:
        s = _SHAPE[b].astype(np.uint32)
        out.append(_fold((s[:-4] << 12) | (s[1:-3] << 9) | (s[2:-2] << 6) | (s[3:-1] << 3) | s[4:], 2))
    return out


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features of a whole text; feature 0 is in every text."""
    body = (text or "").encode()
    seen = np.zeros(1 << BITS, bool)
    seen[0] = True
    for lo in range(0, len(body), PIECE):
        for g in _grams(np.frombuffer(body[max(0, lo - 4) : lo + PIECE], np.uint8)):
            seen[g] = True
    words = body.split()
    if len(words) >= 5:
        flag = np.fromiter(map(bytes.__eq__, words, words[1:]), np.uint32, len(words) - 1)
        seen[_fold((flag[:-3] << 3) | (flag[1:-2] << 2) | (flag[2:-1] << 1) | flag[3:], 3)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """weight: of each indicator; ratio2: its squared scale, for a text's length; slope and shift of the logistic curve."""

    weight: np.ndarray
    ratio2: np.ndarray
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        return float(self.weight[f].sum() / np.sqrt(self.ratio2[f].sum()))

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -50, 50))))


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """log of (share of the indicator among label 1) / (among label 0), smoothed; feature 0 is the intercept (1)."""
    counts = np.full((2, 1 << BITS), SMOOTH)
    for f, y in zip(rows, label):
        counts[y, f] += 1
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    r[0] = 1.0
    return r


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = COST, passes: int = PASSES, seed: int = 3) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + cost * sum(max(0, 1 - y w.x)), one dual variable at a time; y: -1 or 1."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values])
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            new = min(max(alpha[i] - (y[i] * float(w[f] @ v) - 1) / square[i], 0.0), cost)
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                w[f] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if worst < 1e-3 * cost:
            break
    return w


def _logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve, by Newton steps with a small ridge."""
    x, b = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - label)) + 1e-2 * (b - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        b = b - np.linalg.solve(h, g)
    return float(max(b[0], 1e-3)), float(b[1])


def fit(rows: list[np.ndarray], label: np.ndarray, share_of_1: float) -> Model:
    """Fit on feature rows with labels 0/1; share_of_1: share of label 1 among all labelled rows."""
    size = 1 << BITS
    if len(rows) < 10 or len(set(label.tolist())) < 2:
        p = min(max(share_of_1, 0.01), 0.99)
        return Model(np.zeros(size), np.ones(size), 1.0, float(np.log(p / (1 - p))))
    held = np.arange(len(rows)) % 5 == 0
    ratio = log_count_ratios([r for r, h in zip(rows, held) if not h], label[~held])
    norm = [np.sqrt((ratio[f] ** 2).sum()) for f in rows]
    values = [ratio[f] / n for f, n in zip(rows, norm)]
    pick = np.flatnonzero(~held)
    w = dual_coordinate_descent([rows[i] for i in pick], [values[i] for i in pick], np.where(label[pick] == 1, 1.0, -1.0), size)
    model = Model(w * ratio, ratio**2, 1.0, 0.0)
    m, y = np.array([model.margin(rows[i]) for i in np.flatnonzero(held)]), label[held].astype(float)
    weight = np.where(y == 1, share_of_1 / max(y.mean(), 1e-9), (1 - share_of_1) / max(1 - y.mean(), 1e-9))
    model.slope, model.shift = _logistic(m, y, weight)
    return model


def _mapped(df: DataFrame, added: str, make) -> DataFrame:
    """Add one column (name and type), made from the features of ``text``."""
    place, (name, kind) = df.columns.index("text"), added.split(" ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                new = pa.array([work(features(t.as_py())) for t in part.column(place)], pa.float64() if kind == "double" else pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=[*part.schema.names, name])

    return df.mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added]))


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """Fit on a bounded sample of the labelled documents whose id satisfies ``usable``: up to SAMPLE_ROWS of each label, picked by the id's hash."""
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if not total:
        return fit([], np.zeros(0, int), 0.5)
    share = F.coalesce(*[F.when(F.col("quality") == k, F.lit(min(1.0, SAMPLE_ROWS / n))) for k, n in counts.items()])
    picked = rows.where(hash_fraction("doc_id") < share).orderBy(F.xxhash64("doc_id")).limit(4 * SAMPLE_ROWS)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded: 4 * SAMPLE_ROWS rows
    got = _mapped(sample, "f binary", lambda: np.ndarray.tobytes).select("doc_id", "quality", "f").collect()  # 32-bit feature numbers
    got.sort(key=lambda r: (r["doc_id"], bytes(r["f"])))
    return fit([np.frombuffer(r["f"], np.int32) for r in got], np.array([r["quality"] for r in got], int), counts.get(1, 0) / total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score`` (double, 0 to 1; higher: label 1 likelier), from the whole text alone.

    Null and empty texts are scored by the intercept. Equal texts get equal scores. Repeated rows stay; a column of
    this name is replaced, all others kept. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs.drop("quality_score"), "quality_score double", lambda: shared.value.score)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 3 is 1; labels never used), score, predicted (1 from 0.5 on).

    Documents without id are never held out and never learned from. Labels of ids that ``docs`` lacks, null labels and
    labels other than 0 and 1 are not learned from; of several labels of one id the largest counts. Without ten labelled
    documents, or without both labels, every text has the share of label 1 as its score (0.5 without labels). Null and
    empty texts, repeated rows, whole long texts and empty tables as in ``score``; other columns are not read.
    """
    ship(docs.sparkSession)
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    out = score(docs.select("doc_id", "text"), train(docs, labels, ~held))
    s = F.col("quality_score")
    return out.select("doc_id", held.alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
