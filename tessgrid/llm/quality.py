"""Quality classifier: naive Bayes features in a linear support vector machine.

N-gram indicators are scaled by the log ratio of their counts in the two classes, and a hinge-loss model
is fitted to them by dual coordinate descent. Its margins become probabilities by a logistic fit to
documents it was not fitted on.

N-grams are taken over token shapes, not over words: letters of one case collapse to one sign, other
characters stay, a token that repeats the one before it is marked. An indicator says that a shape or a
pair of shapes occurs, or makes up at least a given share of the document. So the model reads layout,
symbols, capitals and repetition in any language, and needs few labels. A long token, such as prose of a
script without blanks, is read to its end as a row of short pieces, each of which counts as a token.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.llm.common import whole_text
from tessgrid.llm.workers import Memo, release, slices

#: Labelled rows the model is fitted on at most, by turns from each class in order of a hash of their id.
MAX_TRAINING_ROWS = 6000
FEATURES = 1 << 18
#: An indicator exists for occurring at all, and for each share of the tokens of a document.
SHARES = (0.02, 0.1, 0.3)
SMOOTHING, COST, ROUNDS, CALIBRATION_PART = 1.0, 0.1, 20, 4
THRESHOLD = 0.7
#: Tokens with a longer shape, or of more characters, are read as several.
LONGEST_SHAPE, LONGEST_TOKEN = 12, 64

SCORED = "doc_id long, score double"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label is learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


_RUNS = (
    (re.compile(r"[^\W\d_]+"), lambda m: _letters(m.group())),
    (re.compile(r"\d+"), lambda m: "0"),
    (re.compile(r"(.)\1{3,}", re.S), lambda m: m.group(1) * 3),
)


def _letters(run: str) -> str:
    if run.islower():
        return "a"
    if run.isupper():
        return "A" if len(run) > 1 else "I"
    return "Aa" if run[0].isupper() and run[1:].islower() else "aA"


def shape(token: str) -> str:
    for pattern, put in _RUNS:
        token = pattern.sub(put, token)
    return token


#: A long run counts once per 12 characters, so that its length is seen.
_UNITS = re.compile(r"(?P<word>[^\W\d_]{1,12}|\d{1,12})|(.)\2{3,11}|.", re.S)


def pieces(token: str) -> list[str]:
    """The token in parts that together are the token: cut where a word follows other characters, and
    before a shape would grow beyond LONGEST_SHAPE."""
    found, start, size, in_word = [], 0, 0, True
    for unit in _UNITS.finditer(token):
        word, more = unit["word"] is not None, len(shape(unit.group()))
        if size and (size + more > LONGEST_SHAPE or (word and not in_word)):
            found.append(token[start : unit.start()])
            start, size = unit.start(), 0
        size, in_word = size + more, word
    return [*found, token[start:]]


def shapes(token: str) -> tuple[str, ...]:
    """The shape of a token, or of each piece of a long one; a piece that repeats the one before is marked."""
    if len(token) <= LONGEST_TOKEN:
        whole = shape(token)
        if len(whole) <= LONGEST_SHAPE:
            return (whole,)
    parts = pieces(token)
    return tuple("=" * (i > 0 and part == parts[i - 1]) + shape(part) for i, part in enumerate(parts))


class Indicators:
    """Feature ids of a text, below FEATURES."""

    def __init__(self) -> None:
        self.shapes = Memo(shapes)
        self.ids = Memo(lambda key: xxhash.xxh3_64_intdigest(repr(key)) % FEATURES)

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        found = list(map(self.shapes.__getitem__, tokens))
        for i in range(len(tokens) - 1, 0, -1):
            if tokens[i] == tokens[i - 1]:
                found[i] = tuple("=" + s for s in found[i])
        told = list(chain.from_iterable(found))
        grams = Counter(told)
        grams.update(pairwise(told))
        ids, total = [], len(told)
        for gram, n in grams.items():
            ids.append(self.ids[gram, 0])
            for level, share in enumerate(SHARES, 1):
                if n < share * total or n < 2:
                    break
                ids.append(self.ids[gram, level])
        return np.unique(np.array(ids, np.int64))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    #: False where a class was absent: scores tell documents apart only if this holds.
    fitted: bool = True
    #: Scores of the rows learnt from.
    lowest: float = 0.0
    highest: float = 1.0

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum(dtype=np.float64)) + self.bias

    def score(self, ids: np.ndarray) -> float:
        at = self.slope * self.margin(ids) + self.offset
        return 1 / (1 + exp(-max(-30.0, min(30.0, at))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Per feature: log of its share among the indicators of class 1 over that among class 0."""
    counts = []
    for label in (1, 0):
        mine = [r for r, y in zip(rows, labels) if y == label]
        found = np.bincount(np.concatenate([*mine, np.zeros(0, np.int64)]), minlength=FEATURES)
        counts.append(found + SMOOTHING)
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def fit_hinge(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights per indicator (ratios folded in) and bias of the hinge-loss model. Dual coordinate descent:
    each step solves for one row's multiplier within [0, cost] and moves the weights along that row."""
    weights, bias = np.zeros(FEATURES), 0.0
    multipliers = np.zeros(len(rows))
    values = [ratios[r] for r in rows]
    norms = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)):
            ids, x = rows[i], values[i]
            slope = signs[i] * (weights[ids] @ x + bias) - 1
            new = min(max(multipliers[i] - slope / norms[i], 0.0), costs[i])
            step = (new - multipliers[i]) * signs[i]
            if step:
                multipliers[i] = new
                weights[ids] += step * x
                bias += step
    return (weights * ratios).astype(np.float32), bias


def fit_logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), with labels drawn in slightly from 0 and 1; Newton steps."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))])
    told = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(told @ x, -30, 30)))
        grad = x @ (weights * (p - goal)) + 1e-3 * told
        bend = (x * (weights * p * (1 - p) + 1e-9)) @ x.T + 1e-3 * np.eye(2)
        told = told - np.clip(np.linalg.solve(bend, grad), -5, 5)
    return float(max(told[0], 1e-6)), float(told[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, totals: dict[int, int] | None = None) -> Model:
    """A model for 0/1 labels. `totals` says how many rows of each class the sample stands for; without it,
    as many as there are. Only where a class is absent every text gets the share of 1."""
    n = np.bincount(labels, minlength=2)
    if n.min() == 0:
        share = (n[1] + 1) / (len(labels) + 2)
        return Model(np.zeros(FEATURES, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), False)
    # One in four of each class is set aside, the first at least; a lone row serves for both.
    place = np.where(labels == 1, np.cumsum(labels == 1), np.cumsum(labels == 0)) - 1
    aside = place % CALIBRATION_PART == 0
    learnt = ~aside | (n[labels] == 1)

    def trained(which: np.ndarray) -> tuple[np.ndarray, float]:
        mine = [r for r, use in zip(rows, which) if use]
        y = labels[which]
        # Classes weigh the same, however rare one is.
        costs = COST * len(y) / (2 * np.where(y == 1, max(1, y.sum()), max(1, len(y) - y.sum())))
        return fit_hinge(mine, np.where(y == 1, 1.0, -1.0), log_count_ratios(mine, y), costs)

    weights, bias = trained(learnt)
    margins = np.array([weights[r].sum() + bias for r, use in zip(rows, aside) if use])
    # Scores are chances among all labelled rows, whatever part of each class was drawn.
    stands_for = np.array([totals[0], totals[1]] if totals else n) / n
    each = (stands_for * len(labels) / (stands_for @ n))[labels[aside]]
    slope, offset = fit_logistic(margins, labels[aside], each)
    weights, bias = trained(np.ones(len(rows), bool))
    model = Model(weights, bias, slope, offset)
    scores = [model.score(r) for r in rows]
    model.lowest, model.highest = min(scores), max(scores)
    return model


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the labelled rows that may be learnt from. A document labelled more than once
    counts with its lowest label; null ids and labels are left out."""
    return (
        labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )


def training_rows(labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most `most` learnable rows, by turns from each class: a class with less than half of them comes
    whole, and the other fills the rest."""
    told, order = learnable(labels), (F.xxhash64("doc_id"), F.col("doc_id"))
    first = [told.where(F.col("quality") == k).orderBy(*order).limit(most) for k in (0, 1)]
    turn = F.row_number().over(Window.partitionBy("quality").orderBy(*order))
    both = first[0].unionByName(first[1]).withColumn("turn", turn)
    return both.orderBy("turn", "quality").limit(most).drop("turn")


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on a bounded sample of labelled documents; only their feature ids come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for part in slices(batches):
            found = [indicators.of(t).astype("<i4").tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["doc_id", "quality", "ids"])

    sample = F.broadcast(training_rows(labels, most))
    texts = docs.select("doc_id", whole_text().alias("text")).join(sample, "doc_id")
    rows = texts.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(run, "doc_id long, quality int, ids binary")
    # An id that several documents bear gives one row, so the bound holds.
    told = sorted(rows.groupBy("doc_id").agg(F.max("quality"), F.max("ids")).collect())
    told.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r[0])))
    totals = {int(r[0]): r[1] for r in learnable(labels).groupBy("quality").count().collect()}
    return fit([np.frombuffer(r[2], "<i4").astype(np.int64) for r in told], np.array([r[1] for r in told], np.int64), totals)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: how likely label 1 is, for every whole text. Null texts count as empty; an empty
    text scores by the bias alone. Ids may repeat or be null. Extra columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for part in slices(batches):
            scores = [model.score(indicators.of(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs, learn(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents the classifier accepts, all columns as they were: each row is judged by its own text.
    Where the labels do not tell documents apart all stay: where no label of one class can be learnt from,
    or where the rows learnt from do not score on both sides of the threshold, as with a handful of labels."""
    model = learn(docs, labels)
    if not model.fitted or not model.lowest < threshold <= model.highest:
        return docs
    text = docs.columns.index("text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for part in slices(batches):
            texts = part.column(text).to_pylist()
            yield part.filter(pa.array([model.score(indicators.of(t or "")) >= threshold for t in texts], pa.bool_()))
        indicators = None
        release()

    return docs.mapInArrow(judged, docs.schema)
