"""Quality classifier by Bradley-Terry pairwise ranking.

The chance that document i is preferred to j is sigmoid(w (x_i - x_j)), with x the standardised rates of a text: its surface (lengths, marks, repetition,
case) and the odds of its words and of its neighbouring pairs (word_odds.py), so the order of words counts. Preferences are pairs of a document labelled good and one labelled bad; w minimises the logistic loss on their feature
differences with a small ridge, by Newton steps. A document is predicted good if w x is above a quantile of the
labelled documents' scores, the one at which most of their labels come out right. The score shown is the logistic
function of the distance from that threshold, its scale fitted to the labels.

Defined results: null and empty texts are scored like texts without words; without labels of both kinds every score is 0.5
and predicted 1; repeated rows are scored each; an empty table gives no rows; a very long text is scored from all of it, a text at a time in memory.
Only the id and the text are read, so further columns may have any names; drop_bad keeps them as they are.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodequery.llm.labelled import MOST_LABELS, held_out, labelled_rows
from lodequery.llm.shared import small_batches
from lodequery.llm.text_stats import FEATURES, counts_of, features
from lodequery.llm.word_odds import FOLDS, documents_with, means, odds_of

PAIRS, RIDGE, STEPS, SEED = 60_000, 1e-3, 40, 11
#: Standardised rates are cut here: one extreme document can't turn the fit.
FARTHEST = 5.0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def rates(texts: list[str | None], odds: np.ndarray) -> np.ndarray:
    """A row of inputs for each text: FEATURES and the two means of odds."""
    return np.hstack([features(counts_of(texts)), means(texts, odds)])


@dataclass
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    odds: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -FARTHEST, FARTHEST)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid((self.inputs(rates(texts, self.odds)) @ self.weights - self.threshold) / self.scale)


def learn_preferences(better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Weights from rows of which better[i] is preferred to worse[i]."""
    d = better - worse
    w = np.zeros(d.shape[1])
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + RIDGE / 2 * w @ w
    for _ in range(STEPS):
        p = sigmoid(-d @ w)
        grad = -(d * p[:, None]).mean(axis=0) + RIDGE * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w)), grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, labels: np.ndarray, odds: np.ndarray) -> Ranking | None:
    """From rows of inputs; None if a label is missing."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return None
    # Spread of the good documents, with a floor where they hardly vary.
    ranking = Ranking(x[good].mean(axis=0), np.maximum(x[good].std(axis=0), 0.02), np.zeros(x.shape[1]), odds)
    z, rng = ranking.inputs(x), np.random.default_rng(SEED)
    ranking.weights = learn_preferences(z[rng.choice(good, PAIRS)], z[rng.choice(bad, PAIRS)])
    s = z @ ranking.weights
    cuts = np.quantile(s, np.arange(0.0025, 1, 0.0025))
    right = np.array([((s >= c) == (labels == 1)).sum() for c in cuts])
    best = cuts[right == right.max()]
    ranking.threshold = float(best[len(best) // 2])
    # Smoothed targets: where the labels part cleanly, the scale doesn't shrink until all scores are 0 or 1.
    target = np.where(labels == 1, (len(good) + 1) / (len(good) + 2), 1 / (len(bad) + 2))
    scales = np.geomspace(0.05, 50, 60)
    losses = [(np.logaddexp(0, z) - target * z).mean() for z in ((s - ranking.threshold) / t for t in scales)]
    ranking.scale = float(scales[int(np.argmin(losses))])
    return ranking


def learn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = MOST_LABELS) -> Ranking | None:
    """A ranking fitted on at most ``most`` labelled rows; None if a label is missing. Two reads of them: one for the odds, one for the inputs."""
    small_batches(df.sparkSession)
    rows = labelled_rows(df, labels, id_col, text_col, label_col, most).withColumn("_fold", F.pmod(F.xxhash64(id_col), F.lit(FOLDS)))
    by_fold = documents_with(rows, text_col, "_label", "_fold")
    others = [odds_of(by_fold.sum(axis=0) - f) for f in by_fold]
    names = [f"x{i}" for i in range(len(FEATURES) + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, texts = np.zeros((b.num_rows, len(names))), b.column(0).to_pylist()
            for i, fold in enumerate(b.column(1).to_pylist()):
                x[i] = rates([texts[i]], others[fold])[0]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *map(pa.array, x.T)], ["_id", "_label", *names])

    taken = rows.select(text_col, F.col("_fold").cast("int"), F.col(id_col).alias("_id"), F.col("_label").cast("int").alias("_label"))
    inputs = taken.mapInArrow(run, StructType([StructField("_id", df.schema[id_col].dataType), StructField("_label", IntegerType()), *(StructField(n, DoubleType()) for n in names)]))
    found = inputs.orderBy(F.xxhash64("_id"), "_id", *names).limit(most).collect()
    x = np.array([[r[n] for n in names] for r in found]).reshape(-1, len(names))
    return fit(x, np.array([r["_label"] for r in found], np.int64), odds_of(by_fold.sum(axis=0)))


def score(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_on: DataFrame | None = None, keep: list[str] = (), most: int = MOST_LABELS) -> DataFrame:
    """id_col, the columns in keep, ``held_out``, ``score`` and ``predicted`` of every row."""
    ranking = learn(df if fit_on is None else fit_on, labels, id_col, text_col, label_col, most)
    cols = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5) if ranking is None else ranking.scores(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*cols, "score", "predicted"])

    fields = [*(df.schema[c] for c in cols), StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return df.select(text_col, *cols).mapInArrow(run, StructType(fields)).select(*cols, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def drop_bad(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_on: DataFrame | None = None, most: int = MOST_LABELS) -> DataFrame:
    """The rows of df that are predicted good, with all their columns."""
    ranking = learn(df if fit_on is None else fit_on, labels, id_col, text_col, label_col, most)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b if ranking is None else b.filter(pa.array(ranking.scores(b.column(at).to_pylist()) >= 0.5))

    return df.mapInArrow(run, df.schema)
