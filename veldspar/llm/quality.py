"""Quality classifier: Bradley-Terry scores learnt from preference pairs."""

from __future__ import annotations

import math
import operator
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import held_out, table

FEATURES = (
    "log_words", "word_length", "upper", "marks", "digits", "variety", "adjacent_repeats", "marked_words",
    "mark_only_words", "upper_words", "short_words", "pair_repeats", "same_word",
)
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SPACE = b" \t\n\v\f\r"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-")
#: Bounds of what is learnt from: labelled rows, taken in the order of a hash of their id, and pairs of them.
SAMPLE_ROWS, PAIRS = 20_000, 200_000


def features(text: str | None) -> list[float]:
    """Shape of a whole text; a text without words gives zeros."""
    raw = text.encode() if isinstance(text, str) else b""
    ws = raw.split()
    n = len(ws)
    if not n:
        return [0.0] * len(FEATURES)
    solid = len(raw) - sum(map(raw.count, (bytes([c]) for c in SPACE)))
    count = lambda kind: (len(raw) - len(raw.translate(None, kind))) / solid
    kinds = Counter(ws)
    marked = {w for w in kinds if len(w) > 2 and w[-1] in MARKS and w[-2] in MARKS}
    bare = {w for w in kinds if w[0] in MARKS and not w.strip(MARKS)}
    loud = {w for w in kinds if len(w) > 1 and w.isupper()}
    few = marked | bare | loud
    share = dict.fromkeys(few, 0)
    if few:
        for w in ws:
            if w in share:
                share[w] += 1
    pairs = max(1, n - 1)
    return [
        math.log1p(n), solid / n, count(UPPER), count(MARKS), count(DIGITS), math.log1p(len(kinds)) / math.log1p(n),
        sum(map(operator.eq, ws, ws[1:])) / pairs, sum(share[w] for w in marked) / n, sum(share[w] for w in bare) / n,
        sum(share[w] for w in loud) / n, sum(len(w) <= 3 for w in ws) / n, 1 - len(set(zip(ws, ws[1:], strict=False))) / pairs,
        (sum(map(operator.mul, kinds.values(), kinds.values())) - n) / (n * pairs),  # chance that two words are the same
    ]


def _features(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def feature_column(text: Column) -> Column:
    return F.pandas_udf(_features, "array<double>")(text)


class Ranking:
    """Score of a document: w.x; the threshold is a quantile of the scores learnt from."""

    def __init__(self, w: np.ndarray, threshold: float, scale: float):
        self.w, self.threshold, self.scale = w, threshold, scale

    def score(self, x: Column, cutoff: float = 0.7) -> Column:
        """0 to 1; ``cutoff`` at the threshold, and a logistic of the Bradley-Terry score around it."""
        s = sum((F.get(x, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(self.w)), F.lit(0.0))
        z = (s - F.lit(self.threshold)) * F.lit(self.scale) + F.lit(math.log(cutoff / (1 - cutoff)))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 11) -> Ranking:
    """Weights by logistic loss on feature differences of (better, worse) pairs, by Newton steps.

    The threshold is the quantile of the scores at the share of worse rows. With one class
    only, all weights are zero and every score equals the cutoff.
    """
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(k), 0.0, 1.0)
    spread = x.std(0)
    spread[spread < 1e-9] = 1
    rng = np.random.default_rng(seed)
    d = (x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]) / spread
    w = np.zeros(k)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(k), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w = w / spread
    s = x @ w
    low, high = np.quantile(s, [max(0, len(bad) - 1) / len(s), min(1, (len(bad) + 1) / len(s))])
    return Ranking(w, float((low + high) / 2), 1.0)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Ranking:
    """Ranking from at most ``rows`` labelled documents whose labels may be learnt from.

    An id that several rows share counts once, with the smallest of their features.
    """
    ship(docs.sparkSession)
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).alias("y")).withColumn("h", F.xxhash64("_id")).orderBy("h", "_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(told), F.col("doc_id") == F.col("_id"))  # at most ``rows`` ids
    sample = sample.select("y", "h", "_id", feature_column(F.col("text")).alias("x")).groupBy("y", "h", "_id").agg(F.min("x").alias("x")).toPandas().sort_values(["h", "_id"])
    return bradley_terry(np.array(sample["x"].tolist(), float), sample["y"].to_numpy())


def rate(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``.

    Learnt from ``labels`` (doc_id, quality) without the rows held out; repeated labels of
    one id count once, as the worst. Null and blank texts have zero features and the score
    these give. Rows with a null id are scored too and never held out.
    """
    ranking = learn(docs, labels, rows=rows)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), feature_column(F.col("text").cast("string")).alias("x"))
    scored = x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ranking.score(F.col("x"), cutoff).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches the cutoff, all columns as they were; no shuffle of ``docs``.

    Null and blank texts have zero features and stay or go by the score these give; repeated
    rows and rows with a null id are judged like any other. Empty tables give empty results.
    """
    ranking = learn(docs, labels, rows=rows)
    rated = docs.select(F.struct("*").alias("row"), feature_column(F.col("text").cast("string")).alias("x"))
    return rated.where(ranking.score(F.col("x"), cutoff) >= cutoff).select("row.*")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, learnt from ``labels``; cutoff 0.7."""
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
