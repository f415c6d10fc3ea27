"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation learns how far each is to be trusted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import keep, table

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: What is not a letter, a digit or a mark that prose uses within or after a word, and ASCII.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measured for the rules alone.
MORE = ("n_lines", "n_kinds", "n_upper", "n_marked", "n_bare", "n_ends")
SCHEMA = ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
WINDOW = 8


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more. Windows are numbered exactly: runs of 1 give runs of 2, of 4, of 8."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    runs, length = ids, 1
    while length < window:
        step = min(length, window - length)
        a, b = runs[:-step], runs[step:]
        _, runs = np.unique(a * np.int64(int(runs.max()) + 1) + b, return_inverse=True)
        length += step
    again = np.flatnonzero(np.bincount(runs)[runs] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of a whole text; a null text gives zeros."""
    if not isinstance(text, str):
        return (0,) * (len(COUNTS) + len(MORE))
    ws = text.encode("utf-8", "surrogatepass").split()  # at just the six characters of SPACE
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    kinds = {w: i for i, w in enumerate(dict.fromkeys(ws))}
    n = len(ws)
    ids = np.fromiter(map(kinds.__getitem__, ws), np.int64, n)
    times = np.bincount(ids, minlength=len(kinds)).tolist()
    marked = bare = ends = 0
    for w, k in zip(kinds, times, strict=True):
        last = w[-1]
        if last in b".!?":
            ends += k
        if last in MARKS:
            if not w.strip(MARKS):
                bare += k
            elif len(w) > 2 and w[-2] in MARKS:
                marked += k
    solid = len(text) - sum(map(text.count, SPACE))
    upper = sum(text.count(c) for c in set(text) if c != c.lower())
    repeats = repeated_words(ids) if len(kinds) < n else 0
    return n, solid, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), len(kinds), upper, marked, bare, ends


def measured(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[*COUNTS, *MORE], dtype="int64")

    return F.pandas_udf(run, SCHEMA)(text)


@dataclass
class Rule:
    """Votes good or bad; where neither condition holds (or is null) it abstains. Conditions are SQL over COUNTS and MORE."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        """0 bad, 1 abstains, 2 good; bad before good."""
        return F.when(F.expr(self.bad), 0).when(F.expr(self.good), 2).otherwise(1)


RULES = (
    Rule("length", "n_words >= 60", "n_words < 30"),
    Rule("word_length", "word_chars between 3.5 * n_words and 9 * n_words", "word_chars < 2.5 * n_words or word_chars > 12 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("loud", "6 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    Rule("doubled_marks", "50 * n_marked <= n_words", "10 * n_marked > n_words"),
    Rule("bare_marks", "50 * n_bare <= n_words", "10 * n_bare > n_words"),
    Rule("repeats", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 3 and n_dup_lines = 0", "n_lines >= 3 and 2 * n_dup_lines > n_lines"),
    Rule("variety", "n_kinds * n_kinds * 2 >= n_words * 8", "n_kinds * n_kinds < n_words * 2"),
    Rule("sentences", "n_ends between n_words / 60.0 and n_words / 4.0", "n_ends < n_words / 300.0 or n_ends > n_words / 2.0"),
)


@dataclass
class Trust:
    """Share of good texts, and for each rule how often its vote is right on good and on bad texts."""

    prior: float
    right: np.ndarray  # rules x (good, bad)
    rounds: int = 0
    history: list[float] = field(default_factory=list)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of good against bad; votes are rows of 0, 1, 2."""
        on_good, on_bad = self.right[:, 0], self.right[:, 1]
        says_good, says_bad = np.log(on_good / (1 - on_bad)), np.log((1 - on_good) / on_bad)
        return np.log(self.prior / (1 - self.prior)) + (votes == 2) @ says_good + (votes == 0) @ says_bad

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -500, 500)))


def learn(votes: np.ndarray, n: np.ndarray, rounds: int = 200, prior: tuple[float, float] = (0.8, 1.0), tolerance: float = 1e-9) -> Trust:
    """Trust from vote patterns (rows of 0, 1, 2) and their counts, by expectation-maximisation.

    The first posterior is that of all-must-pass filtering, softened: a text without a bad
    vote is good with 0.9, each bad vote halves that. Accuracies are smoothed by ``prior``:
    (mean, weight in texts), so that a rule which never votes keeps the mean; the
    prior share of good texts is kept off 0 and 1 in the same way.
    """
    mean, weight = prior
    good, bad = votes == 2, votes == 0
    p = 0.9 * 0.5 ** bad.sum(1)
    trust = Trust(0.5, np.full((votes.shape[1], 2), mean))
    for i in range(rounds):
        on_good, on_bad = n * p, n * (1 - p)
        right = np.stack([(on_good @ good + mean * weight) / (on_good @ (good | bad) + weight), (on_bad @ bad + mean * weight) / (on_bad @ (good | bad) + weight)], 1)
        trust = Trust(float((on_good.sum() + 1) / (n.sum() + 2)), right, i + 1, [*trust.history, float(on_good.sum())])
        q = trust.posterior(votes)
        moved, p = float(np.abs(q - p).max(initial=0.0)), q
        if moved < tolerance:
            break
    return trust


def votes_of(code: np.ndarray, rules: int) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(rules)[None, :] % 3


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, votes, quality, kept): one row for each row of ``docs``.

    ``quality`` is the posterior probability that the text is good, given the rules' votes; kept
    are texts that don't fail the base and reach ``least``. Every text counts in learning, the
    base's failures too. What comes to the driver are vote patterns with their counts, at most
    3 to the number of rules, whatever the number of rows; the same goes for the table of
    posteriors that is broadcast.

    Null, empty and blank texts have no words and fail the base, repeated rows count as often
    as they stand there, rows with a null id are judged like any other, ties don't occur.
    Empty tables give empty results. Other columns of ``docs``, whatever their names, are not read.
    """
    if 3 ** len(rules) > 1_000_000:
        raise ValueError("at most 12 rules: vote patterns are kept in memory")
    ship(docs.sparkSession)
    m = docs.select(F.col(id_col).alias("doc_id"), measured(F.col(text_col).cast("string")).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    code = sum((r.vote() * F.lit(3**j) for j, r in enumerate(rules)), F.lit(0)).cast("long")
    m = keep(m.select("doc_id", *COUNTS, failed.alias("base_failed"), code.alias("votes")))
    patterns = m.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toPandas()  # at most 3^rules rows
    codes = patterns["votes"].to_numpy(np.int64)
    votes = votes_of(codes, len(rules))
    trust = learn(votes, patterns["n"].to_numpy(float))
    known = docs.sparkSession.createDataFrame(pd.DataFrame({"_code": codes, "quality": trust.posterior(votes)}), "_code long, quality double")
    j = m.join(F.broadcast(known), F.col("votes") == F.col("_code")).drop("_code")
    return j.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, judged by RULES."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "quality")
