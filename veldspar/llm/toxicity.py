"""Toxicity: support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel compares words by their common subsequences of four characters, each weighing
less the more it is stretched, so an insult is met again with characters put in, left out
or appended. The machine is linear in the landmarks' kernel values, and these are linear
in the subsequences; so what is sent to the tasks is one weight for each subsequence.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import held_out, table

LENGTH, STRETCH, DECAY = 4, 3, 0.6
#: Letters, anything else, word start, word end.
OTHER, START, END, SYMBOLS = 26, 27, 28, 29
#: Characters that stand for letters: fixed values.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
EDGES = ".,;:!?\"'()[]{}<>*_~`|/\\-–—…«»“”‘’"
LONGEST, STEP = 20, 10
#: Bounds of what is learnt from: labelled documents of each class, in the order of a hash of their id; landmarks of each kind.
SAMPLE_DOCS, LANDMARKS, TOP = 3000, 128, 3
CACHE = 400_000


@cache
def _codes() -> np.ndarray:
    """Symbol of each character below 0x3000: base letter, or OTHER; letters of other scripts share the 26."""
    out = np.full(0x3000, OTHER, np.int32)
    for i in range(0x3000):
        c = unicodedata.normalize("NFD", chr(i))[0].lower()
        c = LOOKALIKES.get(c, c)
        out[i] = ord(c) - 97 if "a" <= c <= "z" else (i % 26 if c.isalpha() else OTHER)
    return out


@cache
def _subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences within LENGTH+STRETCH characters of n, and their weights at norm 1."""
    places = [p for p in combinations(range(n), LENGTH) if p[-1] - p[0] < LENGTH + STRETCH]
    w = np.array([DECAY ** (p[-1] - p[0] + 1 - LENGTH) for p in places], np.float32)
    return np.array(places, np.int64).reshape(-1, LENGTH), w / np.sqrt((w**2).sum()) if len(w) else w


def encode(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of one length at a time, in bounded pieces: (which, subsequence ids, weights)."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, which in sorted(by.items()):
        places, weights = _subsequences(n + 2)
        if not len(weights):
            continue
        step = max(1, 2_000_000 // len(weights))
        for at in range(0, len(which), step):
            part = which[at : at + step]
            points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            codes = np.empty((len(part), n + 2), np.int32)
            codes[:, 0], codes[:, -1] = START, END
            codes[:, 1:-1] = np.where(points < 0x3000, _codes()[np.minimum(points, 0x2FFF)], (points % 26).astype(np.int32))
            ids = codes[:, places[:, 0]]
            for k in range(1, LENGTH):
                ids = ids * SYMBOLS + codes[:, places[:, k]]
            yield np.array(part), ids, weights


def units(text: str | None) -> set[str]:
    """What is compared: distinct words, runs of single characters joined, overlapping parts of long ones."""
    tokens = (text or "").lower().split()
    found = {t.strip(EDGES) for t in set(tokens)}
    ones = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(ones) >= 3:
        run = [ones[0]]
        for i in [*ones[1:], -9]:
            if i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) >= 3:
                found.add("".join(tokens[k] for k in run))
            run = [i]
    found.discard("")
    for w in [w for w in found if len(w) > LONGEST]:
        found.discard(w)
        found.update(w[i : i + LONGEST] for i in range(0, len(w) - STEP, STEP))
    return found


class Machine:
    """Decision values of words by subsequence weights; of documents by their highest words."""

    def __init__(self, weights: np.ndarray, bias: float, link: np.ndarray):
        self.weights, self.bias, self.link = weights.astype(np.float32), bias, link

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for which, ids, w in encode(words):
            out[which] += self.weights[ids] @ w
        return out

    def tops(self, docs: list[set[str]], known: dict[str, float]) -> np.ndarray:
        """The TOP highest decision values of each document; -2 stands for what it lacks."""
        new = list(set().union(*docs) - known.keys())
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(set().union(*docs))
        known.update(zip(new, self.words(new).tolist(), strict=True))
        out = np.full((len(docs), TOP), -2.0)
        for i, d in enumerate(docs):
            best = heapq.nlargest(TOP, [known[w] for w in d])
            out[i, : len(best)] = np.maximum(best, -2)
        return out

    def scores(self, texts: Iterable[str | None], known: dict[str, float]) -> np.ndarray:
        tops = self.tops([units(t) for t in texts], known)
        return 1 / (1 + np.exp(-np.clip(tops @ self.link[:-1] + self.link[-1], -50, 50)))


def _svm(x: np.ndarray, y: np.ndarray, c: float = 4.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, both classes weighing alike, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * len(y)
    w, ridge = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(30):
        m = 1 - y * (x @ w)
        act = m > 0
        grad = ridge * w - 2 * x[act].T @ (share[act] * y[act] * m[act])
        step = np.linalg.solve(np.diag(ridge) + 2 * (x[act] * share[act, None]).T @ x[act], grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def train(texts: list[str | None], toxic: np.ndarray, landmarks: int = LANDMARKS, seed: int = 5) -> Machine:
    """Multiple-instance training: a toxic document holds some toxic word, a clean one none.

    Four in five documents teach the machine. Witnesses of toxic documents are at first their
    words with the substrings most tilted to toxic documents, then those the machine puts
    highest; a clean document's highest word always counts against it. The others fit the
    logistic link from a document's highest words to its score. With one class only, the
    score is that class's share everywhere.
    """
    rng = np.random.default_rng(seed)
    if not len(toxic) or toxic.min() == toxic.max():
        share = min(max(float(np.mean(toxic)) if len(toxic) else 0.0, 0.01), 0.99)
        return Machine(np.zeros(SYMBOLS**LENGTH), -1.0, np.r_[np.zeros(TOP), np.log(share / (1 - share))])
    docs = [units(t) for t in texts]
    tune = np.arange(len(docs)) % 5 == 4
    if len(set(toxic[tune])) < 2 or len(set(toxic[~tune])) < 2:
        tune = np.zeros(len(docs), bool)
    own = np.flatnonzero(~tune)
    counts = (Counter(), Counter())
    for i in own:
        counts[int(toxic[i])].update(docs[i])
    vocabulary = sorted(counts[0].keys() | counts[1].keys())  # the same machine in every run
    place = {w: k for k, w in enumerate(vocabulary)}
    bad = np.array([counts[1][w] for w in vocabulary], float)
    good = np.array([counts[0][w] for w in vocabulary], float)
    n_bad, n_good = max(1, int(toxic[own].sum())), max(1, int((toxic[own] == 0).sum()))
    # how far each unstretched substring tilts to toxic documents
    t, c = np.zeros(SYMBOLS**LENGTH), np.zeros(SYMBOLS**LENGTH)
    for which, ids, w in encode(vocabulary):
        tight = ids[:, w >= w.max() * 0.999]
        np.add.at(t, tight, bad[which, None])
        np.add.at(c, tight, good[which, None])
    tilt = np.log((t + 0.5) / n_bad) - np.log((c + 0.5) / n_good)
    tilt = np.where(t >= 3, tilt * np.sqrt(np.minimum(t, 400)), 0)
    first = np.zeros(len(vocabulary))
    for which, ids, w in encode(vocabulary):
        first[which] = tilt[ids[:, w >= w.max() * 0.999]].max(1)
    first = np.where(good > 0, np.minimum(first, 0), first)
    # landmarks: words that hold the most tilted substrings, at most two for one substring; and common clean words
    chosen, taken = [], Counter()
    for k in np.lexsort((vocabulary, -bad, -first)):
        ids = [i for _, i, w in encode([vocabulary[k]]) for i in i[0, w >= w.max() * 0.999]]
        top = max(ids, key=lambda i: tilt[i], default=-1)
        if top >= 0 and taken[top] < 2:
            taken[top] += 1
            chosen.append(k)
        if len(chosen) >= landmarks or first[k] <= 0:
            break
    clean = np.lexsort((vocabulary, -good))[: landmarks // 2]
    more = np.flatnonzero(good > 0)
    chosen = list(dict.fromkeys([*chosen, *clean, *rng.choice(more, min(len(more), landmarks // 2), replace=False)])) if len(more) else chosen
    names = [vocabulary[k] for k in chosen]
    parts = [(which, ids, np.broadcast_to(w, ids.shape)) for which, ids, w in encode(names)]
    used = np.unique(np.concatenate([ids.ravel() for _, ids, _ in parts]))
    column = np.full(SYMBOLS**LENGTH, len(used), np.int32)
    column[used] = np.arange(len(used))
    phi = np.zeros((len(used) + 1, len(names)), np.float32)
    for which, ids, w in parts:
        np.add.at(phi, (column[ids], np.broadcast_to(which[:, None], ids.shape)), w)
    gram = phi.T.astype(float) @ phi
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # to the Nystroem features

    def nystroem(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(names)))
        for which, ids, w in encode(words):
            for at in range(0, len(which), 512):
                out[which[at : at + 512]] = np.einsum("nck,c->nk", phi[column[ids[at : at + 512]]], w) if ids.shape[1] < 8 else sum(phi[column[ids[at : at + 512, j]]] * w[j] for j in range(ids.shape[1]))
        return out @ root

    at = [np.sort(np.fromiter((place[w] for w in docs[i]), np.int64, len(docs[i]))) for i in own]
    value, machine = first, None
    for _ in range(3):
        tops = [a[value[a].argmax()] if len(a) else -1 for a in at]
        hit = {k for k, i in zip(tops, own, strict=True) if k >= 0 and toxic[i] == 1 and not good[k]}
        miss = {k for k, i in zip(tops, own, strict=True) if k >= 0 and toxic[i] == 0}
        miss.update(rng.choice(more, min(len(more), 4 * landmarks * 8), replace=False).tolist())
        if not hit or not miss:
            break
        pick = [*sorted(hit), *sorted(miss)]
        w, b = _svm(nystroem([vocabulary[k] for k in pick]), np.r_[np.ones(len(hit)), -np.ones(len(miss))])
        weights = np.zeros(SYMBOLS**LENGTH)
        weights[used] = phi[:-1] @ (root @ w)
        machine = Machine(weights, b, np.zeros(TOP + 1))
        value = machine.words(vocabulary)
    if machine is None:
        return train([], np.zeros(0))
    fit = np.flatnonzero(tune) if tune.any() else own
    known: dict[str, float] = {}
    tops = np.concatenate([machine.tops([docs[i] for i in fit[k : k + 500]], known) for k in range(0, len(fit), 500)])
    machine.link = _logistic(tops, toxic[fit].astype(float))
    return machine


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> Machine:
    """Machine from at most ``rows`` documents of each class whose labels may be learnt from."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("y")).withColumn("h", F.xxhash64("_id"))
    some = told.where("y = 1").orderBy("h", "_id").limit(rows).unionByName(told.where("y = 0").orderBy("h", "_id").limit(rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).groupBy("_id", "y", "h").agg(F.min("text").alias("text"))  # at most 2 * rows ids, each with one text
    sample = sample.toPandas().sort_values(["h", "text"])
    return train(sample["text"].tolist(), sample["y"].to_numpy())


def rate(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, rows: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``, from its whole text.

    Learnt from ``labels`` (doc_id, toxic) without the rows held out; repeated labels of one
    id count once, as toxic if any says so. Null and blank texts get the lowest score there
    is. Rows with a null id are scored too and never held out.
    """
    ship(docs.sparkSession)
    learnt = learn(docs, labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast((learnt.weights, learnt.bias, learnt.link))  # its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = Machine(*sent.value), {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                score = machine.scores(part.column(1).to_pylist(), known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, learnt from ``labels``; cutoff 0.3."""
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
