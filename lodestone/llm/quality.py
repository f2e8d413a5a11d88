"""Quality classifier from weak labels (operator 7).

Overlapping heuristics vote good, bad or nothing on each document.
Expectation-maximisation over the counts of vote patterns estimates how
accurate each labeller is; the posterior labels train a linear scorer on
hashed features of the text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, table
from lodestone.session import spread

#: Distinct texts on which the scorer is fitted, those with the smallest hashes; EM uses all rows.
TRAIN_ROWS = 8_000
DIMENSIONS = 2048
THRESHOLD = 0.5
BAD, GOOD, NONE = 0, 1, 2

_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123] = True, True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PLAIN = np.zeros(256, bool)  # signs of ordinary prose
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = True
_HIGH = np.arange(256) >= 128


@dataclass
class Facts:
    """Measures of one text that both the labellers and the scorer use."""

    words: int
    counts: Counter
    signs: float
    upper: float
    digits: float
    mean_length: float
    distinct: float
    top: float
    runs: float
    lines: float
    ended: float
    bare: float
    dressed: float

    @classmethod
    def of(cls, text: str | None) -> Facts:
        text = text or ""
        words = text.split()
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        size = max(1, int(raw.sum() - raw[_SPACE].sum()))
        letters = max(1, int(raw[_UPPER].sum() + raw[_LOWER].sum()))
        n, counts = len(words), Counter(words)
        no_letter = sum(c for w, c in counts.items() if not any(map(str.isalpha, w)))
        dressed = sum(c for w, c in counts.items() if len(w) > 2 and not (w[-1].isalnum() or w[-2].isalnum()))
        lines = [x for x in text.split("\n") if x.strip()]
        return cls(
            words=n,
            counts=counts,
            signs=float(raw[~(_UPPER | _LOWER | _DIGIT | _SPACE | _PLAIN | _HIGH)].sum()) / size,
            upper=float(raw[_UPPER].sum()) / letters,
            digits=float(raw[_DIGIT].sum()) / size,
            mean_length=sum(map(len, words)) / max(1, n),
            distinct=len(counts) / max(1, n),
            top=max(counts.values(), default=0) / max(1, n),
            runs=sum(a == b for a, b in zip(words, words[1:])) / max(1, n),
            lines=1 - len(set(lines)) / max(1, len(lines)),
            ended=float(raw[[ord("."), ord("?"), ord(",")]].sum()) / max(1, n),
            bare=no_letter / max(1, n),
            dressed=dressed / max(1, n),
        )


def _vote(value: float, good: tuple[float, float], bad_below: float | None, bad_above: float | None) -> int:
    if bad_below is not None and value < bad_below or bad_above is not None and value > bad_above:
        return BAD
    return GOOD if good[0] <= value <= good[1] else NONE


_ELSE = (-math.inf, math.inf)  # what is not bad is good
#: Labellers: name and vote of a document's measures. On short texts most abstain.
LABELLERS = {
    "signs": lambda f: _vote(f.signs, (0, 0.01), None, 0.05),
    "bare": lambda f: NONE if f.words < 10 else _vote(f.bare, (0, 0.02), None, 0.1),
    "dressed": lambda f: NONE if f.words < 10 else _vote(f.dressed, (0, 0.02), None, 0.2),
    "upper": lambda f: NONE if f.words < 5 else _vote(f.upper, (0, 0.1), None, 0.25),
    "digits": lambda f: NONE if f.words < 10 else _vote(f.digits, _ELSE, None, 0.2),
    "word_length": lambda f: NONE if f.words < 10 else _vote(f.mean_length, _ELSE, 2.5, 12),
    "variety": lambda f: NONE if f.words < 20 else _vote(f.distinct * min(1.0, math.sqrt(f.words / 200)), _ELSE, 0.1, None),
    "top_word": lambda f: NONE if f.words < 20 else _vote(f.top, (0, 0.12), None, 0.25),
    "runs": lambda f: NONE if f.words < 5 else _vote(f.runs, (0, 0.02), None, 0.06),
    "lines": lambda f: NONE if f.words < 40 else _vote(f.lines, _ELSE, None, 0.3),
    "sentences": lambda f: NONE if f.words < 30 else _vote(f.ended, (0.03, 0.6), 0.005, 1.2),
}


def votes(facts: Facts) -> str:
    return "".join(str(v(facts)) for v in LABELLERS.values())


@dataclass
class LabelModel:
    prior: float
    accuracy: np.ndarray  # labeller, class, vote: shares among those who vote
    posterior: dict[str, float]

    def __call__(self, pattern: str) -> float:
        p = np.log([1 - self.prior, self.prior])
        for k, v in enumerate(pattern):
            if int(v) != NONE:  # who abstains says nothing
                p = p + np.log(self.accuracy[k, :, int(v)])
        return float(1 / (1 + np.exp(min(700.0, p[0] - p[1]))))


def fit_labellers(patterns: dict[str, int], rounds: int = 100) -> LabelModel:
    """EM over pattern counts, from the majority of the votes; accuracies are smoothed, so that none is 0."""
    k = len(LABELLERS)
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    vote = np.array([[int(c) for c in p] for p in names]).reshape(len(names), k)
    good, bad = (vote == GOOD).sum(1), (vote == BAD).sum(1)
    q = np.where(bad > 0, 0.25, 0.9) + 0.05 * np.sign(good - 3 * bad)
    model = LabelModel(0.5, np.full((k, 2, 2), 0.5), {})
    for _ in range(rounds if len(names) else 0):
        total = np.array([(n * (1 - q)).sum(), (n * q).sum()]) + 1e-9
        model.prior = min(0.99, max(0.01, total[1] / total.sum()))
        for j in range(k):
            voting = n * (vote[:, j] != NONE)
            voters = np.array([(voting * (1 - q)).sum(), (voting * q).sum()])
            for v in (BAD, GOOD):
                is_v = n * (vote[:, j] == v)
                model.accuracy[j, :, v] = (np.array([(is_v * (1 - q)).sum(), (is_v * q).sum()]) + 1.0) / (voters + 2.0)
        new = np.array([model(p) for p in names])
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    model.posterior = dict(zip(names, q.tolist(), strict=True))
    return model


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIMENSIONS


def hashed(facts: Facts, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words by log count, at unit length, and hashed steps of the measures."""
    at = []
    for w in facts.counts:
        k = cache.get(w)
        if k is None:
            if len(cache) > 200_000:
                cache.clear()
            k = cache[w] = _bucket("w:" + w.lower())
        at.append(k)
    value = np.log1p(np.fromiter(facts.counts.values(), float, len(at)))
    value /= max(1e-9, math.sqrt(float(value @ value)))
    steps = {
        "signs": facts.signs * 50, "upper": facts.upper * 20, "digits": facts.digits * 40, "length": facts.mean_length, "distinct": facts.distinct * 10,
        "top": facts.top * 20, "runs": facts.runs * 25, "lines": facts.lines * 10, "ended": facts.ended * 10, "bare": facts.bare * 25, "dressed": facts.dressed * 10, "words": math.log2(facts.words + 1),
    }
    extra = [_bucket(f"m:{k}:{min(12, int(v))}") for k, v in steps.items()]
    return np.array(at + extra, np.int64), np.concatenate([value, np.full(len(extra), 0.5)])


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, facts: Facts, cache: dict[str, int]) -> float:
        at, value = hashed(facts, cache)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[at] @ value) + self.bias))))


def _fit_linear(rows: list[tuple[list[int], list[float], float]], steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    x = np.zeros((len(rows), DIMENSIONS + 1), np.float32)
    for i, (at, value, _) in enumerate(rows):
        np.add.at(x[i], np.array(at, np.int64), np.array(value, np.float32))
    x[:, -1] = 1
    y = np.array([r[2] for r in rows], np.float32)
    w = np.zeros(DIMENSIONS + 1, np.float32)
    if not len(rows):
        return w[:-1].astype(float), 0.0
    look, rate = w.copy(), 4.0 / float((x**2).sum(1).mean() + 1e-9)
    for k in range(steps):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ look, -30, 30))) - y) / len(y) + ridge * look
        new = look - rate * g
        look, w = new + (k / (k + 3)) * (new - w), new
    return w[:-1].astype(float), float(w[-1])


def fit(docs: DataFrame, text: str = "text", max_rows: int = TRAIN_ROWS) -> QualityModel:
    """Labeller accuracies from the vote patterns of all rows, the scorer from ``max_rows`` of them.

    What reaches the driver is bounded: one count for each of at most
    3 ** 11 patterns, and the features of the sampled rows.
    """

    def voted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(Facts.of(t)) for t in b.column(0).to_pylist()], pa.string())], ["votes"])

    patterns = arrow_map(docs.select(text), voted, "votes string").groupBy("votes").count().collect()
    labels = fit_labellers({r["votes"]: r["count"] for r in patterns})
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    share = max_rows / max(1, sum(r["count"] for r in patterns))
    # Hashes are uniform: a little more than the share is read, then the smallest are taken.
    bound = min(2**63 - 1, -(2**63) + int(1.5 * share * 2**64) + 1)
    sample = docs.select(F.col(text).alias("text"), h.alias("h")).filter(F.col("h") <= bound).dropDuplicates(["h"]).orderBy("h").limit(max_rows)

    def featured(batches):
        cache: dict[str, int] = {}
        for b in batches:
            out = [(Facts.of(t),) for t in b.column(0).to_pylist()]
            rows = [(*hashed(f, cache), labels(votes(f))) for (f,) in out]
            cols = [pa.array([r[0].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["at", "value", "y"])

    rows = arrow_map(sample.select("text"), featured, "at array<long>, value array<double>, y double").toLocalIterator()
    weights, bias = _fit_linear([(r["at"], r["value"], r["y"]) for r in rows])
    return QualityModel(labels, weights, bias)


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, kept, votes, posterior`` of every row; ``kept`` where the score reaches ``THRESHOLD``.

    A null or empty text has no words: its votes say so and its score follows.
    Rows are independent, so equal texts get equal scores.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        cache: dict[str, int] = {}
        for b in batches:
            facts = [Facts.of(t) for t in b.column(1).to_pylist()]
            found = [votes(f) for f in facts]
            scores = [model.score(f, cache) for f in facts]
            cols = [pa.array(scores, pa.float64()), pa.array([s >= THRESHOLD for s in scores], pa.bool_()), pa.array(found, pa.string()), pa.array([model.labels.posterior.get(v, model.labels.prior) for v in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "score", "kept", "votes", "posterior"])

    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, f"id {kind}, score double, kept boolean, votes string, posterior double").withColumnRenamed("id", key)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a scorer that learned from weak labels."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score(docs, fit(docs))
