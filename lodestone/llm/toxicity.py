"""Toxicity by a weighted lexicon (operator 9).

Texts are folded (look-alikes of other scripts, digits and signs that stand
for letters), lexicon terms are found by an Aho-Corasick automaton, hits inside
exception phrases do not count, and the weighted sum is normalised by length.
Terms, weights and exceptions are learned from labelled documents.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, table
from lodestone.llm.pii import HOMOGLYPHS
from lodestone.session import materialise, spread

#: Signs and digits that stand for letters (fixed values).
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}

#: Bounds of what is learned: labelled rows, lexicon terms, exception phrases.
TRAIN_ROWS = 20_000
MAX_TERMS = 2_000
MAX_EXCEPTIONS = 500
#: Lengths of word beginnings that may become terms, written with a trailing ``*``; at each place the heaviest term counts.
STEMS = (5, 6, 7, 8)
#: A document's repetitions of one unit beyond these do not add to its weight.
MAX_REPEATS = 5
MIN_DOCS = 5
MIN_WEIGHT = 1.5
#: Neighbourhoods (of 63 hash buckets) in which a term must occur, so that the words of one much-copied text are no terms.
MIN_CONTEXTS = 8
THRESHOLD = 0.3
#: Words added to the length of a text, so that one hit in a short text does not decide alone.
LENGTH_PRIOR = 20.0


class _Fold(dict):
    """Characters to folded lower-case letters; anything that is no letter separates words."""

    def __missing__(self, cp: int) -> str:
        import unicodedata

        c = chr(cp)
        c = HOMOGLYPHS.get(c) or (unicodedata.normalize("NFKC", c) if cp > 127 else c)
        c = c.lower()
        c = HOMOGLYPHS.get(c, c)
        c = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) if len(c) == 1 else c
        digit = unicodedata.decimal(c, None) if len(c) == 1 else None
        c = str(digit) if digit is not None else c
        c = SUBSTITUTIONS.get(c, c)
        self[cp] = c = c if c.isalpha() else "" if unicodedata.category(chr(cp)) in ("Cf", "Mn") else " "
        return c


_FOLD = _Fold()


def fold_words(text: str | None) -> list[str]:
    """Folded words. A word that holds signs or digits only is dropped, as are signs at a word's ends."""
    out = []
    for word in (text or "").split():
        core = word if word.isalpha() else word.strip("!$|+€.,;:?\"'()[]{}<>*#%&-_/\\~^`=")
        if not core:
            continue
        if not core.isalpha() and not any(c.isalpha() for c in core):
            continue
        out += core.translate(_FOLD).split()
    return out


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, ...] = (-4.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for t, w in self.terms.items():
            pattern = f" {t[:-1]}" if t.endswith("*") else f" {t} "
            found.add_word(pattern, ("term", len(pattern), w))
        for e in self.exceptions:
            found.add_word(f" {e} ", ("exception", len(e) + 2, 0.0))
        if len(found):
            found.make_automaton()
            return found
        return None

    def features(self, text: str | None, automaton) -> tuple[float, float]:
        """(weighted sum over length, log of the weighted sum) of the hits outside exception phrases."""
        words = fold_words(text)
        if not words or automaton is None:
            return 0.0, 0.0
        hits: dict[int, float] = {}  # by the place of the space before the word
        spared = []
        for end, (kind, size, weight) in automaton.iter(f" {' '.join(words)} "):
            at = end + 1 - size
            if kind == "term":
                hits[at] = max(hits.get(at, 0.0), weight)
            else:
                spared.append((at, end))
        if spared:
            hits = {at: w for at, w in hits.items() if not any(a <= at < b for a, b in spared)}
        total = sum(hits.values())
        return 100.0 * total / (len(words) + LENGTH_PRIOR), math.log1p(total)

    def probability(self, features: tuple[float, float]) -> float:
        a, b, c = self.coefficients
        x = a + b * features[0] + c * features[1]
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counts(sample: DataFrame, terms: set[str] | None = None) -> DataFrame:
    """For each folded word and word beginning: documents and occurrences of either label, and toxic contexts.

    With ``terms``: for each two-word phrase with one of them instead. Sums are made per batch first.
    """
    names = ["unit", "clean", "toxic", "clean_uses", "toxic_uses", "around"]

    def units(words: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for u, v in zip(["", *words], words) if terms is not None else (("", w) for w in words):
            if terms is None:
                for x in (v, *(f"{v[:n]}*" for n in STEMS if len(v) > n)):
                    out[x] = out.get(x, 0) + 1
            elif u and (is_term(u) or is_term(v)):
                out[f"{u} {v}"] = out.get(f"{u} {v}", 0) + 1
        return out

    def is_term(w: str) -> bool:
        return w in terms or any(f"{w[:n]}*" in terms for n in STEMS if len(w) > n)

    def run(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = fold_words(text)
                for u, n in units(words).items():
                    c = seen.setdefault(u, [0, 0, 0, 0, 0])
                    c[toxic] += 1
                    c[2 + toxic] += min(n, MAX_REPEATS)
                if toxic and terms is None:
                    for u, v in zip(["", *words], words):
                        bit = 1 << zlib.crc32(u.encode()) % 63
                        for x in (v, *(f"{v[:n]}*" for n in STEMS if len(v) > n)):
                            seen[x][4] |= bit
            cols = zip(*seen.values(), strict=True) if seen else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names)

    found = arrow_map(sample, run, "unit string, " + ", ".join(f"{n} long" for n in names[1:])).groupBy("unit")
    return found.agg(*(F.sum(n).alias(n) for n in names[1:5]), F.bit_count(F.bit_or("around")).alias("contexts"))


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from the rows of ``labelled``, which ``training_rows`` bounds.

    Rows without a label are left out; null and empty texts count as rows
    without words, words of any length may become terms. With no row of
    either label the lexicon is empty and every score is the same low value.
    What reaches the driver is bounded: ``MAX_TERMS`` terms,
    ``MAX_EXCEPTIONS`` phrases and two numbers for each of the rows.
    """
    sample = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), (F.col(label) > 0).cast("int").alias("toxic"))
    sample = spread(materialise(sample, "toxicity-sample"))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return ToxicityModel()
    base = n[1] / (n[0] + n[1])
    weight = F.log((F.col("toxic_uses") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean_uses") + 0.5) / (n[0] + 1.0))
    words = _counts(sample).withColumn("weight", weight).filter((F.col("toxic") >= MIN_DOCS) & (F.col("contexts") >= MIN_CONTEXTS) & (F.col("weight") > MIN_WEIGHT))
    best = words.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "unit").limit(MAX_TERMS).collect()
    terms = {r["unit"]: float(r["weight"]) for r in best}
    exceptions: list[str] = []
    if terms:
        spared = _counts(sample, set(terms)).filter((F.col("clean") >= MIN_DOCS) & (F.col("toxic") / (F.col("clean") + F.col("toxic")) < base))
        exceptions = [r["unit"] for r in spared.orderBy(F.desc("clean"), "unit").limit(MAX_EXCEPTIONS).collect()]
    model = ToxicityModel(terms, exceptions)

    def measured(batches):
        found = model.automaton()
        for b in batches:
            f = [model.features(t, found) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column(1)], ["a", "b", "toxic"])

    points = np.array([tuple(r) for r in arrow_map(sample, measured, "a double, b double, toxic int").collect()])
    model.coefficients = tuple(float(v) for v in _logistic(points[:, :2], points[:, 2]))
    return model


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every row, from the whole of its text.

    Null and empty texts score as texts without hits. Repeated keys and rows
    are scored each by itself, equal texts alike; an empty table gives an
    empty one. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        found = model.automaton()
        for b in batches:
            s = [model.probability(model.features(t, found)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", key)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they were, that score below ``threshold``; a tie with it goes.

    Null and empty texts have no hit and stay unless the model gives all such
    texts the threshold. Rows are judged one by one, repeated ones alike.
    """
    at = docs.columns.index(text)

    def run(batches):
        found = model.automaton()
        for b in batches:
            keep = [model.probability(model.features(t, found)) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_rows: int = TRAIN_ROWS) -> DataFrame:
    """``text`` and ``toxic`` of at most ``max_rows`` labelled keys outside the held-out rows, those with the smallest hashes.

    A label given twice counts as toxic if one is. The chosen keys are
    broadcast, as ``max_rows`` bounds them: of the documents only theirs are
    shuffled. Of rows that share a key the least text is taken, so that the
    rows are bounded too. Null keys match nothing.
    """
    own = labels.filter(~held_out(F.col(key)) & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64(key), key).limit(max_rows)
    return docs.select(key, "text").join(F.broadcast(own), key).groupBy(key).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a lexicon learned from the labelled rows outside the held-out ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score(spread(docs), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
