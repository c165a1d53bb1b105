"""Toxicity of whole texts by a classifier that is held to the same score for swapped identity terms.

A logistic model over the presence of words and word beginnings, so that inflected forms count
together; features are numbered by hash.  For every labelled text that names a group, copies with the
name swapped for each other name of its list are made, and the squared change of the score between text
and copy is added to the loss, so a group's mere mention cannot raise a score.  Neutral sentences
do the same for names that no labelled text holds.

The model is fitted on a bounded sample of labelled rows (``sample_rows``, those of the smallest id
hash, equal texts once); its features are those that tell the labels of the sample apart most clearly.
Scoring is one pass over the texts with a table of at most ``vocabulary`` weights.

Defined cases: null and wordless texts get the score of no evidence; null ids are never held out; rows
with a null label are no examples; repeated rows are scored each.  Without any example, or with one
label only, every score is the label's share (0 without any).  An empty table gives an empty result;
extra columns are ignored, or kept where documents are returned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.tokens import forget, slices, texts_of
from clientele.operators.keyed import free_name

SAMPLE_ROWS, VOCABULARY, LEAST_SUPPORT, LEAST_CLARITY = 8_000, 4_096, 5, 4.0
THRESHOLD, FAIRNESS, RIDGE, ROUNDS = 0.3, 4.0, 1e-4, 400

#: Lengths of word beginnings that are features of their own, and the number of feature names.
BEGINNINGS, NAMES = (4, 6), 1 << 24

# Names of groups, by the list within which they are swapped.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy", "transgender"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)
# Neutral sentences that name a group.
NEUTRAL = ("we are {} people", "a talk with {} neighbours", "{}")

_WORD = re.compile(r"[^\W\d_]+")
_GROUP = {term: group for group in IDENTITY_TERMS for term in group}


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of a word and of its beginnings."""
    names = [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]
    return tuple(xxhash.xxh32_intdigest(name.encode()) % NAMES for name in names)


class _Features(dict):
    """Features of the words met so far, out of those that count."""

    def __init__(self, chosen: frozenset[int] | None = None) -> None:
        super().__init__()
        self._chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        found = word_features(word)
        if self._chosen is not None:
            found = tuple(f for f in found if f in self._chosen)
        self[word] = found
        return found

    def of(self, text: str) -> set[int]:
        return set().union(*map(self.__getitem__, set(_WORD.findall(text.lower()))))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Feature weights and the score of no evidence, both on the logit scale."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    share: float | None = None

    def scorer(self) -> Callable[[str], float]:
        known = _Features(frozenset(self.weights))

        def score(text: str) -> float:
            if self.share is not None:
                return self.share
            # Sorted, so that equal texts have equal scores on every machine.
            total = self.bias + sum(self.weights[f] for f in sorted(known.of(text)))
            return float(1 / (1 + np.exp(-total)))

        return score


def choose_features(examples: Sequence[np.ndarray], labels: np.ndarray, most: int, support: int) -> np.ndarray:
    """The features whose share among both labels differs most clearly."""
    flat = np.concatenate(examples)
    of = np.repeat(labels, [len(e) for e in examples])
    names, place = np.unique(flat, return_inverse=True)
    seen = np.stack([np.bincount(place[of == label], minlength=len(names)) for label in (0, 1)], axis=1)
    total = np.bincount(labels, minlength=2)
    pooled = seen.sum(axis=1) / total.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / total).sum())
    clear = np.abs(seen[:, 1] / total[1] - seen[:, 0] / total[0]) / spread
    clear[seen.sum(axis=1) < support] = 0.0
    order = np.lexsort((names, -clear))[:most]
    return np.sort(names[order[clear[order] >= LEAST_CLARITY]])


def counterfactuals(examples: Sequence[np.ndarray]) -> list[tuple[set[int], set[int]]]:
    """Pairs of texts, as features, that differ in the name of a group only."""
    own = {word_features(term)[0]: term for term in _GROUP}
    known = _Features()
    neutral = [known.of(pattern.format(group[0])) for group in IDENTITY_TERMS for pattern in NEUTRAL]
    named = [set(e.tolist()) for e in examples if np.isin(e, list(own)).any()]
    pairs = []
    for example in [*named, *neutral]:
        for name in sorted(example & own.keys()):
            term = own[name]
            for other in _GROUP[term]:
                if word_features(other)[0] not in example:
                    pairs.append((example, (example - set(word_features(term))) | set(word_features(other))))
    return pairs


class _Rows:
    """A sparse 0/1 matrix by rows."""

    def __init__(self, examples: Sequence[set[int]], place: dict[int, int]) -> None:
        found = [sorted(place[f] for f in example if f in place) for example in examples]
        self.row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        self.column = np.array([c for f in found for c in f], np.int64)
        self.shape = (len(found), len(place))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.shape[0])

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], self.shape[1])


def fit(
    examples: Sequence[np.ndarray], labels: np.ndarray, vocabulary: int = VOCABULARY, support: int = LEAST_SUPPORT,
    fairness: float = FAIRNESS, ridge: float = RIDGE, rounds: int = ROUNDS,
) -> Model:
    """Minimise log loss + ridge + fairness × mean squared score change over swapped names.

    Gradient steps with per-weight step sizes (Adam), a fixed number of rounds, no randomness.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(share=float(labels.mean()) if len(labels) else 0.0)
    of_groups = {f for term in _GROUP for f in word_features(term)}
    names = sorted({*choose_features(examples, labels, vocabulary, support).tolist(), *of_groups})
    place = {name: at for at, name in enumerate(names)}
    pairs = counterfactuals(examples)
    data = _Rows([e.tolist() for e in examples], place)
    given, swapped = _Rows([a for a, _ in pairs], place), _Rows([b for _, b in pairs], place)
    theta = np.zeros(len(names) + 1)
    theta[-1] = np.log(labels.mean() / (1 - labels.mean()))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, bias = theta[:-1], theta[-1]
        miss = _sigmoid(data.times(weights) + bias) - labels
        gradient = np.append(data.back(miss) / len(labels) + ridge * weights, miss.mean())
        if pairs:
            one, two = (_sigmoid(rows.times(weights) + bias) for rows in (given, swapped))
            change = 2 * fairness * (one - two) / len(pairs)
            up, down = change * one * (1 - one), change * two * (1 - two)
            gradient[:-1] += given.back(up) - swapped.back(down)
            gradient[-1] += (up - down).sum()
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        pace = 0.1 * min(1.0, 4 * (rounds - step + 1) / rounds)
        theta -= pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model({name: float(w) for name, w in zip(names, theta[:-1], strict=True)}, float(theta[-1]))


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **parameters) -> Model:
    """Fit on labelled rows that are not held out; at most ``sample_rows`` labels are used."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))
    )
    chosen = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = _Features()
        for batch in slices(batches, "text"):
            numbers = [np.array(sorted(known.of(text)), "<i4").tobytes() for text in texts_of(batch)]
            yield pa.record_batch(
                [batch.column("_id"), batch.column("_label"), pa.array(numbers, pa.binary())], names=["_id", "_label", "features"]
            )

    given = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string")).join(chosen, "_id")
    rows = given.select("_id", "_label", "text").mapInArrow(found, "_id bigint, _label int, features binary")
    once = rows.groupBy("features", "_label").agg(F.min("_id").alias("_id")).orderBy("_id", "_label").limit(sample_rows).collect()
    examples = [np.frombuffer(row["features"], "<i4") for row in once]
    return fit(examples, np.array([row["_label"] for row in once], np.int64), **parameters)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    return docs.select(
        F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), _scorer(model)(F.col("text").cast("string")).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scorer(model: Model) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        one = model.scorer()
        for texts in batches:
            yield texts.map(lambda text: one(text or ""))

    return scores


def keep_harmless(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold; columns stay as they are."""
    name = free_name(docs, "_toxicity")
    marked = docs.withColumn(name, _scorer(model)(F.col("text").cast("string")))
    return marked.where(F.col(name) < threshold).select(*docs.columns)
