"""Toxicity by weak supervision.

Voters are words of a small public lexicon, a few patterns, and words and word beginnings that occur, or occur in
several words of one text, mostly where a labelled row is toxic. A generative label model takes the voters' accuracies
and correlations from the second moments of their votes over all documents, without a label. A linear classifier is
trained on the posterior labels that it gives to documents, labelled or not. Labels name the voters, set the class balance and, at
the end, scale the classifier's scores to probabilities; no document is trained on with its own label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import KeyFilter, stored, table, text_hash

# A fixed list: common English insults.
LEXICON = ("idiot moron stupid dumb trash scum loser worthless pathetic disgusting clown jerk fool imbecile hate kill vermin filth").split()
PATTERNS = {
    "!second person": re.compile(r"\b(?:you|your|you're)\b\W+(?:\w+\W+){0,2}(?:" + "|".join(LEXICON) + r")\b", re.I),
    "!shut up": re.compile(r"\b(?:shut up|go away|get lost|drop dead)\b", re.I),
    "!shouting": re.compile(r"!!!"),
}
_WORD = re.compile(r"\w+")
_CACHE = 100_000  # words
_COUNTED = 200_000  # features that are counted before the sums go out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _begins(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(3, 9) if len(word) > k)]


SEVERAL = (2, 3)  # words of one text with one beginning that count as features of their own: "abc*2", "abc*3"


def _features(text: str) -> set[str]:
    """All words and word beginnings of a text, and beginnings that several different words have."""
    n = Counter(b for word in set(_WORD.findall(text.lower())) for b in _begins(word))
    return set(n) | {f"{b}{k}" for b, m in n.items() if m >= SEVERAL[0] and b.endswith("*") for k in SEVERAL if m >= k}


class Hits:
    """The features of a text: which of the given words, word beginnings and patterns occur in it."""

    def __init__(self, features: list[str]):
        self.patterns = [(k, PATTERNS[f]) for k, f in enumerate(features) if f in PATTERNS]
        self.bases: dict[str, int] = {}  # words and beginnings by number
        self.levels: list[list[tuple[int, int]]] = []  # of each: (words that it takes, feature)
        for k, f in enumerate(features):
            if f not in PATTERNS:
                base, _, level = f.partition("*")
                at = self.bases.setdefault(f"{base}*" if "*" in f else f, len(self.levels))
                if at == len(self.levels):
                    self.levels.append([])
                self.levels[at].append((int(level or 1), k))
        self.starts = {b.removesuffix("*")[:3] for b in self.bases}  # most words begin like none of them
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        cache, bases, starts = self.cache, self.bases, self.starts
        if len(cache) > _CACHE:
            cache.clear()
        n: dict[int, int] = {}
        for word in set(_WORD.findall(text.lower())):
            if word[:3] not in starts:
                continue
            own = cache.get(word)
            if own is None:
                own = cache[word] = tuple(bases[b] for b in _begins(word) if b in bases)
            for b in own:
                n[b] = n.get(b, 0) + 1
        found = {k for b, m in n.items() for least, k in self.levels[b] if m >= least}
        found.update(k for k, p in self.patterns if p.search(text))
        return sorted(found)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled texts: (feature, toxic rows, other rows), summed over some rows; Spark sums the rest."""
    toxic, other = Counter(), Counter()

    def sums() -> Iterator[pa.RecordBatch]:
        names = list(toxic.keys() | other.keys())
        for a in range(0, len(names), 20_000):
            some = names[a : a + 20_000]
            columns = [pa.array(some, pa.string()), *(pa.array([n[f] for f in some], pa.int64()) for n in (toxic, other))]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "t", "o"])
        toxic.clear()
        other.clear()

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else other).update(_features(text.as_py() or ""))
            if len(toxic) + len(other) > _COUNTED:
                yield from sums()
    yield from sums()


def _hits_of(features: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(features)
        for batch in batches:
            own = [hits(t.as_py() or "") for t in batch.column("text")]
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(own, pa.list_(pa.int32()))], [*columns, "hits"])

    return find


@dataclass(frozen=True)
class LabelModel:
    """Rates of firing in toxic and other texts, correlation-discounted log odds, and the class balance."""

    balance: float
    toxic_rate: np.ndarray
    other_rate: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray
    bias: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weight + self.bias, -30, 30)))


def fit_label_model(n: int, second: np.ndarray, balance: float, dependent: float = 0.1) -> LabelModel:
    """The label model from n documents and their votes' second moments (counts of joint firing, single firing on the diagonal).

    Given the class, voters that are not dependent fire independently, so off the diagonal the covariance
    is d d' with d = sqrt(balance (1 - balance)) (toxic rate - other rate). d is fitted by alternating least
    squares over pairs that agree. What is left of a pair's covariance is its correlation given the class: pairs beyond ``dependent``
    leave the fit, which is made anew, and voters that are correlated share their weight.
    """
    m = len(second)
    mean = np.diag(second) / max(n, 1)
    cov = second / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    agree = (cov > 0) & ~np.eye(m, dtype=bool)
    used = agree & (cov < 0.6 * np.outer(spread, spread))  # not one voter under two names
    d = spread.copy()
    for _ in range(4):
        for _ in range(50):
            with np.errstate(invalid="ignore", divide="ignore"):
                new = np.where(used, cov * d[None, :], 0).sum(axis=1) / np.where(used, d[None, :] ** 2, 0).sum(axis=1)
            new = np.where(np.isfinite(new), new, d)
            d = np.clip(0.5 * d + 0.5 * new, 1e-6, spread)
        rest = (cov - np.outer(d, d)) / np.outer(spread, spread)
        used = agree & (np.abs(rest) < dependent)
    correlation = np.where(agree, rest, 0)
    gain = d / math.sqrt(balance * (1 - balance))
    other = np.clip(mean - balance * gain, 1e-4, 1 - 1e-4)
    toxic = np.clip(other + gain, other * 1.0001, 1 - 1e-4)
    fire, still = np.log(toxic / other), np.log((1 - toxic) / (1 - other))
    share = 1 + np.clip(correlation, 0, 1).sum(axis=1)
    return LabelModel(balance, toxic, other, correlation, (fire - still) / share, math.log(balance / (1 - balance)) + float((still / share).sum()))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit_scale(z: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from raw scores to the share of toxic labels; the slope stays positive."""
    if len(z) < 20 or truth.all() or not truth.any():
        return 1.0, 0.0
    w, shift = fit_linear(np.clip(z, -30, 30)[:, None], truth.astype(float), np.ones(len(z)), ridge=1e-3)
    return max(float(w[0]), 1e-3), shift


@dataclass(frozen=True)
class ToxicityModel:
    features: list[str]
    weights: np.ndarray
    bias: float
    voters: list[str]
    label_model: LabelModel

    def of_hits(self, hits: Column) -> Column:
        """The score of a row whose feature numbers are known."""
        weights = F.array(*(F.lit(float(w)) for w in self.weights))
        z = F.aggregate(hits, F.lit(float(self.bias)), lambda s, k: s + F.get(weights, k))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    def score(self) -> Callable[[Column], Column]:
        """A column function from text to score, for documents that the model was not fitted on."""
        features, weights, bias = self.features, self.weights, self.bias

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            hits = Hits(features)
            for texts in batches:
                z = np.array([weights[hits(t or "")].sum() + bias for t in texts], dtype=float)
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return scored


def _part(column: Column, share: float | Column, salt: str) -> Column:
    """Whether a hash of the column falls in a share of its range."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 20)) < share * (1 << 20)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_features: int = 400, max_voters: int = 60
) -> tuple[ToxicityModel, DataFrame]:
    """The model for ``docs``, and (doc_id, text_hash, hits) of every document, from which ``of_hits`` scores it.

    max_rows bounds the labelled rows that are used (half of them toxic where there are as many) and, apart from those, the documents
    that the classifier is trained on; both are chosen by a hash of the id, held-out rows are in neither. max_features and
    max_voters bound the model. The votes' moments are taken over all documents. Labels of a doc_id that occurs more than once count
    as toxic if any is; null labels and ids are left out. Without any usable label, the lexicon and the patterns vote alone, the balance
    is 5 % and scores are not scaled.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
    )
    counts = {int(r[0] > 0): r[1] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, max_rows / 2 / max(1, counts.get(k, 0))) for k in (0, 1)}
    pick = _part(F.col("doc_id"), F.when(F.col("toxic") > 0, share[1]).otherwise(share[0]), "toxicity")
    chosen = stored(known.where(pick), "chosen")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = stored(KeyFilter(chosen, "doc_id").matching(texts, F.col("doc_id")).join(chosen, "doc_id").select("toxic", "text"), "labelled")
    total = {int(r[0] > 0): r[1] for r in rows.groupBy("toxic").count().collect()}
    nt, no = total.get(1, 0), total.get(0, 0)
    balance = min(0.5, max(0.005, counts.get(1, 0) / max(1, sum(counts.values())))) if nt and no else 0.05
    odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("o") + 0.5) / (no + 1))
    mined = (
        rows.mapInArrow(_count_features, "feature string, t bigint, o bigint")
        .groupBy("feature")
        .agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        .where(F.col("t") >= max(2, nt // 500))
        .withColumn("odds", odds)
        .where("odds >= 2")
        .orderBy((F.col("odds") * F.sqrt("t")).desc(), F.length("feature"), "feature")
        .limit(max_features)
        .collect()
    )
    features = list(dict.fromkeys([*LEXICON, *PATTERNS, *(r["feature"] for r in mined)]))
    example = rows.mapInArrow(_hits_of(features), "toxic int, hits array<int>").collect()
    votes, truth = _votes([r["hits"] for r in example], len(features)), np.array([r["toxic"] > 0 for r in example], dtype=bool)
    voters = _chosen_voters(votes, truth, features, max_voters)

    hits = stored(texts.mapInArrow(_hits_of(features), "doc_id bigint, text_hash bigint, hits array<int>"), "hits")
    at = F.array(*(F.lit(v) for v in voters))
    fired = stored(hits.select(F.array_intersect("hits", at).alias("hits")).groupBy("hits").count(), "votes")
    pairs = (
        fired.select("count", F.explode("hits").alias("i"), "hits").select("count", "i", F.explode("hits").alias("j")).groupBy("i", "j").agg(F.sum("count").alias("n"))
    )
    place = {v: k for k, v in enumerate(voters)}
    second = np.zeros((len(voters), len(voters)))
    for r in pairs.collect():  # at most the square of max_voters
        second[place[r["i"]], place[r["j"]]] = r["n"]
    n = fired.agg(F.sum("count")).first()[0] or 0
    model = fit_label_model(n, second, balance)
    # the classifier learns the label model's posterior on documents of all kinds
    free = F.coalesce(~held_out(F.col("doc_id")), F.lit(True))
    taken = hits.where(free & _part(F.struct("doc_id", "text_hash"), min(1.0, max_rows / max(1, n)), "training")).select("hits").collect()
    seen = _votes([r["hits"] for r in taken], len(features))
    if len(seen):
        w, bias = fit_linear(seen.astype(np.float64), model.posterior(seen[:, voters]), np.ones(len(seen)))
    else:
        w, bias = np.zeros(len(features)), model.bias
        w[voters] = model.weight
    slope, shift = fit_scale(votes @ w + bias, truth)
    if nt and no:  # the examples hold another share of toxic rows than the labels do
        shift += math.log(share[0] / share[1])
    return ToxicityModel(features, w * slope, bias * slope + shift, [features[v] for v in voters], model), hits


def _votes(hits: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros((len(hits), n), dtype=np.float32)
    for k, own in enumerate(hits):
        out[k, own] = 1
    return out


def _chosen_voters(votes: np.ndarray, truth: np.ndarray, features: list[str], most: int) -> list[int]:
    """Lexicon and patterns, then mined features that add the most uncovered toxic rows net of other rows."""
    voters = [k for k, f in enumerate(features) if f in LEXICON or f in PATTERNS]
    good, bad = votes[truth].astype(bool), votes[~truth].sum(axis=0)
    uncovered = np.full(len(good), 2)  # a row asks for two voters, so that voters overlap and can be compared
    uncovered -= np.minimum(2, good[:, voters].sum(axis=1)).astype(int)
    while len(voters) < most and len(good):
        gain = (good * (uncovered > 0)[:, None]).sum(axis=0) - 3.0 * bad
        gain[voters] = -np.inf
        best = int(gain.argmax())
        if gain[best] < 2:
            break
        voters.append(best)
        uncovered = np.maximum(0, uncovered - good[:, best])
    return voters


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher is likelier toxic), predicted (1 from ``threshold`` on), text_hash.

    The whole text is scored. A null or empty text has the score of a text without any feature; a null doc_id is
    not held out; repeated rows are scored each; other columns are not read. An empty table gives no rows.
    """
    model, hits = fit_toxicity(docs, labels)
    scored = hits.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.of_hits(F.col("hits")).alias("score"), "text_hash")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")
