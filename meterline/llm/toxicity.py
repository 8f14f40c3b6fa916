"""Toxicity categories by a chain of linear classifiers.

The categories are predicted one after the other: each is a logistic regression over the words (and
their four- and five-character beginnings) that tell most about it, plus the probabilities of the
categories before it.  Those probabilities are out-of-fold in training (the held-out documents have
no say in the choice of words either), so a later model learns from errors like those it will meet (Read et al., "Classifier Chains for Multi-label
Classification", with stacked out-of-fold inputs).

The chain is fitted on at most `sample_rows` labelled documents, as many positive ones of `balance`
as there are up to half, chosen by the hash of their ids; everything else runs over all documents
in Spark tasks.

Null and empty texts have no words and get the model's prior; labels that are null count as 0 and
repeated labels of an id as their greatest; documents of a repeated id are judged each on its own
text, and of these the text of the least hash is learnt from; without labels, or with one class only, a category's probability is its share among the
labels (0 if there are none); other columns of `docs` pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encode_words, steps

_PART = re.compile(r"\w+")


def _features(token: str) -> set[str]:
    """A token's features: its words and how they begin."""
    out = set()
    for w in _PART.findall(token.lower()):
        out.add(w)
        out.update(w[:n] + "*" for n in (4, 5) if len(w) >= n)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Link:
    """One category's model: weights of the features and of the earlier probabilities."""

    name: str
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float


@dataclass
class Chain:
    features: dict[str, int]
    links: list[Link]

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """One column a category, for n documents whose (row, feature) pairs are given once each."""
        out = np.empty((n, len(self.links)))
        for k, link in enumerate(self.links):
            sums = np.bincount(row, link.weights[feature], n) if len(row) else np.zeros(n)
            out[:, k] = _sigmoid(sums + out[:, :k] @ link.earlier + link.bias)
        return out


def _fit(row: np.ndarray, feature: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, chosen: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """L2-regularised logistic regression by Adam over the `chosen` documents."""
    share = y[chosen].mean() if chosen.any() else 0.0
    if share in (0.0, 1.0):
        return np.zeros(width), np.zeros(dense.shape[1]), -30.0 if share == 0 else 30.0
    keep = chosen[row]
    row, feature, n = row[keep], feature[keep], len(y)
    w = np.zeros(width + dense.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = chosen.sum()
    for t in range(1, rounds + 1):
        score = np.bincount(row, w[:width][feature], n) + dense @ w[width:-1] + w[-1]
        miss = np.where(chosen, _sigmoid(score) - y, 0.0) / total
        g = np.concatenate((np.bincount(feature, miss[row], width), dense.T @ miss, [miss.sum()]))
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:width], w[width:-1], float(w[-1])


def _best_threshold(p: np.ndarray, y: np.ndarray, precision: float = 0.85) -> float:
    """The middle of the gap at the best F1 of the out-of-fold probabilities at which `precision`
    holds; one half where it never does."""
    order = np.argsort(-p, kind="stable")
    right, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    f1 = np.where(last & (right >= precision * taken), 2 * right / (taken + max(y.sum(), 1)), 0)
    k = int(np.argmax(f1))
    if not f1[k]:
        return 0.5
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + after) / 2)


def _sample(docs: DataFrame, labels: DataFrame, categories: list[str], balance: str, sample_rows: int) -> list:
    """(categories..., features) of the chosen documents."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories])

    def some(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    chosen = some(known.where(F.col(balance) == 1), sample_rows // 2).unionByName(some(known.where(F.col(balance) == 0), sample_rows - sample_rows // 2))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", *categories).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            held = [sorted(set().union(*map(_features, set(t.split())))) if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["doc_id", *categories]), pa.array(held, pa.list_(pa.string()))], ["doc_id", *categories, "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} int" for c in categories) + ", features array<string>"
    return texts.select("doc_id", "text", *categories).mapInArrow(run, schema).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()


def _best_features(row: np.ndarray, feature: np.ndarray, width: int, y: np.ndarray, inside: np.ndarray, most: int) -> np.ndarray:
    """The features that tell most about a category in the documents `inside`."""
    n, own = int(inside.sum()), inside[row]
    row, feature = row[own], feature[own]
    seen, best = np.bincount(feature, minlength=width), np.zeros(width)
    for k in range(y.shape[1]):  # chi-squared of each feature with each category
        with_it, share = np.bincount(feature, y[row, k], width), y[inside, k].mean() if n else 0.0
        if 0 < share < 1:
            expected = seen * share
            chi2 = (with_it - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - seen / n), 1e-9)
            best = np.maximum(best, np.where((seen >= 3) & (seen < n), chi2, 0))
    top = np.argsort(-best, kind="stable")[:most]
    return top[best[top] > 10.83]  # p < 0.001


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], balance: str, sample_rows: int = 6000, features: int = 2048, folds: int = 5, rounds: int = 120) -> Chain:
    """Fit the chain in the order of `categories`, 0/1 columns of `labels` beside doc_id."""
    rows = _sample(docs, labels, categories, balance, sample_rows)
    n = rows.num_rows
    lists = rows["features"].combine_chunks()
    coded = lists.flatten().dictionary_encode() if n else pa.array([], pa.string()).dictionary_encode()
    feature = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets.to_numpy())) if n else np.empty(0, np.int32)
    y = np.stack([rows[c].to_numpy() for c in categories], axis=1).astype(float) if n else np.empty((0, len(categories)))
    width = len(coded.dictionary)
    del rows, lists
    fold = np.arange(n) % folds
    tops = [_best_features(row, feature, width, y, fold != f, features) for f in range(folds)]
    top = _best_features(row, feature, width, y, np.ones(n, bool), features)

    def among(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the pairs whose features are in `kept`."""
        place = np.full(width, -1, np.int32)
        place[kept] = np.arange(len(kept))
        held = place[feature] >= 0
        return row[held], place[feature[held]]

    prior, links = np.empty((n, 0)), []
    for k, name in enumerate(categories):
        if not n:
            links.append(Link(name, np.zeros(0), np.zeros(k), -30.0, 0.5))
            continue
        held_out = np.zeros(n)
        for i, kept in enumerate(tops):  # features, too, are chosen without the fold that is held out
            r, f = among(kept)
            w, e, b = _fit(r, f, len(kept), prior, y[:, k], fold != i, rounds)
            held_out += np.where(fold == i, _sigmoid(np.bincount(r, w[f], n) + prior @ e + b), 0)
        w, e, b = _fit(*among(top), len(top), prior, y[:, k], np.ones(n, bool), rounds)
        links.append(Link(name, w, e, b, _best_threshold(held_out, y[:, k]) if y[:, k].any() else 0.5))
        prior = np.column_stack((prior, held_out))
    names = coded.dictionary.take(pa.array(top, pa.int64())).to_pylist()
    return Chain({f: i for i, f in enumerate(names)}, links)


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """`docs` with p_<category> double and is_<category> boolean for each category."""
    named = [f"{how}_{link.name}" for how in ("p", "is") for link in chain.links]
    docs = docs.drop(*named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in steps(batches):
            distinct, index, offsets = encode_words(b.column("text"))
            if len(known) > 500_000:
                known.clear()
            held = []
            for t in distinct.to_pylist():
                of = known.get(t)
                if of is None:
                    of = known[t] = tuple(chain.features[f] for f in _features(t) if f in chain.features)
                held.append(of)
            size = np.fromiter(map(len, held), np.int64, len(held))
            flat = np.fromiter((f for of in held for f in of), np.int64, int(size.sum()))
            start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            some = size[index] > 0
            index, row = index[some], row[some]
            n = size[index]
            at = np.repeat(start[index] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else n
            pairs = np.unique(np.repeat(row, n) * max(1, len(chain.features)) + flat[at]) if len(n) else n
            row, feature = np.divmod(pairs, max(1, len(chain.features)))
            p = chain.probabilities(row, feature, b.num_rows)
            columns = [pa.array(p[:, k]) for k in range(len(chain.links))]
            columns += [pa.array(p[:, k] >= link.threshold) for k, link in enumerate(chain.links)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *named])

    kinds = [T.DoubleType()] * len(chain.links) + [T.BooleanType()] * len(chain.links)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(named, kinds))])
    return docs.mapInArrow(run, schema)
