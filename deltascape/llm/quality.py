"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, word pairs and character n-grams; a softmax over a
linear layer gives the classes. Vectors and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. As the layer is linear, a trained model folds into one number per bucket, and scoring
is a sum over a text's features.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, is_training, select_present, splitmix

#: The most labelled rows that the fit reads, chosen by hash of the id.
SAMPLE_ROWS = 4000
#: Buckets of each kind of feature; vector length; passes; first step size.
BUCKET_BITS, DIM, EPOCHS, STEP = 16, 8, 6, 0.5
NGRAMS = (3, 5)
KINDS = len(NGRAMS) + 2
THRESHOLD = 0.5
#: Code points of a text handled at once; sums over parts add up.
PART = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(PART + 2, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)


def _words(points: np.ndarray, space: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between white space."""
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = splitmix(points.astype(np.uint64) + _ODD)
        place = np.arange(len(points)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(points)]))))
        terms = mixed * _powers()[place]
        return splitmix(np.add.reduceat(np.where(space, np.uint64(0), terms), starts))


def features(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's features, with repeats, in parts of PART code points."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    top, shift = np.uint64(1 << BUCKET_BITS), np.uint64(64 - BUCKET_BITS)
    at = 0
    while at < len(points):
        end = min(at + PART, len(points))
        if end < len(points):  # end a part behind white space where it has any
            gaps = np.flatnonzero(points[at:end] <= 32)
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        part = points[at:end]
        space = (part == 32) | ((part >= 9) & (part <= 13))
        words = _words(part, space)
        found = [words >> shift]
        with np.errstate(over="ignore"):
            if len(words) > 1:
                pair = np.where(words[1:] == words[:-1], np.uint64(7), words[1:] + words[:-1] * np.uint64(3))  # a repeated word is one feature
                found.append((splitmix(pair) >> shift) + top)
            padded = np.concatenate(([32], np.where(space, 32, part), [32])).astype(np.uint64)
            for kind, n in enumerate(NGRAMS, 2):
                if len(padded) >= n:
                    h = padded[: len(padded) - n + 1].copy()
                    for j in range(1, n):
                        h = h * np.uint64(0x100000001B3) ^ padded[j : len(padded) - n + 1 + j]
                    found.append(((h * _ODD) >> shift) + top * np.uint64(kind))
        yield np.concatenate(found).astype(np.int32)
        at = end


def feature_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    parts = list(features(text))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, counts = np.unique(np.concatenate(parts), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """A number per bucket and an offset: their mean over a text's features is the log odds of label 1."""
    size = KINDS << BUCKET_BITS
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(size, np.float32), float(0 if not len(labels) else 8 * labels[0] - 4)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    layer, offset = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            ids, counts = bags[i]
            rate, done = STEP * (1 - done / steps), done + 1
            if not len(ids):
                continue
            share = counts / counts.sum()
            hidden = share @ vectors[ids]
            logits = layer @ hidden + offset
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = p @ layer
            layer -= rate * np.outer(p, hidden)
            offset -= rate * 0.1 * p
            vectors[ids] -= (rate * len(ids) ** 0.5) * np.outer(share, back).astype(np.float32)
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(offset[1] - offset[0])


def score_texts(texts: pd.Series, weights: np.ndarray, offset: float) -> np.ndarray:
    """Probability of label 1 for each text; an empty or null one has the offset alone."""
    logits = np.empty(len(texts))
    for i, text in enumerate(texts):
        total, n = 0.0, 0
        for part in features(text):
            total += float(weights[part].sum(dtype=np.float64))
            n += len(part)
        logits[i] = offset + total / max(n, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(logits, -50, 50)))


def sampled_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id and label of at most `rows` training rows, the first by hash of the id; repeated ids count once."""
    own = select_present(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & is_training(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Fits on at most `rows` labelled documents whose ids are for training; an id that rows repeat has its least text."""
    sample = F.broadcast(sampled_labels(labels, label, rows))

    def bag(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [feature_counts(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "ids": [a.tobytes() for a, _ in both], "counts": [b.tobytes() for _, b in both]})

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        got = frame.sort_values("doc_id")
        bags = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(got["ids"], got["counts"], strict=True)]
        weights, offset = fit(bags, got["label"].to_numpy(int))
        return pd.DataFrame({"weights": [weights.tobytes()], "offset": [offset]})

    # the sample is bounded, so one task holds it; the driver gets the folded model alone
    key = docs.schema["doc_id"].dataType.simpleString()
    texts = select_present(docs, "doc_id", "text").join(sample, "doc_id")
    # of rows that repeat an id the one with the least text counts, whatever order they come in
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    bags = texts.mapInPandas(bag, f"doc_id {key}, label int, ids binary, counts binary")
    model = bags.groupBy(F.lit(1).alias("all")).applyInPandas(learn, "weights binary, offset double").first()
    if model is None:
        return fit([], np.zeros(0, int))
    return np.frombuffer(model["weights"], np.float32), model["offset"]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, names: tuple[str, str] = ("_score", "_predicted")) -> DataFrame:
    """docs' columns and, of every row, the probability of label 1 and the prediction, in columns of the given names;
    where docs has such columns, underscores are added (see fresh).

    Only text is an input of a score. Null and empty texts get the offset's score; without training rows of both
    classes all texts get one score. Rows that repeat an id each have a score. An empty table gives no rows.
    """
    weights, offset = train(docs, labels, label, rows)
    score, predicted = fresh(docs, *names)
    model = docs.sparkSession.sparkContext.broadcast((weights, offset))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(texts, *model.value))

    return docs.withColumn(score, F.pandas_udf(scored, "double")("text")).withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier accepts; the columns stay as they are."""
    names = fresh(docs, "score", "predicted")
    return classify(docs, labels, names=tuple(names), **options).filter(F.col(names[1]) == 1).select(*docs.columns)
