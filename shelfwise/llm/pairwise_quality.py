"""Quality scores by Bradley-Terry pairwise ranking.

A labelled good document is preferred to a labelled bad one. The score of a document is linear in the features
of its text, and the chance that it wins over another is the logistic function of the difference of the scores;
so the weights come from logistic loss on differences of features. The threshold is a quantile of the scores of
the training documents: the share of bad ones among them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import add_columns, unused
from shelfwise.llm.words import NOT_BLANK, join_hashes, read_words

#: Scores from here on are accepted.
ACCEPT = 0.7
#: Most labelled documents to learn from, and most preference pairs among them.
MOST_DOCUMENTS, MOST_PAIRS = 20_000, 200_000

_CLASSES = {
    "letters": "abcdefghijklmnopqrstuvwxyz", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "stops": ".,;:",
    "marks": "!?", "symbols": "#*$%&|<>", "brackets": "()[]{}", "other": "\"'`~^_+-=/\\@", "blanks": " \t", "lines": "\n",
}


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text: shares of kinds of characters, lengths, and repetition of words and lines."""
    words = read_words(texts, NOT_BLANK)
    n, counts = len(texts), words.counts()
    size, some = np.maximum(1, np.diff(words.offsets)), np.maximum(1, counts)

    def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])

    out = [np.log1p(counts), np.log1p(size)]
    for members in _CLASSES.values():
        table = np.zeros(256, bool)
        table[[ord(c) for c in members]] = True
        share = per_text(table[words.data], words.offsets) / size
        out += [share, np.log(1e-3 + share)]
    length = words.end - words.start
    out += [per_text(length, words.first) / some, per_text(length == 1, words.first) / some, per_text(length > 15, words.first) / some]
    whose = words.text_of()
    again = np.zeros(len(whose), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (whose[1:] == whose[:-1])
    for run in (again, _seen(whose, words.hash)):
        share = per_text(run, words.first) / some
        out += [share, np.log(1e-2 + share)]
    pair = np.zeros(len(whose), bool)
    if len(whose) > 1:
        pair[1:] = _seen(whose[1:], join_hashes(words.hash[:-1], words.hash[1:]))
    out.append(per_text(pair, words.first) / some)
    return np.column_stack(out) if n else np.empty((0, len(out)))


def _seen(whose: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the same text has the same value at an earlier place."""
    order = np.lexsort((value, whose))
    out = np.zeros(len(order), bool)
    w, v = whose[order], value[order]
    out[order[1:]] = (w[1:] == w[:-1]) & (v[1:] == v[:-1])
    return out


@dataclass
class PairwiseModel:
    """Weights of standardized features, and the score at which documents are accepted."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``ACCEPT`` at the threshold."""
        at = self.raw(x) - self.threshold + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7, penalty: float = 1e-3, most_pairs: int = MOST_PAIRS) -> PairwiseModel:
    """Logistic loss on feature differences of (good, bad) pairs, by Newton's method.

    Without a good or without a bad document there is no pair: all scores are equal and accepted.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model = PairwiseModel(mean, scale, np.zeros(x.shape[1]), 0.0)
    high, low = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(high) or not len(low):
        return model
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    n = min(most_pairs, 10 * len(x))
    delta = z[draw.choice(high, n)] - z[draw.choice(low, n)]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(delta @ model.weights, -30, 30)))  # chance of the wrong order
        gradient = penalty * model.weights - delta.T @ p / n
        curve = (delta * (p * (1 - p))[:, None]).T @ delta / n + penalty * np.eye(len(mean))
        step = np.linalg.solve(curve, gradient)
        model.weights = model.weights - step
        if np.abs(step).max() < 1e-6:
            break
    model.threshold = float(np.quantile(model.raw(x), len(low) / len(x), method="midpoint"))
    return model


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most: int = MOST_DOCUMENTS
) -> PairwiseModel:
    """Fit on labelled documents outside the held-out quarter: at most ``most`` of them, those first by a hash of their id.

    Only ids and features of that bounded sample come to the driver; its ids are broadcast. Rows with a null id or
    label teach nothing; a document with several labels counts as bad if one says so; repeated documents count once.
    """
    chosen = (
        labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").alias("label"))
        .dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    ids = {r["doc_id"]: int(r["label"]) for r in chosen.collect()}
    spark = docs.sparkSession
    sample = spark.createDataFrame(list(ids.items()), "doc_id long, label int")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    labelled = texts.join(F.broadcast(sample), "doc_id")
    field = T.StructField("features", T.ArrayType(T.DoubleType()))
    made = add_columns(
        labelled, "text", ["doc_id", "label"], [field], lambda t: [pa.array(list(features(t)), pa.list_(pa.float64()))]
    )
    # rows of one id count once: the smallest by value, whatever the order of the rows
    rows = made.groupBy("doc_id").agg(F.min(F.struct("features", "label")).alias("row")).select("doc_id", "row.*")
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    width = features(pa.array([b""], pa.large_binary())).shape[1]
    x = np.array([r["features"] for r in rows]).reshape(-1, width)
    return fit(x, np.array([r["label"] == 1 for r in rows], bool))


def held_out(doc_id):
    """The quarter of ids never learnt from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: PairwiseModel, keep: list[str], text: str = "text") -> tuple[DataFrame, str]:
    """``keep`` columns and the score of every whole text; the name of the score column, which avoids those in ``keep``.

    Null and empty texts get the score of a text without words. No shuffle; a row stays a row.
    """
    name = unused(docs.select(*(F.col(f"`{c}`") for c in keep)), "score")
    made = add_columns(docs, text, keep, [T.StructField(name, T.DoubleType())], lambda t: [pa.array(model.score(features(t)), pa.float64())])
    return made, name
