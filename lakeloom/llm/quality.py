"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, of the words' character n-grams and of its word bigrams, all hashed into a
fixed number of buckets, and of tokens that tell for each word how far back it last stood (by powers of two), as no n-gram of given words
tells repetition from prose in words never seen; a softmax layer gives the class. Training is plain stochastic gradient descent in numpy on a
bounded sample of labelled rows (``TRAIN_ROWS``), whole texts. Scoring a document of n words takes one table lookup a word and one a
bigram, because the softmax of two classes needs only the sum of the vectors along one direction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import slices

#: Buckets of words and n-grams, behind them those of word bigrams, and behind these those of distances.
BUCKETS, BIGRAMS, DISTANCES = 1 << 16, 1 << 16, 24
SIZE = BUCKETS + BIGRAMS + DISTANCES
DIM = 12
NGRAMS = (2, 3, 4)
EPOCHS = 6
RATE = 0.2
#: At most so many labelled rows are learned from, those with the smallest hashes of their ids.
TRAIN_ROWS = 3000
THRESHOLD = 0.3
MEMO_WORDS = 300_000
#: A feature that every document has, so that an empty one has a vector too.
ALWAYS = 0


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, the word's ends marked. Very long words count by their n-grams too."""
    marked = f"<{word}>".encode()
    grams = [marked, *(marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1))]
    return [zlib.crc32(g) % (BUCKETS - 1) + 1 for g in grams]


class Vocabulary:
    """Numbers of words, with a 64-bit hash and a feature count of each and what ``value`` makes of its features; of bounded size."""

    def __init__(self, value, kind) -> None:
        self.value, self.kind = value, kind
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.values, self.hashes, self.counts = np.zeros(1024, self.kind), np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def __call__(self, words: list[str]) -> np.ndarray:
        """The words' numbers, which hold until the next call of ``trim``."""
        for w in set(words).difference(self.numbers):
            n = self.numbers[w] = len(self.numbers)
            if n == len(self.hashes):
                self.values, self.hashes, self.counts = (np.r_[x, np.zeros_like(x)] for x in (self.values, self.hashes, self.counts))
            found = word_features(w)
            self.values[n] = self.value(found)
            self.hashes[n], self.counts[n] = zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 % (1 << 64), len(found)
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        if len(self.numbers) > MEMO_WORDS:
            self.clear()

    def bigrams(self, numbers: np.ndarray) -> np.ndarray:
        """The buckets of all pairs of neighbouring words."""
        h = self.hashes[numbers]
        pair = (h[:-1] ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        return (BUCKETS + (pair >> np.uint64(40)) % np.uint64(BIGRAMS)).astype(np.int64)


def distances(numbers: np.ndarray) -> np.ndarray:
    """The buckets of all words' distances from where they last stood; a word's first place has none."""
    order = np.argsort(numbers, kind="stable")
    again = numbers[order[1:]] == numbers[order[:-1]]
    gap = order[1:][again] - order[:-1][again]
    return BUCKETS + BIGRAMS + np.minimum(np.frexp(gap)[1] - 1, DISTANCES - 1)


class Features:
    """Sparse features of texts."""

    def __init__(self) -> None:
        self.words = Vocabulary(lambda found: found, object)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets and their shares; the shares add up to 1."""
        self.words.trim()
        numbers = self.words((text or "").split())
        found = [ALWAYS, *chain.from_iterable(self.words.values[numbers].tolist())]
        found = np.r_[np.array(found, np.int32), self.words.bigrams(numbers).astype(np.int32), distances(numbers).astype(np.int32)]
        buckets, counts = np.unique(found, return_counts=True)
        return buckets, (counts / len(found)).astype(np.float32)


@dataclass
class Model:
    """What scoring needs: for each bucket its vector's part along the difference of the classes, and the difference's bias."""

    direction: np.ndarray
    bias: float

    def logit(self, buckets: np.ndarray, shares: np.ndarray) -> float:
        return float(self.direction[buckets] @ shares) + self.bias


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Fit to (buckets, shares, class) rows. With rows of one class or none the score is the smoothed share of class 1."""
    ones = sum(y for *_, y in rows)
    if not 0 < ones < len(rows):
        return Model(np.zeros(SIZE, np.float32), float(np.log((ones + 1) / (len(rows) - ones + 1))))
    random = np.random.default_rng(seed)
    table = (random.random((SIZE, DIM), np.float32) - 0.5) / DIM
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            buckets, shares, y = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            vector = shares @ table[buckets]
            z = out @ vector + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * np.outer(p, vector)
            bias -= rate * p
            # Rows are touched once a step (buckets are distinct). The mean's gradient is scaled up to the words' own rate.
            table[buckets] -= (rate * shares * min(len(buckets), 50))[:, None] * back
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]))


def training_rows(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable, limit: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and classes of at most ``limit`` labelled rows. Several labels of one key: the majority, 1 if as many."""
    votes = labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & usable(F.col(f"`{key}`"))).groupBy(F.col(f"`{key}`").alias("k")).agg((F.avg(F.col(f"`{label}`")) >= 0.5).cast("int").alias("y"))
    chosen = votes.orderBy(F.xxhash64("k"), "k").limit(limit)
    # Of rows that repeat a key one text is learned from.
    texts = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("x")).join(F.broadcast(chosen), "k")
    texts = texts.groupBy("k", "y").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    schema = "k string, y int, buckets binary, shares binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in slices(batch, "x"):
                found = [features(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())], ["k", "y", "buckets", "shares"])

    # ``chosen`` has at most ``limit`` rows of a key and a class, which bounds what is broadcast and what comes to the driver.
    joined = texts.select(F.col("k").cast("string"), "y", "x").mapInArrow(run, schema)
    rows = sorted(joined.collect(), key=lambda r: (zlib.crc32(r.k.encode()), r.k, bytes(r.buckets)))
    return [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.shares, np.float32), r.y) for r in rows]


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Adds ``column``, the probability of class 1, from the whole text. Null counts as empty; a column of that name is replaced."""
    others = [f for f in df.schema.fields if f.name.lower() != column.lower()]
    names = [f.name for f in others]
    schema = T.StructType([*others, T.StructField(column, T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast((model.direction.astype(np.float64), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        direction, bias = shared.value
        vocabulary = Vocabulary(lambda found: direction[found].sum(), float)
        for batch in batches:
            for part in slices(batch, text):
                vocabulary.trim()
                scores = []
                for x in part.column(names.index(text)).to_pylist():
                    numbers = vocabulary((x or "").split())
                    pairs = np.r_[vocabulary.bigrams(numbers), distances(numbers)]
                    total = direction[ALWAYS] + vocabulary.values[numbers].sum() + direction[pairs].sum()
                    z = total / (1 + vocabulary.counts[numbers].sum() + len(pairs)) + bias
                    scores.append(1 / (1 + np.exp(-z)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(scores, pa.float64())], schema.names)

    return df.select(*[df[f"`{x}`"] for x in names]).mapInArrow(run, schema)


def held_out(key) -> F.Column:
    """Whether a row's label is kept for measuring: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = TRAIN_ROWS) -> Model:
    """A model learned from labelled rows that are not held out."""
    return train(training_rows(df, labels, key, text, label, lambda k: ~held_out(k), limit))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``df`` with ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    Rows with a null key are never held out nor learned from. Without usable labels every score is 0.5. Columns of ``df``
    named like the added ones are replaced.
    """
    base = df.drop("held_out", "score", "predicted")
    scored = score(base, fit(base, labels, key, text, label), text)
    return scored.withColumn("held_out", F.coalesce(held_out(F.col(f"`{key}`")), F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


