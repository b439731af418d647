"""Quality classifier by supervised subword embeddings.

A text is the bag of its words, its pairs of neighbouring words (a word said twice running is the
same pair for all words) and the character n-grams of its words (with their edges), each hashed to
a learned vector. The mean of these vectors goes through
a softmax. Vectors and output are trained together by stochastic gradient descent in numpy.

Output is linear in the mean, so for prediction each bucket is reduced to one number a class, and
a text costs one look-up an n-gram. Whole texts are read in both steps. The training sample is
bounded by about ``ROWS`` rows a class and ``BYTES`` of text in all, drawn by a hash of the id from
the texts that take at most a 64th of these bytes; classes drawn at different rates are put right
by their counts in the corpus.

Null, empty and wordless texts have the end mark alone and get its score. Where nothing is
labelled every score is 0.5; where one class is, it is certain. Rows that repeat an id are scored
one by one; an id with contradicting labels teaches nothing. A null id is never learned from. An
empty table gives an empty one. Other columns, whatever their names, are not looked at. A task
holds one text at a time beyond ``CHUNK_BYTES``, at about 100 bytes of memory a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rosterlens.llm.common import U64, hand_out, mixed, powers, rows, slices

BUCKETS_LOG2 = 17
DIMENSIONS = 16
NGRAMS = (3, 4, 5)       # characters, the edges of a word included
ROWS = 4_000             # labelled rows a class that are learned from, at most about
BYTES = 8 << 20          # bytes of their texts, at most about, half for each class
EPOCHS = 8
RATE = 0.5
END = 0                  # bucket of the mark that every text has

_STEP = U64(0x9E3779B97F4A7C15)
_SPREAD = tuple(U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                                 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def _bucket(value: np.ndarray, kind: int, log2: int) -> np.ndarray:
    return ((value * _SPREAD[kind]) >> U64(64 - log2)).astype(np.int64)


def features(texts: list[str], log2: int = BUCKETS_LOG2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, text)`` of every word, word pair, n-gram and end mark, kind by kind."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    symbol = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"),
                           np.uint32).astype(U64)
    gap = (symbol == 32) | ((symbol >= 9) & (symbol <= 13))
    symbol[gap] = U64(32)
    text = np.repeat(np.arange(len(texts)), sizes + 1) if len(texts) else np.zeros(0, np.int64)
    text = np.concatenate((text, [max(len(texts) - 1, 0)]))   # of the symbol before each place
    yield np.full(len(texts), END), np.arange(len(texts))

    edge = np.flatnonzero(np.diff(gap, prepend=True))
    begin = edge[::2]
    if len(begin):
        value = mixed(symbol * _STEP)
        value[gap] = U64(0)
        n = len(value)
        word = mixed(np.add.reduceat(value * powers(n), begin) * powers(n, inverse=True)[begin])
        owner = text[begin - 1]
        yield _bucket(word, 0, log2), owner
        both = owner[1:] == owner[:-1]
        pair = mixed(word[:-1] * _STEP + word[1:])
        pair[word[:-1] == word[1:]] = _STEP      # a word said again, whatever it is
        yield _bucket(pair[both], 1, log2), owner[1:][both]
    inside = np.cumsum(gap)
    total = symbol.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(symbol) < n:
            return
        total = total[:len(symbol) - n + 1] * _STEP + symbol[n - 1:]
        if n in NGRAMS:
            whole = np.flatnonzero(inside[n - 2:len(symbol) - 1] == inside[:len(symbol) - n + 1])
            yield _bucket(mixed(total[whole]), 2 + n % 3, log2), text[whole]


def bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text, and how often it has them."""
    found = list(features(texts))
    key = np.concatenate([t * (1 << BUCKETS_LOG2) + b for b, t in found])
    key, count = np.unique(key, return_counts=True)
    first = np.searchsorted(key, np.arange(len(texts) + 1) << BUCKETS_LOG2)
    bucket = (key & ((1 << BUCKETS_LOG2) - 1)).astype(np.uint32)
    for a, b in zip(first, first[1:]):
        yield bucket[a:b], count[a:b].astype(np.float32)


@dataclass(frozen=True)
class Model:
    """``logit[bucket, class]`` and what is added for each class."""

    classes: list[int]
    logit: np.ndarray
    prior: np.ndarray

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Softmax over the classes, a row for each text."""
        out = np.zeros((len(texts), len(self.classes)))
        n = np.zeros(len(texts))
        for bucket, text in features(texts):
            n += np.bincount(text, minlength=len(texts))
            for k in range(len(self.classes)):
                out[:, k] += np.bincount(text, self.logit[bucket, k], len(texts))
        return softmax(out / n[:, None] + self.prior)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def trained(bags_of: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int,
            epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """``logit[bucket, class]`` after stochastic gradient descent, one text a step.

    The order of the texts is drawn from a fixed seed; the rate falls to zero.
    """
    rng = np.random.default_rng(1)
    vectors = rng.uniform(-1, 1, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output = np.zeros((classes, DIMENSIONS), np.float32)
    steps, step = epochs * len(bags_of), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags_of)):
            bucket, count = bags_of[i]
            weight = (count / count.sum())[:, None]
            hidden = (vectors[bucket] * weight).sum(0)
            miss = -softmax(output @ hidden)
            miss[target[i]] += 1
            miss *= rate * (1 - step / steps)
            back = miss @ output
            output += miss[:, None] * hidden
            # the mean passes on its gradient in parts; scaled by their number, rare words learn
            vectors[bucket] += weight * (back * np.sqrt(len(bucket)))
            step += 1
    return vectors.astype(np.float64) @ output.T.astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, train: Column, rows_per_class: int = ROWS,
        total_bytes: int = BYTES) -> Model:
    """Learn from texts of ``docs`` at ``train`` and ``doc_id, label`` (0 or 1) of ``labels``."""
    hand_out(docs.sparkSession)
    agreed = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.min("label").cast("int").alias("label"),
                               F.max("label").alias("most")).where("label = most").drop("most")
    texts = docs.where(train).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(agreed, "doc_id")
    short = F.col("bytes") <= total_bytes // 64
    found = sizes.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(short).alias("short"),
        F.sum(F.when(short, F.col("bytes"))).alias("bytes")).collect()   # one row a class
    share = F.lit(0.0)
    for r in found:
        least = min(rows_per_class / max(r["short"], 1), total_bytes / 2 / max(r["bytes"] or 0, 1))
        share = F.when(F.col("label") == r["label"], least).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    chosen = sizes.where(short & (place < share)).select("doc_id", "label").distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(bags(batch.column("text").to_pylist()))
            yield rows(doc_id=batch.column("doc_id"), label=batch.column("label"),
                       bucket=pa.array([b.tobytes() for b, _ in found], pa.binary()),
                       count=pa.array([c.tobytes() for _, c in found], pa.binary()))

    # about 2 x ROWS ids are broadcast, and the buckets of about BYTES of text come back
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(
        counted, "doc_id long, label int, bucket binary, count binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("bucket", "ascending")])
    label = got.column("label").to_numpy()
    classes = sorted(set(label.tolist()))
    if len(classes) < 2:
        return Model(classes or [0, 1], np.zeros((1 << BUCKETS_LOG2, len(classes) or 2)),
                     np.zeros(len(classes) or 2))
    target = np.searchsorted(classes, label)
    drawn = [(np.frombuffer(b, np.uint32), np.frombuffer(c, np.float32))
             for b, c in zip(got.column("bucket").to_pylist(), got.column("count").to_pylist())]
    size = {r["label"]: r["n"] for r in found}
    return Model(classes, trained(drawn, target, len(classes)), np.log(
        [size[c] / n for c, n in zip(classes, np.bincount(target))]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``: probability of class 1 for every row, from the whole text alone."""
    hand_out(docs.sparkSession)
    handed = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket and class

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sure = handed.value.probabilities(texts)
            one = sure[:, handed.value.classes.index(1)] if 1 in handed.value.classes \
                else np.zeros(len(texts))
            yield rows(doc_id=batch.column("doc_id"), score=one)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        of, "doc_id long, score double")
