"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. One binary classifier per bit, a linear model on hashed
byte n-grams, says how strongly a text leans to the languages whose codeword has that bit set.
Loss-weighted decoding adds the losses of all bits against each codeword; the nearest one wins,
and a text almost as near to a second one is flagged as ambiguous.

Rows keep their other columns out of the result, so clashing names do no harm. A null text, or
one without any letter, is ``und`` with score 0; so is everything if nothing was learned. Of languages
that are equally near the first in order of name wins, and the text is flagged. Repeated rows are
told one by one; a null id stays null. An empty table gives an empty one. A text beyond ``CHUNK_BYTES``
is handled whole, in about 100 times its bytes of memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rosterlens.llm.common import U64, hand_out, mixed, named, numbered, pieces, slices

UNKNOWN = "und"
BUCKETS = 1 << 15  # hashed n-grams: the model has BUCKETS x bits weights whatever the input
ORDERS = (2, 3, 4)
ROWS_PER_LANGUAGE = 4000  # bound of the labelled sample that the bit classifiers are fitted on
AMBIGUOUS = 0.02  # least lead of the best codeword, as a share of the largest possible loss
SHARPNESS = 4.0  # scales the mean n-gram evidence before the logistic loss

_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[[i for i in range(128) if not chr(i).isalpha()]] = 32
_NOT_DIGIT = re.compile(r"[^\W\d_]+")


def codewords(languages: int) -> np.ndarray:
    """Bits of each language: an exhaustive code up to seven, else a fixed dense random one.

    Exhaustive: every split of the languages in two, so any two codewords differ in half the bits.
    """
    if languages <= 1:
        return np.ones((languages, 1), bool)
    if languages <= 7:
        splits = [(True, *s) for s in product((True, False), repeat=languages - 1)]
        return np.array([s for s in splits if not all(s)], bool).T
    random = np.random.default_rng(7)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, gap = None, -1
    for _ in range(50):
        code = random.random((languages, bits)) < 0.5
        code[0, code.all(0) | ~code.any(0)] ^= True
        apart = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if apart > gap:
            best, gap = code, apart
    return best


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for m in _NOT_DIGIT.finditer(text) for c in m.group())


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased texts: bucket and index of the text."""
    coded = [b" " + t.lower().encode() for t in texts]
    size = np.fromiter((len(t) + 1 for t in coded), np.int64, len(coded))
    b = _OTHER[np.frombuffer(b" ".join(coded) + b" ", np.uint8)]
    # runs of other characters count once
    keep = (b != 32) | np.concatenate(([True], b[:-1] != 32))
    owner = np.repeat(np.arange(len(coded)), size)[keep]
    b = b[keep].astype(U64)
    bucket, text = [], []
    for n in ORDERS:
        if len(b) < n:
            continue
        value = np.full(len(b) - n + 1, n, U64)
        for i in range(n):
            value = (value << U64(8)) | b[i:len(b) - n + 1 + i]
        inside = owner[:len(value)] == owner[n - 1:]
        bucket.append((mixed(value[inside]) % U64(BUCKETS)).astype(np.int64))
        text.append(owner[:len(value)][inside])
    if not bucket:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(bucket), np.concatenate(text)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # buckets x bits: evidence for a set bit
    trust: np.ndarray     # of each bit's classifier


def fit(docs: DataFrame, train: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from ``text`` and ``lang`` of the rows of ``train`` with both.

    At most about ``rows_per_language`` rows of a language are used, chosen by a hash of the id,
    so a language with a third of all rows costs no more than others.
    """
    hand_out(docs.sparkSession)
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(counts)
    index = {x: i for i, x in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((0, 0), bool), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.lit(1.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, rows_per_language / n).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for pdf in pieces(batch):
                bucket, text = grams(list(pdf["text"]))
                lang = np.array([index[x] for x in pdf["lang"]])
                np.add.at(total, (lang[text], bucket), 1)
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": total[lang, bucket]})

    found = (chosen.select("text", "lang").mapInPandas(counted, "lang int, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # BUCKETS a language
    count = np.zeros((len(languages), BUCKETS))
    count[found["lang"], found["bucket"]] = found["n"]
    return trained(languages, count)


def trained(languages: list[str], count: np.ndarray) -> Model:
    """Bit classifiers from n-gram counts; every language weighs the same."""
    share = count / np.maximum(count.sum(1, keepdims=True), 1)
    code = codewords(len(languages))
    weights, trust = [], []
    for bit in code.T:
        sides = [share[side].mean(0) if side.any() else np.full(BUCKETS, 1 / BUCKETS)
                 for side in (bit, ~bit)]
        one, zero = ((s + 1e-6) / (1 + 1e-6 * BUCKETS) for s in sides)
        weights.append(np.log(one / zero))
        trust.append(((one - zero) * weights[-1]).sum())
    trust = np.array(trust)
    return Model(languages, code, np.array(weights, np.float32).T.copy(),
                 trust / trust.sum() if trust.sum() > 0 else np.full(len(trust), 1 / len(trust)))


def decoded(model: Model, lean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword of each row of bit evidence, its score, and whether it is ambiguous."""
    sign = np.where(model.code, 1.0, -1.0)
    loss = np.logaddexp(0, -SHARPNESS * sign[None] * lean[:, None, :]) @ model.trust
    best = loss.argmin(1)
    near = np.exp((loss.min(1, keepdims=True) - loss) * model.code.shape[1])
    if loss.shape[1] == 1:
        return best, np.ones(len(best)), np.zeros(len(best), bool)
    two = np.partition(loss, 1, 1)
    return best, 1 / near.sum(1), two[:, 1] - two[:, 0] < AMBIGUOUS * loss.max(1)


def judged(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    letters = np.array([has_letter(t) for t in texts], bool)
    name = np.full(len(texts), UNKNOWN, object)
    score, unsure = np.zeros(len(texts)), np.zeros(len(texts), bool)
    if model.languages and letters.any():
        bucket, text = grams([t if ok else "" for t, ok in zip(texts, letters)])
        n = np.maximum(np.bincount(text, minlength=len(texts)), 1)
        lean = np.stack([np.bincount(text, w[bucket], len(texts)) / n for w in model.weights.T], 1)
        best, sure, close = decoded(model, lean)
        name[letters] = np.array(model.languages, object)[best[letters]]
        score[letters], unsure[letters] = sure[letters], close[letters]
    return name, score, unsure


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` from the text alone."""
    hand_out(docs.sparkSession)
    handed = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in pieces(batch):
                name, score, unsure = judged(handed.value, list(pdf["text"]))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": name, "score": score,
                                    "ambiguous": unsure})

    return numbered(named(docs, "text").mapInPandas(
        of, "doc_id string, lang_pred string, score double, ambiguous boolean"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with a language, with all their columns.

    Rejected are texts without letters and those as near to a second codeword. Where nothing
    could be learned, nothing is rejected.
    """
    hand_out(docs.sparkSession)
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            name, _, unsure = judged(handed.value, batch.column("text").to_pylist())
            sure = (name != UNKNOWN) & ~unsure
            yield batch.filter(pa.array(sure)) if handed.value.languages else batch

    return docs.mapInArrow(of, docs.schema)
