"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each coded in the tree of the bytes before it, up to ``DEPTH``
of them. A tree node holds the Krichevsky-Trofimov estimate of its decisions and the weighted
probability of its subtree: half the estimate, half the product over the next deeper contexts.
After training the node's own estimate and what the deeper contexts say are mixed by these
weights, at every depth on the path; a context never met passes its parent's estimate on.

A prediction depends on the last DEPTH bytes and the byte itself only. So all distinct
(context, byte) grams are scored once, and every block of documents gets the grams it holds.

Null texts count as empty: one end token, score 0. Repeated rows are learned from and scored one by
one; a null id stays null. An empty table gives an empty one. Other columns, whatever their names, are
not looked at. A text beyond ``CHUNK_BYTES`` is handled whole, in about 100 times its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rosterlens.llm.common import (Words, block_count, blocked, dropped, numbered, operator, pieces,
                                   signed, stored, texts_of)

DEPTH = 5
ROOT = 2   # subtrees below the contexts of this many bytes are worked on in one task each
BLOCK_BYTES = 16 << 20  # text of a block: larger ones repeat fewer words and grams
CHUNK_BYTES = 1 << 18   # text of a block that is taken apart at once
HELD = 1_500_000        # keys of a block that are held before equal ones are merged
_HALF = np.log(0.5)


# --- Krichevsky-Trofimov ---------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5, by Stirling's series after a shift of eight."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln probability of any sequence with so many zeros and ones."""
    a, b = zeros.astype(float), ones.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and sums of values over equal keys."""
    order = np.argsort(key)   # the order of equal keys does not matter
    key = key[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else \
        np.zeros(0, np.int64)
    return key[begin], *(np.add.reduceat(v[order], begin) if len(begin) else v[:0]
                         for v in values)


# A gram is (c1, c2, .., c_DEPTH, byte) with the latest byte before in c1: contexts that share
# their latest bytes stand together. A node is (context of d bytes) * 256 + place in the tree of
# one byte's decisions: 1 at the root, then 2 * place + bit.

def gram_values(buffer: np.ndarray, depth: int) -> np.ndarray:
    """Gram ending at each byte from ``depth`` on."""
    n = len(buffer) - depth
    value = np.zeros(max(n, 0), np.int64)
    for back in range(1, depth + 1):
        value = (value << 8) | buffer[depth - back:depth - back + n]
    return (value << 8) | buffer[depth:]


def decisions(byte: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Place in the byte's tree and outcome of its decision number ``bit``."""
    return (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1


def leaves(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the deepest contexts with their counts, of grams met in training."""
    gram, n = gram[n > 0], n[n > 0]
    context, byte = gram >> 8, gram & 255
    key, zero, one = [], [], []
    for bit in range(8):
        place, outcome = decisions(byte, bit)
        key.append((context << 8) | place)
        zero.append(np.where(outcome == 0, n, 0))
        one.append(np.where(outcome == 1, n, 0))
    return summed(np.concatenate(key), np.concatenate(zero), np.concatenate(one))


def raised(key: np.ndarray, zero: np.ndarray, one: np.ndarray, weighted: np.ndarray | None):
    """Counts, weighted probability and own weight of nodes, given what their children weigh."""
    own = log_kt(zero, one)
    if weighted is None:
        return own, np.ones(len(key))
    total = np.logaddexp(_HALF + own, _HALF + weighted)
    return total, np.exp(_HALF + own - total)


def subtree(gram: np.ndarray, n: np.ndarray, depth: int, root: int):
    """Levels ``depth`` .. ``root`` of the trees, deepest first, and the root level's children sum.

    Each level: node keys, estimate of a one, own weight. Last: keys, zeros, ones and weighted
    ln probability of the nodes at the root level.
    """
    key, zero, one = leaves(gram, n)
    below, levels = None, []
    for d in range(depth, root - 1, -1):
        weighted, share = raised(key, zero, one, below)
        levels.append((key, (one + 0.5) / (zero + one + 1), share))
        if d > root:
            key, zero, one, below = summed(((key >> 16) << 8) | (key & 255), zero, one, weighted)
    return levels, (key, zero, one, weighted)


def mix_levels(gram: np.ndarray, levels, depth: int, start: np.ndarray | None) -> np.ndarray:
    """Probability of a one at the eight decisions of each gram, mixed over the given levels.

    ``start`` is what deeper levels said (nan: nothing known there).
    """
    out = np.full((len(gram), 8), np.nan) if start is None else start.copy()
    byte = gram & 255
    for down, (key, estimate, share) in enumerate(levels):
        context = gram >> (8 + 8 * down)
        for bit in range(8):
            node = (context << 8) | decisions(byte, bit)[0]
            at = np.searchsorted(key, node)
            at[at == len(key)] = 0
            met = key[at] == node if len(key) else np.zeros(len(node), bool)
            if met.any():
                p, own, said = estimate[at[met]], share[at[met]], out[met, bit]
                out[met, bit] = np.where(np.isnan(said), p, own * p + (1 - own) * said)
    return out


def log10_of(gram: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte; a decision never met is a coin toss."""
    one = np.where(np.isnan(one), 0.5, one)
    byte = gram & 255
    total = np.zeros(len(gram))
    for bit in range(8):
        outcome = decisions(byte, bit)[1]
        total += np.log10(np.where(outcome == 1, one[:, bit], 1 - one[:, bit]))
    return total


# --- on tables -------------------------------------------------------------------------------

def _padded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all bytes of the texts, each text after ``depth`` zero bytes; index of the text."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    pad = b"\0" * depth
    buffer = np.frombuffer(pad + pad.join(texts), np.uint8)
    value = gram_values(buffer, depth)
    begin = np.concatenate(([0], np.cumsum(sizes + depth)))[:-1]
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return value[np.repeat(begin, sizes) + inside], text, sizes


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each stands there."""
    key = np.sort(key)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else \
        np.zeros(0, np.int64)
    return key[begin], np.diff(np.concatenate((begin, [len(key)])))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _dictionary(docs: pd.DataFrame, depth: int, counted: bool = True):
    """Sorted distinct word hashes and grams of a block, with their uses in training documents.

    Where they are not ``counted``, the keys alone.
    """
    held: dict[bool, list] = {True: [], False: []}
    for pdf in pieces(docs, CHUNK_BYTES):
        texts = texts_of(pdf)
        trains = pdf["trains"].to_numpy(dtype=bool) if counted else np.zeros(len(pdf), bool)
        words = Words(texts, lower=True)
        gram, text, _ = _padded(texts, depth)
        for word, key, used in ((True, signed(words.hash), trains[words.doc]),
                                (False, gram, trains[text])):
            if used.any():
                held[word].append(_runs(key[used]))
            if not used.all():
                other = _runs(key[~used])[0]
                held[word].append((other, np.zeros(len(other), np.int64)))
            if sum(len(k) for k, _ in held[word][1:]) > HELD:
                held[word] = [_merged(held[word]) if counted else _distinct(held[word])]
    none = [(np.zeros(0, np.int64),) * 2]
    return {word: (_merged if counted else _distinct)(parts or none)
            for word, parts in held.items()}


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _runs(np.concatenate([p[0] for p in parts]))


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` stand among sorted ``keys``; looked up in their order, which is faster."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted), np.int64)
    out[order] = np.searchsorted(keys, wanted[order])
    return out


def _vocabulary(depth: int):
    """``word, key, block, place, n``: ``place`` is the key's rank in the block's dictionary."""
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        (words, used), (grams, met) = _dictionary(pdf, depth).values()
        return pd.DataFrame({
            "word": np.arange(len(words) + len(grams)) < len(words),
            "key": np.concatenate((words, grams)), "block": np.int32(pdf["block"].iat[0]),
            "place": np.concatenate((np.arange(len(words), dtype=np.int32),
                                     np.arange(len(grams), dtype=np.int32))),
            "n": np.concatenate((used, met))}, copy=False)
    return of


def _aligned(batches: Iterator[pd.DataFrame], least: int = 300_000) -> Iterator[pd.DataFrame]:
    """Sorted grams in portions that never split the context at ``ROOT``."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat((held, batch))
        if len(held) >= least:
            head = held["root"].to_numpy()
            cut = int(np.searchsorted(head, head[-1], "left"))
            if cut:
                yield held.iloc[:cut]
                held = held.iloc[cut:]
    if held is not None and len(held):
        yield held


def _trees(depth: int):
    """Work up the subtrees of sorted grams: their nodes at ``ROOT``."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _aligned(batches):
            _, (key, zero, one, weighted) = subtree(pdf["key"].to_numpy(), pdf["n"].to_numpy(),
                                                    depth, ROOT)
            yield pd.DataFrame({"node": key, "zero": zero, "one": one, "weighted": weighted})
    return of


def _tops(nodes: DataFrame) -> list:
    """Levels 1 and 0 from the nodes at ``ROOT``: 256 contexts of 255 nodes at most."""
    up = ((F.shiftright("node", 16) * 256) + F.col("node").bitwiseAND(255)).alias("node")
    found = nodes.groupBy(up).agg(*(F.sum(c).alias(c) for c in ("zero", "one", "weighted"))) \
        .toPandas()
    key, zero, one, below = summed(*(found[c].to_numpy() for c in
                                     ("node", "zero", "one", "weighted")))
    levels = []
    for d in (1, 0):
        weighted, share = raised(key, zero, one, below)
        levels.append((key, (one + 0.5) / (zero + one + 1), share))
        if d:
            key, zero, one, below = summed(((key >> 16) << 8) | (key & 255), zero, one, weighted)
    return levels


def _scored_grams(depth: int, tops):
    """Work up the subtrees once more, mix in the levels above them, and score each gram."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _aligned(batches):
            gram = pdf["key"].to_numpy()
            levels, _ = subtree(gram, pdf["n"].to_numpy(), depth, ROOT)
            said = mix_levels(gram, levels, depth, None)
            # the levels handed on have contexts of one byte and none
            one = mix_levels(_short(gram, depth), tops.value, 1, said)
            yield pd.DataFrame({"key": gram, "value": log10_of(gram, one).astype(np.float32)})
    return of


def _short(gram: np.ndarray, depth: int) -> np.ndarray:
    """The gram with its latest context byte only."""
    return ((gram >> (8 * depth)) << 8) | (gram & 255)


def _scores(depth: int, total: int, base_unit: float, end_count: int):
    """Score the documents of a block from the values of its own dictionary."""
    def of(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        tables = {}
        for word, (key, _) in _dictionary(docs, depth, counted=False).items():
            own = known[known["word"] == word]
            value = np.zeros(len(key) or 1)
            value[own["place"].to_numpy()] = own["value"].to_numpy()
            tables[word] = key, value
        out = []
        for pdf in pieces(docs, CHUNK_BYTES):
            texts = texts_of(pdf)
            n = len(texts)
            words = Words(texts, lower=True)
            key, value = tables[True]
            count = value[_places(key, signed(words.hash))]
            unit = np.log10((count + 0.1) / base_unit)
            gram, text, size = _padded(texts, depth)
            key, value = tables[False]
            score = np.bincount(text, value[_places(key, gram)], n)
            out.append(pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(),
                "n_tokens": words.counts + 1,
                "n_known": np.bincount(words.doc, count > 0, n).astype(np.int64)
                + int(end_count > 0),
                "train_tokens": total,
                "base_score": np.bincount(words.doc, unit, n)
                + np.log10((end_count + 0.1) / base_unit),
                "score": score,
                "bits_per_byte": -score * np.log2(10) / np.maximum(size, 1)}))
        return pd.concat(out)
    return of


SCORES = ("doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double, bits_per_byte double")


@operator
def score(docs: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """Score all texts with a model of those that are not held out (see ``SCORES``)."""
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    blocks = block_count(docs, BLOCK_BYTES)
    columns = docs.withColumns({"held_out": held, "trains": ~held})
    uses = stored(blocked(columns, blocks, "held_out", "trains").groupBy("block").applyInPandas(
        _vocabulary(depth), "word boolean, key long, block int, place int, n long"))
    counts = stored(uses.groupBy("word", "key").agg(F.sum("n").alias("n")))
    ends = docs.where(~held).count()
    words = counts.where("word and n > 0").agg(F.count("*"), F.sum("n")).first()
    vocabulary, total = words[0] + (ends > 0), (words[1] or 0) + ends
    base_unit = total + 0.1 * (vocabulary + 1)

    root = F.shiftright("key", 8 * (1 + depth - ROOT)).alias("root")
    # trees are worked up twice, for their tops and for the values, and never written
    grams = counts.where("not word").select(root, "key", "n").repartitionByRange(
        "root").sortWithinPartitions("root", "key")
    nodes = stored(grams.mapInPandas(_trees(depth), "node long, zero long, one long, weighted double"))
    tops = spark.sparkContext.broadcast(_tops(nodes))
    of_grams = stored(grams.mapInPandas(_scored_grams(depth, tops), "key long, value float"))
    values = of_grams.select(F.lit(False).alias("word"), "key", F.col("value").cast("double")).union(
        counts.where("word").select("word", "key", F.col("n").cast("double")))
    replies = stored(uses.select("word", "key", "block", "place").join(
        values, ["word", "key"]).select("block", "word", "place", "value"))
    dropped(uses, counts, nodes, of_grams)
    again = blocked(columns, blocks, "held_out", "trains")
    return numbered(again.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        _scores(depth, total, base_unit, ends), SCORES))
