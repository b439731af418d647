"""Substring deduplication by seed and extend over words.

Seeds: every text is winnowed. Of each run of k-word hashes the smallest is an anchor, so any two
texts that share ``WINDOW`` words share an anchor inside them. Anchors are joined between
documents; one that stands in a single document cannot lie in a repeat.

Extend: the earliest use of a shared anchor hands the words around it to all others. Each of them
is extended to the left and to the right, word by word, until the first that differs. Where both
extensions together make ``WINDOW`` words or more, the maximal repeat holds a run of windows, which
goes on as one row. A passage that many documents share is settled here, inside the blocks of the
documents that hold it, and no key gathers its uses.

A window that does not match the earliest use of its anchor can only match one of another use that
does not match there either. These windows alone are compared between documents by two hashes, so
the result is exact whatever the earliest use is. A word is removed where a window over it also
starts in a document of a smaller id.

Copies of a whole text are settled beforehand: only the smallest id of a text is searched. A null
or empty text has no words, and one of fewer than ``WINDOW`` words loses none. A row without an id
takes no part: nothing is removed from it. Rows of one id never remove each other's words. An empty
table gives an empty one. Other columns, whatever their names, are not looked at. A text beyond
``CHUNK_BYTES`` is handled whole, in about 100 times its bytes of memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rosterlens.llm.common import (Words, among, block_count, by_id, dropped, id_block, leftmost_minima,
                                   named, numbered, only, operator, pieces, sequence_prints,
                                   shared, signed, stored, texts_of, windows)

WINDOW = 50      # words of a repeat
ANCHOR = 18      # words of an anchor


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size, prints and digest of each text as it stands."""
    for batch in batches:
        for pdf in pieces(batch):
            texts = texts_of(pdf)
            words = Words(texts)
            again = words.hashes(1)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "n_words": words.counts,
                "print0": signed(sequence_prints(words.hash, words.first, 0)),
                "print1": signed(sequence_prints(again, words.first, 1)),
                "whole_sha256": [digest(t.split()) for t in texts]})


def anchors_of(words: Words, window: int, anchor: int):
    """Windows of ``window`` words: first word, and place of the anchor that stands for it."""
    values = windows(words.hash, anchor)
    choice = leftmost_minima(values, window - anchor + 1)
    start = np.arange(len(choice))
    inside = words.doc[:len(choice)] == words.doc[window - 1:] if len(choice) else \
        np.zeros(0, bool)
    return start[inside], choice[inside], values


def _seeds(window: int, anchor: int):
    """Anchors of a block's documents: how many hold each, and the earliest use."""
    def of(docs: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for pdf in pieces(only(docs, heads["key"])):
            words = Words(texts_of(pdf))
            _, choice, values = anchors_of(words, window, anchor)
            at = np.unique(choice)
            doc = words.doc[at]
            parts.append(pd.DataFrame({
                "key": signed(values[at]) if len(at) else at,
                "doc_id": pdf["doc_id"].to_numpy()[doc], "place": at - words.first[doc]}))
        uses = pd.concat(parts) if parts else pd.DataFrame(
            {"key": [], "doc_id": [], "place": []}, dtype="int64")
        uses = uses.sort_values(["key", "doc_id", "place"]).drop_duplicates(["key", "doc_id"])
        first = uses.drop_duplicates("key")
        return first.assign(block=docs["block"].iat[0] if len(docs) else 0,
                            n=uses.groupby("key").size().to_numpy())
    return of


def around(words: Words, at: np.ndarray, anchor: int, reach: int):
    """Hashes of ``reach`` words left (nearest first) and right of anchors, and how many there are."""
    doc = words.doc[at]
    left = np.minimum(at - words.first[doc], reach)
    right = np.minimum(words.first[doc + 1] - at - anchor, reach)
    step, top = np.arange(reach), len(words.hash) - 1
    values = np.concatenate((words.hash[np.maximum(at[:, None] - 1 - step, 0)],
                             words.hash[np.minimum(at[:, None] + anchor + step, top)]), axis=1)
    return values, left, right


def _surroundings(anchor: int, reach: int):
    """The words around the earliest use of each anchor, as it stands in a block's documents."""
    def of(docs: pd.DataFrame, owners: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pdf in pieces(only(docs, owners["doc_id"])):
            words = Words(texts_of(pdf))
            values = signed(windows(words.hash, anchor))
            here = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "row": np.arange(len(pdf))})
            asked = owners.merge(here, on="doc_id")
            row, place, key = (asked[c].to_numpy() for c in ("row", "place", "key"))
            there = place + anchor <= words.counts[row]  # rows of one id may differ
            row, place, key = row[there], place[there], key[there]
            at = words.first[row] + place
            same = values[at] == key if len(at) else there[:0]
            context, left, right = around(words, at[same], anchor, reach)
            out.append(pd.DataFrame({"key": key[same], "left": left, "right": right,
                                     "context": [c.tobytes() for c in context]}))
        return pd.concat(out).drop_duplicates("key") if out else pd.DataFrame(
            {"key": [], "left": [], "right": [], "context": []})
    return of


def extended(words: Words, at: np.ndarray, anchor: int, reach: int, context: np.ndarray,
             left: np.ndarray, right: np.ndarray):
    """How many words on either side of each anchor equal those around its earliest use."""
    values, own_left, own_right = around(words, at, anchor, reach)
    equal = values == context
    run = [np.logical_and.accumulate(side, axis=1).sum(axis=1)
           for side in (equal[:, :reach], equal[:, reach:])]
    return (np.minimum(run[0], np.minimum(left, own_left)),
            np.minimum(run[1], np.minimum(right, own_right)))


ANCHORS_AT_ONCE = 1 << 14


def _extensions(window: int, anchor: int):
    """Runs of windows that match the earliest use of their anchor (``run`` of them from
    ``start``), and the other windows with a shared anchor (``run`` 0) with their hashes."""
    reach = window - anchor

    def of(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        seeds = known[known["seed"]].sort_values("key")
        keys, head = seeds["key"].to_numpy(), seeds["head"].to_numpy()
        far = seeds["left"].to_numpy(), seeds["right"].to_numpy()
        contexts = np.frombuffer(b"".join(seeds["context"]), np.uint64).reshape(
            len(seeds), 2 * reach)
        out = []
        for pdf in pieces(only(docs, known["key"][~known["seed"]])):
            words, ids = Words(texts_of(pdf)), pdf["doc_id"].to_numpy()
            start, choice, values = anchors_of(words, window, anchor)
            found = among(keys, signed(values[choice]) if len(choice) else choice)
            start, choice = start[found], choice[found]
            at, back = np.unique(choice, return_inverse=True)
            which = np.searchsorted(keys, signed(values[at]) if len(at) else at)
            sides = np.zeros((2, len(at)), np.int64)
            for a in range(0, len(at), ANCHORS_AT_ONCE):
                some = slice(a, a + ANCHORS_AT_ONCE)
                w = which[some]
                sides[:, some] = extended(words, at[some], anchor, reach, contexts[w],
                                          far[0][w], far[1][w])
            before = choice - start
            matched = (before <= sides[0][back]) & (reach - before <= sides[1][back])
            doc = words.doc[start]
            gone = np.flatnonzero(matched & (head[which][back] < ids[doc]))
            # windows of one document that start at neighbouring words are one run
            new = np.ones(len(gone), bool)
            new[1:] = (np.diff(start[gone]) != 1) | (np.diff(doc[gone]) != 0)
            edge = np.flatnonzero(new)
            begin = gone[edge]
            rest = np.flatnonzero(~matched)
            again = words.hashes(1) if len(rest) else words.hash
            hashes = [signed(windows(h, window, i)[start[rest]]) if len(rest) else rest
                      for i, h in enumerate((words.hash, again))]
            none = np.zeros(len(begin), np.int64)
            place = np.concatenate((begin, rest))
            out.append(pd.DataFrame({
                "h0": np.concatenate((none, hashes[0])), "h1": np.concatenate((none, hashes[1])),
                "doc_id": ids[doc[place]], "start": start[place] - words.first[doc[place]],
                "run": np.concatenate((np.diff(np.append(edge, len(gone))),
                                       np.zeros(len(rest), np.int64)))}))
        return pd.concat(out) if out else pd.DataFrame(
            {"h0": [], "h1": [], "doc_id": [], "start": [], "run": []}, dtype="int64")
    return of


def covered(starts: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run from one of ``starts``, ``width`` long each."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(window: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, starts, runs in zip(pdf["text"], pdf["starts"], pdf["runs"]):
                words = (text or "").encode().split()
                gone = covered(np.asarray(starts, np.int64),
                               np.asarray(runs, np.int64) + window - 1, len(words))
                out.append((int(gone.sum()), digest([w for w, g in zip(words, gone) if not g])))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(),
                                "n_removed": [x[0] for x in out],
                                "kept_sha256": [x[1] for x in out]})
    return of


@operator
def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row."""
    prints = ["print0", "print1", "n_words"]
    whole = stored(numbered(named(docs, "text").mapInPandas(
        _whole, "doc_id string, n_words long, print0 long, print1 long, whole_sha256 string")))
    long_ones = whole.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    heads = stored(long_ones.groupBy(*prints).agg(F.min("doc_id").alias("head")))
    blocks = block_count(docs)
    searched = heads.select(F.col("head").alias("key"), id_block("head", blocks))
    uses = stored(by_id(docs, blocks).groupBy("block").cogroup(searched.groupBy("block"))
                  .applyInPandas(_seeds(window, anchor),
                                 "key long, doc_id long, place long, block int, n long"))
    # a key has one row a block, with its earliest use there
    seeds = stored(shared(uses).drop("n", "total").withColumn(
        "head", F.min("doc_id").over(Window.partitionBy("key"))))
    owners = seeds.where("doc_id = head")
    dropped(uses)
    contexts = stored(by_id(docs, blocks).groupBy("block").cogroup(owners.groupBy("block"))
                      .applyInPandas(_surroundings(anchor, window - anchor),
                                     "key long, left long, right long, context binary"))
    zero = F.lit(0).cast("long")
    nothing_around = [zero.alias("head"), zero.alias("left"), zero.alias("right"),
                      F.lit(b"").alias("context")]
    known = seeds.join(contexts, "key").select(
        "key", "block", F.lit(True).alias("seed"), "head", "left", "right", "context").union(
        searched.select("key", "block", F.lit(False).alias("seed"), *nothing_around))
    found = stored(by_id(docs, blocks).groupBy("block").cogroup(known.groupBy("block"))
                   .applyInPandas(_extensions(window, anchor),
                                  "h0 long, h1 long, doc_id long, start long, run long"))
    dropped(seeds, contexts)
    rest = found.where("run = 0")
    least = rest.groupBy("h0", "h1").agg(F.min("doc_id").alias("least"),
                                         F.max("doc_id").alias("most")).where("least < most")
    runs = found.where("run > 0").select("doc_id", "start", "run").union(
        rest.join(least, ["h0", "h1"]).where("doc_id > least")
        .select("doc_id", "start", F.lit(1).cast("long").alias("run")))
    starts = runs.groupBy("doc_id").agg(F.collect_set(F.struct("start", "run")).alias("all")) \
        .select("doc_id", F.col("all.start").alias("starts"), F.col("all.run").alias("runs"))
    cut = stored(docs.join(starts, "doc_id").select("doc_id", "text", "starts", "runs").mapInPandas(
        _removed(window), "doc_id long, n_removed long, kept_sha256 string")
        .dropDuplicates(["doc_id"]))
    copy = (F.col("head") < F.col("doc_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    joined = whole.join(heads, prints, "left").join(cut, "doc_id", "left")
    return joined.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("long").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "whole_sha256"))
        .alias("kept_sha256"))
