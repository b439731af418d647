"""Suffix-array deduplication of byte strings by threshold-bounded interval expansion.

The suffixes of a set of strings are sorted and their Burrows-Wheeler transform is extended
backwards, breadth first: from the boundaries between suffixes that differ within l bytes follow
those that differ within l + 1, so common prefixes come out by increasing length. After
``LENGTH`` rounds the walk stops: suffixes without a boundary between them share at least so many
bytes, and all but the earliest of them start a repeat.

One suffix array of everything would not fit a task. Two equal strings of ``LENGTH`` bytes have
the same winnowed anchor at the same place inside. So strings are compared among those of their
anchor only: an anchor used once has no repeats, equal surroundings of an anchor are settled by
their hash and only the earliest is searched. The rest is cut into ``PARTS`` by the anchor's place in
the string, and the strings of a part have most of their bytes in common: this core tells far more
than the anchor, so one used once has no repeats either, however common its anchor is. Parts of a
core are settled in the same way and dealt by core to suffix arrays of bounded size. A core with more
different parts than fit one array is settled by hashes of its ``LENGTH``-byte strings, combined
where they are made; nothing is left out.

Copies of a whole text are settled beforehand. A null text is empty. A row without an id takes
no part: nothing is removed from it. Ids are taken to name one text each. An empty table gives an empty
one. Other columns, whatever their names, are not looked at. A text beyond ``CHUNK_BYTES`` is handled
whole, in about 100 times its bytes of memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rosterlens.llm.common import (U64, among, block_count, by_id, dropped, id_block, leftmost_minima,
                                   mixed, named, numbered, only, operator, pieces, shared, signed,
                                   stored, texts_of, windows)

LENGTH = 100
ANCHOR = 24            # bytes of an anchor
ARRAY_BYTES = 1 << 19  # surroundings in one suffix array, about
CHUNK_BYTES = 1 << 19  # text of a block that is taken apart at once
PARTS = 4              # parts of a surrounding, by the anchor's place in its strings
MOST_OF_ANCHOR = 100   # different parts of a core that go to one array


# --- suffix arrays ---------------------------------------------------------------------------

def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols, by prefix doubling.

    Seven symbols of nine bits make the first key. Suffixes alike in ``depth`` symbols stand in
    any order.
    """
    n = len(symbols)
    rank, known = np.zeros(n, np.int64), 7
    for i in range(known):
        rank <<= 9
        rank[:n - i] |= symbols[i:].astype(np.int64)
    order = np.argsort(rank)
    while True:
        sorted_rank = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_rank[1:] != sorted_rank[:-1])))
        if known >= depth:
            return order
        after = np.zeros(n, np.int64)
        after[:max(n - known, 0)] = rank[known:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank)
        known *= 2


def repeat_classes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Class of each place of the suffix order: equal for suffixes alike in ``length`` symbols.

    Breadth-first backward extension. ``boundary[i]``: suffixes i - 1 and i are known to differ
    within the present length. Symbol c before an interval gives the interval of c and what
    stands there; it has a boundary where one lies between two neighbouring occurrences of c.
    """
    n = len(symbols)
    before = symbols[order - 1]  # Burrows-Wheeler transform; the text ends with a separator
    by_symbol = np.argsort(before, kind="stable")
    target = np.empty(n, np.int64)
    target[by_symbol] = np.arange(n)          # where the extended suffix stands
    previous = np.full(n, -1, np.int64)       # last occurrence of the same symbol
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    boundary = np.zeros(n, bool)
    boundary[target[previous < 0]] = True     # differ in the first symbol
    open_ = np.flatnonzero(~boundary[target])  # occurrences whose extension has no boundary yet
    last = previous[open_]
    new = np.flatnonzero(boundary)             # boundaries found in the last round, in order
    for _ in range(length - 1):
        if not len(open_) or not len(new):
            break
        # an extension gets a boundary where a new one lies between its two occurrences
        if 16 * len(open_) < n:
            differs = np.searchsorted(new, open_, "right") > np.searchsorted(new, last, "right")
        else:
            met = np.zeros(n, bool)
            met[new] = True
            met = np.cumsum(met, dtype=np.int32)
            differs = met[open_] > met[last]
        new = np.sort(target[open_[differs]])
        boundary[new] = True
        open_, last = open_[~differs], last[~differs]
    return np.cumsum(boundary)


def later_starts(reads: list[bytes], starts: np.ndarray, length: int):
    """For the first ``starts[i]`` places of each read: does the same string start earlier?

    Reads stand in the order of their age; within a read, earlier places come first.
    """
    sizes = np.fromiter((len(r) for r in reads), np.int64, len(reads))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    symbols = np.zeros(int(sizes.sum()) + len(reads), np.uint16)  # 0 ends a read
    body = np.ones(len(symbols), bool)
    body[begin + sizes] = False
    symbols[body] = np.frombuffer(b"".join(reads), np.uint8).astype(np.uint16) + 1
    order = suffix_order(symbols, length)
    classes = np.empty(len(symbols), np.int64)
    classes[order] = repeat_classes(symbols, order, length)
    read = np.repeat(np.arange(len(reads)), starts)
    offset = np.arange(len(read)) - np.repeat(np.cumsum(starts) - starts, starts)
    found = classes[begin[read] + offset]
    place = np.arange(len(found))
    first = np.full(len(symbols), len(found))
    np.minimum.at(first, found, place)
    return read, offset, first[found] < place


# --- anchors ---------------------------------------------------------------------------------

_VALUES = mixed((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


class Bytes:
    """Texts in one buffer with their anchors: each window of ``length`` bytes has one."""

    def __init__(self, texts: list[bytes], length: int, anchor: int):
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.values = windows(_VALUES[self.buffer], anchor)
        choice = leftmost_minima(self.values, length - anchor + 1)
        # windows that lie inside one text
        doc = np.repeat(np.arange(len(texts)), np.maximum(self.sizes - length + 1, 0))
        inside = np.arange(len(doc)) - np.repeat(
            np.concatenate(([0], np.cumsum(np.maximum(self.sizes - length + 1, 0))))[:-1],
            np.maximum(self.sizes - length + 1, 0))
        self.start = self.at[:-1][doc] + inside
        self.doc = doc
        self.choice = choice[self.start] if len(doc) else np.zeros(0, np.int64)

    def runs(self):
        """Neighbouring windows of one text with one anchor: index of the first, and one more."""
        new = np.concatenate(([True], (self.choice[1:] != self.choice[:-1])
                              | (self.doc[1:] != self.doc[:-1]))) if len(self.doc) else \
            np.zeros(0, bool)
        first = np.flatnonzero(new)
        return first, np.concatenate((first[1:], [len(self.doc)])) if len(first) else first


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for pdf in pieces(batch):
            texts = texts_of(pdf)
            digests = [hashlib.sha256(t) for t in texts]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "n_bytes": [len(t) for t in texts],
                "whole": [d.digest()[:16] for d in digests],
                "whole_sha256": [d.hexdigest() for d in digests]})


def _seeds(length: int, anchor: int):
    def of(docs: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        parts = [np.zeros(0, np.int64)]
        for pdf in pieces(only(docs, heads["key"]), CHUNK_BYTES):
            data = Bytes(texts_of(pdf), length, anchor)
            first = data.runs()[0]
            if len(first):
                parts.append(signed(data.values[data.choice[first]]))
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        return pd.DataFrame({"key": key, "block": docs["block"].iat[0] if len(docs) else 0,
                             "n": n})
    return of


READS = "seed long, surrounding binary, doc_id long, start int, starts int, lead int"


def _reads(length: int, anchor: int):
    """Surroundings of shared anchors, by hash: all windows that the anchor stands for."""
    def of(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(known["key"][known["seed"]].to_numpy())
        out = []
        for pdf in pieces(only(docs, known["key"][~known["seed"]]), CHUNK_BYTES):
            data = Bytes(texts_of(pdf), length, anchor)
            first, end = data.runs()
            seed = signed(data.values[data.choice[first]]) if len(first) else \
                np.zeros(0, np.int64)
            found = among(keys, seed)
            first, end, seed = first[found], end[found], seed[found]
            begin, count = data.start[first], end - first
            body = data.buffer.tobytes()
            doc = data.doc[first]
            out.append(pd.DataFrame({
                "seed": seed, "surrounding": [
                    hashlib.blake2b(body[b:b + n + length - 1], digest_size=16).digest()
                    for b, n in zip(begin, count)],
                "doc_id": pdf["doc_id"].to_numpy()[doc],
                "start": (begin - data.at[doc]).astype(np.int32),
                "starts": count.astype(np.int32),
                "lead": (data.choice[first] - begin).astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame(
            columns=["seed", "surrounding", "doc_id", "start", "starts", "lead"])
    return of


def _fetched(length: int):
    """The bytes of surroundings, from the texts that they stand in."""
    def of(docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        texts = dict(zip(docs["doc_id"], texts_of(docs))) if len(wanted) else {}
        out = wanted[["doc_id", "start", "starts", "lead"]].copy()
        out["bytes"] = [texts[d][s:s + n + length - 1] for d, s, n in zip(
            wanted["doc_id"], wanted["start"], wanted["starts"])]
        return out
    return of


def parts_of(starts: np.ndarray, lead: np.ndarray, length: int, anchor: int):
    """Surroundings cut by the anchor's place in the string, ``PARTS`` ranges of it.

    Of each part: index of its surrounding, first place and number of places, begin and end of the
    bytes that all strings with the anchor in this range have.
    """
    most = length - anchor
    width = -(-(most + 1) // PARTS)
    low = lead - starts + 1              # the anchor's place in the last string
    count = lead // width - low // width + 1
    row = np.repeat(np.arange(len(starts)), count)
    part = low[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    top = np.minimum(lead[row], (part + 1) * width - 1)
    bottom = np.maximum(low[row], part * width)
    core = lead[row] - part * width
    return (row, lead[row] - top, top - bottom + 1, core,
            lead[row] - np.minimum((part + 1) * width - 1, most) + length)


def _cores(length: int, anchor: int):
    """Parts of surroundings by the hash of their core."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, offset, places, begin, end = parts_of(
                pdf["starts"].to_numpy(np.int64), pdf["lead"].to_numpy(np.int64), length, anchor)
            body = pdf["bytes"].to_list()
            hashed = b"".join(hashlib.blake2b(body[r][b:e], digest_size=8).digest()
                              for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist()))
            yield pd.DataFrame({
                "core": np.frombuffer(hashed, np.int64), "doc_id": pdf["doc_id"].to_numpy()[row],
                "start": pdf["start"].to_numpy()[row], "offset": offset.astype(np.int32),
                "places": places.astype(np.int32)})
    return of


def _arrays(length: int):
    """Repeats among the surroundings of one suffix array, as runs of places."""
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        # cores are told apart by their bytes; order by age so that the result is the same
        pdf = pdf.sort_values(["doc_id", "start"], ignore_index=True)
        read, offset, later = later_starts(pdf["bytes"].to_list(), pdf["starts"].to_numpy(),
                                           length)
        read, offset = read[later], offset[later]
        new = np.concatenate(([True], (read[1:] != read[:-1]) | (offset[1:] != offset[:-1] + 1))) \
            if len(read) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(read)])))
        at = read[first]
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[at],
            "start": (pdf["start"].to_numpy()[at] + offset[first]).astype(np.int32),
            "starts": size.astype(np.int32)})
    return of


def _strings(length: int):
    """Hashes of the strings of parts, for cores too common for one array."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count = pdf["starts"].to_numpy()
            yield pd.DataFrame({
                "string": [hashlib.blake2b(body[i:i + length], digest_size=16).digest()
                           for body, n in zip(pdf["bytes"], count) for i in range(n)],
                "doc_id": np.repeat(pdf["doc_id"].to_numpy(), count),
                "start": np.repeat(pdf["start"].to_numpy(), count),
                "offset": np.concatenate([np.arange(n, dtype=np.int32) for n in count])
                if len(count) else np.zeros(0, np.int32)})
    return of


def _rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of the places of a part other than those of ``first``."""
    for pdf in batches:
        rows = []
        for doc, start, starts, first in zip(pdf["doc_id"], pdf["start"], pdf["starts"],
                                             pdf["first"]):
            edges = [-1, *sorted(first if first is not None else ()), starts]
            rows += [(doc, start + a + 1, b - a - 1) for a, b in zip(edges, edges[1:])
                     if b - a > 1]
        yield pd.DataFrame(rows, columns=["doc_id", "start", "starts"])


def _removed(length: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, runs in zip(pdf["text"], pdf["runs"]):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                for run in runs:
                    edge[run["start"]] += 1
                    edge[min(run["start"] + run["starts"] + length - 1, len(raw))] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = raw[~gone].tobytes()
                out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "n_removed": [x[0] for x in out],
                "n_spans": [x[1] for x in out], "kept_sha256": [x[2] for x in out],
                # a cut may fall inside a character: what is left of it goes too
                "kept_text": [x[3].decode(errors="ignore") for x in out]})
    return of


def _parts_to_compare(compared: DataFrame, length: int,
                      anchor: int) -> tuple[DataFrame, DataFrame]:
    """Parts of surroundings whose core others have too: later uses of equal ones, and the rest.

    The rest is ``core, kinds, doc_id, start, starts, bytes``: the earliest use of each part, and how
    many different ones its core has.
    """
    cores = stored(compared.select("doc_id", "start", "starts", "lead", "bytes").mapInPandas(
        _cores(length, anchor), "core long, doc_id long, start int, offset int, places int"))
    used = stored(cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    wanted = stored(cores.join(used, "core"))
    dropped(cores)
    parts = stored(wanted.join(compared.select("doc_id", "start", "bytes"), ["doc_id", "start"])
                   .select("core", "doc_id", (F.col("start") + F.col("offset")).alias("start"),
                           F.col("places").alias("starts"),
                           F.substring("bytes", F.col("offset") + 1, F.col("places") + length - 1)
                           .alias("bytes")))
    dropped(wanted)
    place = F.struct("doc_id", "start", "starts")
    first = stored(parts.groupBy("core", "bytes").agg(F.min(place).alias("first"),
                                                      F.count("*").alias("n")))
    copies = stored(parts.join(first.where("n > 1").select("core", "bytes", "first"),
                               ["core", "bytes"]).where(place > F.col("first"))
                    .select("doc_id", "start", "starts"))
    kinds = first.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    different = stored(first.join(kinds, "core").select("core", "kinds", "first.*", "bytes"))
    dropped(parts, first)
    return copies, different


def _runs(docs: DataFrame, heads: DataFrame, length: int, anchor: int) -> DataFrame:
    """``doc_id, start, starts``: places where a string starts that also starts earlier."""
    blocks = block_count(docs)
    searched = heads.select(F.col("head").alias("key"), id_block("head", blocks),
                            F.lit(False).alias("seed"))
    seeds = stored(shared(by_id(docs, blocks).groupBy("block").cogroup(searched.groupBy("block"))
                          .applyInPandas(_seeds(length, anchor), "key long, block int, n long"))
                   .select("key", "block", F.lit(True).alias("seed")))
    known = searched.union(seeds)
    reads = stored(by_id(docs, blocks).groupBy("block").cogroup(known.groupBy("block"))
                   .applyInPandas(_reads(length, anchor), READS))
    place = F.struct("doc_id", "start", "starts", "lead")
    first = stored(reads.groupBy("seed", "surrounding").agg(
        F.min(place).alias("first"), F.count("*").alias("n")))
    # later uses of equal surroundings
    repeated = first.where("n > 1").select("seed", "surrounding", "first")
    later = stored(reads.join(repeated, ["seed", "surrounding"]).where(
        place > F.col("first")).select("doc_id", "start", "starts"))
    dropped(reads)
    # anchors with different surroundings: only the earliest use of each is left to compare
    kinds = first.groupBy("seed").agg(F.count("*").alias("kinds"))
    several = stored(first.join(kinds.where("kinds > 1"), "seed").select(
        id_block("first.doc_id", blocks), "first.*"))
    dropped(first)
    compared = stored(by_id(docs, blocks).groupBy("block").cogroup(several.groupBy("block"))
                      .applyInPandas(_fetched(length), "doc_id long, start int, starts int, "
                                                       "lead int, bytes binary"))
    dropped(several)
    copies, different = _parts_to_compare(compared, length, anchor)
    dropped(compared)
    small = different.where(F.col("kinds") <= MOST_OF_ANCHOR)
    total = small.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    arrays = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                 -(-total // ARRAY_BYTES))
    array = F.pmod(F.xxhash64("core"), F.lit(arrays)).alias("array")
    among = small.select(array, "doc_id", "start", "starts", "bytes").groupBy("array") \
        .applyInPandas(_arrays(length), "doc_id long, start int, starts int")
    # common cores: the earliest use of each string stays, all its other uses go
    many = different.where(F.col("kinds") > MOST_OF_ANCHOR)
    earliest = many.select("doc_id", "start", "starts", "bytes").mapInPandas(
        _strings(length), "string binary, doc_id long, start int, offset int").groupBy(
        "string").agg(F.min(F.struct("doc_id", "start", "offset")).alias("first"))
    stay = earliest.groupBy("first.doc_id", "first.start").agg(
        F.collect_list("first.offset").alias("first"))  # no more than the places of one part
    common = many.select("doc_id", "start", "starts").join(
        stay, ["doc_id", "start"], "left").mapInPandas(_rest, "doc_id long, start int, starts int")
    found = stored(later.union(copies).union(among).union(common).distinct())
    dropped(later, copies, different)
    return found


@operator
def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, copy, kept_text`` of each row.

    ``kept_text`` is null where nothing is removed, or everything (``copy``).
    """
    whole = stored(numbered(named(docs, "text").mapInPandas(
        _whole, "doc_id string, n_bytes long, whole binary, whole_sha256 string")))
    heads = stored(whole.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull())
                   .groupBy("whole").agg(F.min("doc_id").alias("head")))
    runs = _runs(docs, heads, length, anchor)
    per_text = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "starts"))
                                          .alias("runs"))  # no more than the bytes of one text
    cut = stored(docs.join(per_text, "doc_id").select("doc_id", "text", "runs").mapInPandas(
        _removed(length), "doc_id long, n_removed long, n_spans long, kept_sha256 string, "
                          "kept_text string").dropDuplicates(["doc_id"]))
    copy = F.coalesce(F.col("head") < F.col("doc_id"), F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(heads, "whole", "left").join(cut, "doc_id", "left").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "whole_sha256"))
        .alias("kept_sha256"), copy.alias("copy"), "kept_text")
