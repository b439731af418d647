"""Best-two-fit packing of token sequences.

A bin is filled greedily, longest first. If a gap stays, the bin's smallest document is taken out
again and two unpacked documents that fill the larger gap more tightly take its place.

Only lengths matter to the method, and there are as many lengths as a bin has tokens. So the plan
is made from the count of each length: one pattern of lengths and how often it is used. Every
pattern uses up a length, which bounds the plan whatever the number of documents. The pieces
find their place in the plan by their rank among the pieces of their length, a rank counted in
shares of the table, so a length that a third of all pieces have is not ranked in one task.

Null texts are empty: one piece of the end token alone. Ties are dealt by id and piece. Repeated rows
are packed one by one; a null id stays null. An empty table gives an empty one. Other columns, whatever
their names, are not looked at. The ids of one text stand in memory whole, however long it is.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from rosterlens.llm.common import named, numbered, operator, pieces, scratch_of_run, stored
from rosterlens.llm.token_counts import byte_letters
from rosterlens.operators.ordering import number_rows

CAPACITY = 2048
END = 0
STAND_BITS = 16   # rows of a file that are ranked together: 2^16


# --- tokens ----------------------------------------------------------------------------------

#: GPT-2 style pre-tokens, as the byte-level pre-tokenizer of the file splits them (fixed value)
PRE_TOKENS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def merging_by_id(path: str):
    """Special tokens of a tokenizer file, and a function from plain text to ids.

    Where the merges of a file stand in the order of the ids that they make, which is checked,
    merging the pair of the smallest id gives the tokens of the tokenizers library, faster.
    """
    import tiktoken
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary = content["model"]["vocab"]
    special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in content["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
    made = [vocabulary[a + b] for a, b in pairs]
    if made != sorted(made):
        raise ValueError("the merges are not in the order of their ids")
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in entry): i for entry, i in vocabulary.items()
             if entry not in special}
    return special, tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks,
                                      special_tokens={}).encode_ordinary


class Ids:
    """Token ids of texts as bytes (unsigned little-endian 32 bit)."""

    def __init__(self, path: str):
        import regex
        self.special, self.encode = merging_by_id(path)
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split \
            if self.special else lambda x: [x]

    def plain(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def of(self, text: str) -> bytes:
        parts = self.around(text) if any(x in text for x in self.special) else [text]
        return b"".join(self.special[p] if i % 2 else self.plain(p) for i, p in enumerate(parts))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def in_file_order(docs: DataFrame) -> DataFrame:
    """Add ``stand``, ``(file, row)``: where a row lies in the written table that it is read from.

    Files follow each other by name, as they are written. Rows that come from no file stand in the
    order of their partitions.
    """
    try:
        place = docs.select("*", F.struct(F.col("_metadata.file_name").alias("file"),
                                          F.col("_metadata.row_index").alias("row")).alias("stand"))
        place.schema   # analysed here: only files have it
        return place
    except AnalysisException:
        return docs.withColumn("stand", F.struct(
            F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")))


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32``, and ``stand``, if there.

    Only a document longer than ``capacity`` is cut, into full pieces after a first one that
    takes what is left over.
    """
    end = np.array([END], "<u4").tobytes()
    ordered = "stand" in docs.columns
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["file", "row"] if ordered else [])]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = ids_of(tokenizer)
        for batch in batches:
            for pdf in pieces(batch):
                out = []
                stands = zip(pdf["file"], pdf["row"]) if ordered else itertools.repeat(())
                for doc, text, stand in zip(pdf["doc_id"], pdf["text"], stands):
                    coded = ids.of(text or "") + end
                    n = len(coded) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] \
                        if n > capacity else [0, n]
                    out += [(doc, k, a, b - a, zlib.crc32(coded[4 * a:4 * b]), *stand)
                            for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                yield pd.DataFrame(out, columns=names)

    kinds = "doc_id string, piece int, start long, length long, ids_crc32 long"
    if not ordered:
        return numbered(named(docs, "text").mapInPandas(of, kinds))
    found = numbered(named(docs, "text", "stand.file", "stand.row").mapInPandas(
        of, f"{kinds}, file string, row long"))
    return found.withColumn("stand", F.struct("file", "row")).drop("file", "row")


# --- plan ------------------------------------------------------------------------------------

def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each at most ``capacity`` in all, and how many bins each fills."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    largest = capacity
    while True:
        while largest and not left[largest]:
            largest -= 1
        if not largest:
            return out
        free = left.copy()  # what a bin of this pattern may still take
        chosen, gap = [], capacity
        size = largest
        while gap:
            size = min(size, gap)
            fits = np.flatnonzero(free[1:size + 1])
            if not len(fits):
                break
            size = int(fits[-1]) + 1
            chosen.append(size)
            free[size] -= 1
            gap -= size
        if gap and len(chosen) > 1:
            chosen = _two_for_smallest(chosen, gap, free)
        lengths, uses = np.unique(chosen, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        out.append((tuple(sorted(chosen, reverse=True)), times))


def _two_for_smallest(chosen: list[int], gap: int, free: np.ndarray) -> list[int]:
    """Replace the smallest chosen length by two free ones that fill its expanded gap better."""
    small = min(chosen)
    room = gap + small
    there = np.flatnonzero(free[:room + 1])
    there = there[there > 0]
    if not len(there):
        return chosen
    # for each first length, the largest second one that fits: free, and there twice if equal
    at = np.searchsorted(there, room - there, "right") - 1
    second = np.where(at >= 0, there[np.maximum(at, 0)], 0)
    alone = (second == there) & (free[there] < 2)
    lower = np.where(at >= 1, there[np.maximum(at - 1, 0)], 0)
    second = np.where(alone, lower, second)
    total = np.where(second > 0, there + second, 0)
    best = int(total.argmax())
    if total[best] <= small:
        return chosen
    rest = list(chosen)
    rest.remove(small)
    return [*rest, int(there[best]), int(second[best])]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each place in a pattern: the ranks of its length that go there, in order of rank."""
    rows, used, base = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            begin = used.get(length, 0)
            rows.append((length, begin, base, offset))
            used[length] = begin + times
            offset += length
        base += times
    out = pd.DataFrame(rows, columns=["length", "begin", "base", "offset"], dtype="int64")
    return out.sort_values(["length", "begin"], ignore_index=True)


# --- placement -------------------------------------------------------------------------------

def ranked(parts: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0: by ``stand``, if it is there.

    Ranks are counted within (length, share) and shifted by the counts of earlier shares. A share is
    dealt by a hash, or has rows that stand together.
    """
    shares = 8 * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share, order = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(shares)), ("doc_id", "piece")
    if "stand" in parts.columns:
        share = F.struct("stand.file", F.shiftright("stand.row", STAND_BITS).alias("part"))
        order = ("stand", "piece")
    dealt = parts.withColumn("share", share)
    sizes = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share")
                             .rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("length", "share", F.coalesce(before, F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "share").orderBy(*order))
    return (dealt.withColumn("own", own).join(shift, ["length", "share"])
            .withColumn("rank", F.col("shift") + F.col("own") - 1).drop("share", "own", "shift"))


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Where pieces have a ``stand``, which then goes, those of a length are dealt in its order, and
    sequences are numbered by the first of theirs.
    """
    if "stand" in parts.columns:
        return _in_turn(stored(_packed(parts, capacity)))
    return _packed(parts, capacity)


def _in_turn(placed: DataFrame) -> DataFrame:
    """Number sequences, from 0, by their earliest piece."""
    firsts = placed.groupBy("sequence_id").agg(F.min(F.struct("stand", "piece")).alias("first"))
    turns = number_rows(firsts, "turn", F.col("first"), scratch=scratch_of_run())
    return placed.drop("stand").join(turns.drop("first"), "sequence_id").select(
        *[c for c in placed.columns if c not in ("sequence_id", "offset", "stand")],
        (F.col("turn") - 1).cast("long").alias("sequence_id"), "offset")


def _packed(parts: DataFrame, capacity: int) -> DataFrame:
    counts = parts.groupBy("length").count().collect()  # one row a length
    places = slots(plan({r[0]: r[1] for r in counts}, capacity))
    handed = parts.sparkSession.sparkContext.broadcast(places)
    ordered = ranked(parts)
    stand = "stand" in parts.columns   # flat on its way through pandas
    if stand:
        ordered = ordered.select("*", "stand.file", "stand.row").drop("stand")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = handed.value
        top = int(table["begin"].max()) + 1 if len(table) else 1
        keys = table["length"].to_numpy() * top + table["begin"].to_numpy()
        for pdf in batches:
            # ranks past the last begin stay below the next length's keys
            key = pdf["length"] * top + np.minimum(pdf["rank"], top - 1)
            at = np.searchsorted(keys, key.to_numpy(), "right") - 1
            pdf["sequence_id"] = table["base"].to_numpy()[at] + pdf["rank"].to_numpy() \
                - table["begin"].to_numpy()[at]
            pdf["offset"] = table["offset"].to_numpy()[at]
            yield pdf.drop(columns="rank")

    kinds = ", ".join(f"`{c}` {'string' if c == 'doc_id' else t}"
                      for c, t in ordered.drop("rank").dtypes)
    found = numbered(named(ordered, *[c for c in ordered.columns if c != "doc_id"]).mapInPandas(
        placed, f"{kinds}, sequence_id long, offset long"))
    return found.withColumn("stand", F.struct("file", "row")).drop("file", "row") if stand else found


@operator
def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut, plan and place all documents; with :func:`in_file_order`, in the order of the table."""
    return packed(stored(cut(docs, tokenizer, capacity)), capacity)
