"""Cross-tokenizer alignment by products of sparse incidence matrices.

Tokenizer A reads a space and the text, B the text, before which it puts a space itself. Where the
bytes of both token sequences are those of space and text, each sequence cuts the bytes: its
incidence matrix has a row a token and a column a byte. Both are kept in compressed sparse rows.
Gustavson's product A Bᵀ goes through the rows of A: each byte of a token brings the row of Bᵀ of
that byte, and equal columns are added up. Its entries are the overlap links, with the number of
bytes that two tokens share. Bytes where tokens of both end cut the sequences into groups; the
product of the token-group incidences has the links of tokens in one group.

How many documents hold a pair of ids linked is counted over the corpus. A task counts by blocks
of documents and keeps, for each document, the places of its pairs in the block's dictionary of
pairs; the dictionaries are added up and answered, and the answers of a block meet its documents
again. So texts are tokenised once and never shuffled. Largest counts of A's ids are broadcast:
one row an id of the vocabulary.

Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens:
zeros and an empty digest. Rows that repeat an id are aligned and counted one by one; a null id
stays null. Ties for the highest count all count as best. An empty table gives an empty one. Other
columns, whatever their names, are not looked at. Products are made ``CHUNK_BYTES`` of a text at a
time; a long text's tokens stand in memory whole, at about 60 bytes a byte of text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rosterlens.llm.common import CHUNK_BYTES, hand_out, operator, rows, slices, stored
from rosterlens.llm.packing import merging_by_id
from rosterlens.llm.token_counts import byte_letters

BLOCK_BYTES = 12 << 20   # text of the documents that share a dictionary of pairs


# --- sparse matrices -----------------------------------------------------------------------------

@dataclass
class Csr:
    """Compressed sparse rows: row i has ``columns[first[i]:first[i + 1]]`` with ``values``."""

    first: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def transposed(self) -> "Csr":
        order = np.argsort(self.columns, kind="stable")
        count = np.bincount(self.columns, minlength=self.width)
        return Csr(np.concatenate(([0], np.cumsum(count))), self.row_of[order],
                   self.values[order], len(self.first) - 1)


def ones(first: np.ndarray, columns: np.ndarray, width: int) -> Csr:
    return Csr(first, columns, np.ones(len(columns), np.int64), width)


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson's product: each entry of a row of ``a`` brings a row of ``b``, added up."""
    brought = np.diff(b.first)[a.columns]
    row = np.repeat(a.row_of, brought)
    entry = np.arange(len(row)) + np.repeat(
        b.first[a.columns] - (np.cumsum(brought) - brought), brought)
    key = row * b.width + b.columns[entry]
    value = np.repeat(a.values, brought) * b.values[entry]
    if len(key) and (key[1:] < key[:-1]).any():   # within a row, columns may come in any order
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    row, column = np.divmod(key[new], max(b.width, 1))
    return Csr(np.searchsorted(row, np.arange(len(a.first))), column,
               np.add.reduceat(value, new) if len(new) else value, b.width)


def token_bytes(end: np.ndarray, begin: int, stop: int) -> Csr:
    """Incidence of tokens that end at ``end`` with the bytes ``begin`` to ``stop``."""
    inside = np.clip(np.concatenate(([begin], end)), begin, stop) - begin
    return ones(inside, np.arange(stop - begin), stop - begin)


def overlaps(a_end: np.ndarray, b_end: np.ndarray,
             limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token of A, token of B and shared bytes of all overlap links, in order, in parts."""
    i = 0
    while i < len(a_end):
        begin = int(a_end[i - 1]) if i else 0
        after = max(i + 1, int(np.searchsorted(a_end, begin + limit, "right")))
        stop = int(a_end[after - 1])
        j, last = (int(np.searchsorted(b_end, x, side)) for x, side in
                   ((begin, "right"), (stop, "left")))
        found = product(token_bytes(a_end[i:after], begin, stop),
                        token_bytes(b_end[j:last + 1], begin, stop).transposed())
        yield found.row_of + i, found.columns + j, found.values
        i = after


def group_ends(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    return np.intersect1d(a_end, b_end, assume_unique=True)


def token_groups(end: np.ndarray, ends: np.ndarray) -> Csr:
    """Incidence of tokens with the groups that end at ``ends``."""
    return ones(np.arange(len(end) + 1), np.searchsorted(ends, end), len(ends))


# --- tokens --------------------------------------------------------------------------------------

class Pair:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        _, self.encode_a = merging_by_id(a_path)
        with open(a_path, encoding="utf-8") as file:
            content = json.load(file)
        letters, vocabulary = byte_letters(), content["model"]["vocab"]
        special = {t["content"] for t in content["added_tokens"]}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if entry not in special:
                self.a_bytes[i] = bytes(letters[c] for c in entry)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i)
            else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.pieces.id_to_piece(i))
                             for i in range(self.pieces.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in of])
                                    for of in (self.a_bytes, self.b_bytes))
        # an id as text with what follows it inside a group, and at the end of its side
        self.a_text, self.b_text = (
            np.array([f"{i}{mark}" for i in range(len(of)) for mark in (",", last)], object)
            for of, last in ((self.a_bytes, "|"), (self.b_bytes, ";")))

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none where its bytes do not come out again."""
        none = np.zeros(0, np.int64)
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            a = self.encode_a(" " + text) if text else []
            whole = (" " + text).encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a)) != whole \
                    or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                out.append((none, none))
            else:
                out.append((np.array(a, np.int64), np.array(b, np.int64)))
        return out


@lru_cache(maxsize=2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


@dataclass
class Aligned:
    """Some texts in a row: all their tokens, where these end, and where the groups do."""

    pair: Pair
    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray   # of each text, and one more
    b_first: np.ndarray

    def __post_init__(self):
        self.a_end = np.cumsum(self.pair.a_size[self.a])
        self.b_end = np.cumsum(self.pair.b_size[self.b])
        self.ends = group_ends(self.a_end, self.b_end)
        self.a_group = token_groups(self.a_end, self.ends)
        self.b_group = token_groups(self.b_end, self.ends)
        # first group of each text: groups never cross texts, whose ends both share
        until = np.concatenate(([0], self.a_end))[self.a_first]
        self.group_first = np.searchsorted(self.ends, until, "right")

    def links(self):
        """Overlap links: ``a token, b token, shared bytes``."""
        return overlaps(self.a_end, self.b_end)

    def shared(self) -> np.ndarray:
        """Number of links by a shared group, of each group: the product's column sums."""
        return np.bincount(self.a_group.columns, minlength=len(self.ends)) \
            * np.bincount(self.b_group.columns, minlength=len(self.ends))

    def described(self) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2``."""
        groups = np.arange(len(self.ends))
        a_before = np.searchsorted(self.a_group.columns, groups, "right")
        b_before = np.searchsorted(self.b_group.columns, groups, "left")
        word = np.empty(len(self.a) + len(self.b), object)
        a_last, b_last = (np.diff(g.columns, append=len(groups)) > 0
                          for g in (self.a_group, self.b_group))
        word[np.arange(len(self.a)) + b_before[self.a_group.columns]] = \
            self.pair.a_text[2 * self.a + a_last]
        word[np.arange(len(self.b)) + a_before[self.b_group.columns]] = \
            self.pair.b_text[2 * self.b + b_last]
        cut = self.a_first + self.b_first
        return ["".join(word[x:y].tolist())[:-1] for x, y in zip(cut, cut[1:])]


def aligned(pair: Pair, texts: list[str]) -> Aligned:
    found = pair.tokens(texts)
    first = [np.concatenate(([0], np.cumsum([len(x[side]) for x in found]))) for side in (0, 1)]
    none = [np.zeros(0, np.int64)]
    return Aligned(pair, *(np.concatenate(none + [x[side] for x in found]) for side in (0, 1)),
                   *first)


# --- documents' pairs as places in a dictionary --------------------------------------------------

def written(values: np.ndarray) -> bytes:
    """Numbers as bytes of seven bits, the lowest first; the last byte of one is below 128."""
    size = np.maximum(1, (np.frexp(values.astype(np.float64))[1] + 6) // 7)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[begin[has] + k] = (values[has] >> (7 * k)) & 127 | ((size[has] > k + 1) << 7)
    return out.tobytes()


def read(data: bytes) -> np.ndarray:
    byte = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(byte):
        return byte
    first = np.concatenate(([0], np.flatnonzero(byte < 128) + 1))
    place = np.arange(len(byte)) - np.repeat(first[:-1], np.diff(first))
    return np.add.reduceat((byte & 127) << (7 * place), first[:-1])


class Block:
    """Documents of one dictionary, and the pairs that they hold linked."""

    def __init__(self):
        self.bytes, self.documents = 0, 0
        self.rows: list[pa.RecordBatch] = []
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, batch: pa.RecordBatch, pair: Pair) -> None:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        here = aligned(pair, texts)
        text_of = np.repeat(np.arange(len(texts)), np.diff(here.a_first))
        n_links = np.zeros(len(texts), np.int64)
        parts = []
        for a, b, _ in here.links():
            key = (text_of[a] * len(pair.a_bytes) + here.a[a]) * len(pair.b_bytes) + here.b[b]
            parts.append(np.unique(key, return_counts=True))
            n_links += np.bincount(text_of[a], minlength=len(texts))
        if parts:
            key, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            links = np.bincount(which, np.concatenate([n for _, n in parts])).astype(np.int64)
            text, ids = np.divmod(key, len(pair.a_bytes) * len(pair.b_bytes))
            self.found.append((text + self.documents, ids, links))
        shared = np.concatenate(([0], np.cumsum(here.shared())))[here.group_first]
        self.rows.append(rows(
            doc_id=batch.column("doc_id"), n_a=np.diff(here.a_first), n_b=np.diff(here.b_first),
            n_groups=np.diff(here.group_first), n_links=n_links, n_shared=np.diff(shared),
            groups_sha256=[hashlib.sha256(x.encode()).hexdigest() if x else ""
                           for x in here.described()]))
        self.documents += len(texts)
        self.bytes += sum(map(len, texts))

    def done(self, name: int) -> Iterator[pa.RecordBatch]:
        """Rows of documents with their pairs by place, and rows of the dictionary."""
        none = [(np.zeros(0, np.int64),) * 3]
        text, ids, links = (np.concatenate(x) for x in zip(*(self.found or none)))
        ids, place, n = np.unique(ids, return_inverse=True, return_counts=True)
        first = np.searchsorted(text, np.arange(self.documents + 1))
        step = np.diff(place, prepend=0)
        step[first[:-1][first[:-1] < len(step)]] = place[first[:-1][first[:-1] < len(step)]]
        both = np.stack((step, links), 1)
        at = 0
        for batch in self.rows:
            held = [written(both[first[at + i]:first[at + i + 1]].ravel())
                    for i in range(batch.num_rows)]
            at += batch.num_rows
            yield _full(batch.num_rows, block=pa.array([name] * batch.num_rows, pa.int64()),
                        pairs=pa.array(held, pa.binary()),
                        **dict(zip(batch.schema.names, batch.columns)))
        for i in range(0, len(ids), 1 << 16):
            part = slice(i, i + (1 << 16))
            size = len(ids[part])
            yield _full(size, block=pa.array([name] * size, pa.int64()), pair=ids[part],
                        n=n[part], place=np.arange(i, i + size))


COUNTED = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
           "n_shared": pa.int64(), "groups_sha256": pa.string()}
_KINDS = {"block": pa.int64(), "doc_id": pa.int64(), **COUNTED, "pairs": pa.binary(),
          "pair": pa.int64(), "n": pa.int64(), "place": pa.int64()}
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SQL[of]}" for name, of in kinds.items())


def _full(size: int, **columns) -> pa.RecordBatch:
    return rows(**{name: columns.get(name, pa.nulls(size, of)) for name, of in _KINDS.items()})


def _blocks(a_path: str, b_path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task = pair_of(a_path, b_path), TaskContext.get().partitionId() << 32
        block = Block()
        for batch in slices(batches):
            block.add(batch, pair)
            if block.bytes >= BLOCK_BYTES:
                yield from block.done(task)
                block, task = Block(), task + 1
        yield from block.done(task)
    return of


def _answered(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Counts of the links of a block's documents from the answers for its dictionary."""
    size = answers.num_rows
    place = answers.column("place").to_numpy()
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[place] = answers.column("count").to_numpy()
    best[place] = answers.column("best").to_numpy()
    n_best, total = [], []
    for data in docs.column("pairs").to_pylist():
        step, links = read(data).reshape(-1, 2).T
        held = np.cumsum(step)
        n_best.append(int(best[held] @ links))
        total.append(int(count[held] @ links))
    return docs.select(["doc_id", *COUNTED]).append_column(
        "n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(total, pa.int64()))


@operator
def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, n_best, count_sum``."""
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _blocks(a_path, b_path), _ddl(_KINDS)))
    pairs = found.where("pair is not null").select("block", "pair", "n", "place")
    width = pair_of(a_path, b_path).b_size.size
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn(
        "a", F.floor(F.col("pair") / width))
    counts = stored(counts)
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    best = counts.join(F.broadcast(top), "a").select(
        "pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    answers = pairs.join(best, "pair").select(F.col("block").alias("of_block"), "place", "count",
                                              "best")
    kept = found.where("pair is null").select("block", "doc_id", *COUNTED, "pairs")
    return kept.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(
        _answered, _ddl({"doc_id": pa.int64(), **COUNTED, "n_best": pa.int64(),
                         "count_sum": pa.int64()}))


# --- links as rows -------------------------------------------------------------------------------

def _link_rows(a_path: str, b_path: str, by_group: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            here = aligned(pair, texts)
            text_of = np.repeat(np.arange(len(texts)), np.diff(here.a_first))
            for a, b, n in (_by_group(here) if by_group else here.links()):
                at = text_of[a]
                yield rows(doc_id=batch.column("doc_id").take(pa.array(at)),
                           a_index=a - here.a_first[at], b_index=b - here.b_first[at],
                           a_id=here.a[a], b_id=here.b[b], shared=n)
    return of


def _by_group(here: Aligned, limit: int = CHUNK_BYTES):
    """Links by a shared group: G_A G_Bᵀ, a stretch of the rows of A at a time."""
    across = here.b_group.transposed()
    size = np.diff(across.first)[here.a_group.columns]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1,
                          [len(here.a)]))
    for x, y in zip(cut, cut[1:]):
        if x < y:
            found = product(ones(np.arange(y - x + 1), here.a_group.columns[x:y],
                                 len(here.ends)), across)
            yield found.row_of + x, found.columns, found.values


def links(docs: DataFrame, a_path: str, b_path: str, by_group: bool = False) -> DataFrame:
    """A row a link: ``doc_id, a_index, b_index, a_id, b_id, shared``, the bytes shared.

    With ``by_group`` the links of tokens in one group, of which ``shared`` is 1.
    """
    hand_out(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _link_rows(a_path, b_path, by_group),
        "doc_id long, a_index long, b_index long, a_id long, b_id long, shared long")
