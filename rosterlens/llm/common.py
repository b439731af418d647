"""Helpers shared by the operators: held-out rules, blocks of documents, byte and word arrays.

Text is handled as UTF-8 bytes in numpy arrays. A word is a run of bytes other than
``\\x20`` and ``\\x09-\\x0D``; as all of these are ASCII, byte words are the words of the text.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import lru_cache, wraps
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlens.sources.scratch import Scratch, materialise

CHUNK_BYTES = 1 << 20  # bytes handled at once inside a task; arrays take about 100 times that
BLOCK_BYTES = 16 << 20  # text of one block of documents

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_BASES = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))


_HANDED: set[str] = set()


def hand_out(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, once, as they may not have it."""
    context = spark.sparkContext
    if context.applicationId in _HANDED:
        return
    root = Path(__file__).parents[1]
    archive = f"{tempfile.mkdtemp(prefix='rosterlens-')}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    _HANDED.add(context.applicationId)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    hand_out(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_crc(modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


_RUN: ContextVar[Scratch | None] = ContextVar("run", default=None)


def operator(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a DataFrame, its first argument, that keeps tables in between.

    The workers get the package. Tables that it stores live in a folder of the run, which goes
    once the result is written; an operator called by another one shares its run.
    """
    @wraps(function)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        hand_out(docs.sparkSession)
        if _RUN.get() is not None:
            return function(docs, *args, **kwargs)
        with Scratch(docs.sparkSession) as scratch:
            token = _RUN.set(scratch)
            try:
                return materialise(function(docs, *args, **kwargs))
            finally:
                _RUN.reset(token)
    return run


def scratch_of_run() -> Scratch | None:
    """The folder of the run, for helpers that keep tables by themselves."""
    return _RUN.get()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder of the run and read it back."""
    run = _RUN.get()
    return materialise(df) if run is None else run.keep(df)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that the run reads no more."""
    run = _RUN.get()
    if run is not None:
        run.drop(*tables)


def block_count(docs: DataFrame, each: int = BLOCK_BYTES) -> int:
    """Blocks so that each holds about ``each`` bytes of text, and no fewer than 12."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(12, -(-total // each))


def named(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with ``doc_id`` as text: pandas would make floats of integers beside a null."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), *columns)


def numbered(found: DataFrame) -> DataFrame:
    """Put the ids of :func:`named` back."""
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def blocked(docs: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """Documents, named by text, dealt to blocks by a hash of id and text length: no key is hot."""
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("string").alias("doc_id"), *columns,
                       F.coalesce("text", F.lit("")).alias("text")).repartition(blocks, "block")


def by_id(docs: DataFrame, blocks: int) -> DataFrame:
    """Texts with an id, dealt to blocks by a hash of the id."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        id_block("doc_id", blocks), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    ).repartition(blocks, "block")


def id_block(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int").alias("block")


def only(docs: pd.DataFrame, heads: pd.Series) -> pd.DataFrame:
    """The texts of a block whose ids are among ``heads``."""
    return docs[docs["doc_id"].isin(heads)]


def shared(keys: DataFrame, least: int = 2) -> DataFrame:
    """Of ``(key, block, n)``, unique by key and block: rows of keys with ``least`` uses in all.

    A key has one row for each block at most, however often it is used.
    """
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("key"))
    return keys.withColumn("total", total).where(F.col("total") >= least)


def pieces(pdf: pd.DataFrame, limit: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """Consecutive rows holding about ``limit`` characters of text; a longer text stands alone."""
    size = pdf["text"].str.len().fillna(0).to_numpy(dtype=np.int64)
    begin, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > limit:
            yield pdf.iloc[begin:i]
            begin, held = i, 0
        held += n
    if begin < len(pdf):
        yield pdf.iloc[begin:]


def slices(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows holding about ``limit`` bytes of text; a longer text stands alone.

    Unlike pandas columns, those of Arrow hold nullable integers exactly.
    """
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(
            zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(size):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 of each text; a null one is empty."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def rows(**columns) -> pa.RecordBatch:
    """A batch of Arrow, numpy or list columns."""
    return pa.RecordBatch.from_pydict(columns)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@lru_cache(maxsize=8)
def _power_table(which: int, inverse: bool, log2: int) -> np.ndarray:
    base = int(_BASES[which])
    step = pow(base, -1, 1 << 64) if inverse else base
    out = np.full(1 << log2, step, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """Powers 0 .. n-1 of an odd base modulo 2**64."""
    return _power_table(which, inverse, max(16, int(n).bit_length()))[:n]


@lru_cache(maxsize=4)
def _byte_values(lower: bool, which: int, spaces: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[65:91] += U64(32)
    out = mixed((b + U64(1 + 1000 * which)) * _STEP)
    if not spaces:
        out[[9, 10, 11, 12, 13, 32]] = 0
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of some texts: ``doc`` (index of the text), ``begin``/``end`` byte places, hash."""

    def __init__(self, texts: list[bytes], lower: bool = False, which: int = 0):
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.at = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        gap = _SPACE[self.buffer]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        self.begin, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.at, self.begin, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.which, self.lower = which, lower
        self.hash = self.hashes(which)

    def hashes(self, which: int) -> np.ndarray:
        if not len(self.begin):
            return np.zeros(0, U64)
        value = _byte_values(self.lower, which, False)[self.buffer] \
            * powers(len(self.buffer), which)
        whole = np.add.reduceat(value, self.begin) \
            * powers(len(self.buffer), which, True)[self.begin]
        return mixed(whole + (self.end - self.begin).astype(U64) * _STEP)


def windows(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, wherever it stands.

    Runs of twice the length are put together from two neighbouring ones.
    """
    if len(values) < width:
        return np.zeros(0, U64)
    base, total, held, span = int(_BASES[which]), None, 0, 1
    run = values
    while True:
        if width & span:
            total = run if total is None else \
                total[:len(run) - held] + run[held:] * U64(pow(base, held, 1 << 64))
            held += span
        if held == width:
            return mixed(total[:len(values) - width + 1])
        run = run[:-span] + run[span:] * U64(pow(base, span, 1 << 64))
        span *= 2


def sequence_prints(values: np.ndarray, first: np.ndarray, which: int) -> np.ndarray:
    """Hash of the values of each document; ``first`` has the place of its first and one more."""
    n = len(values) + 1
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values * powers(n, which)[:-1],
                                                        dtype=U64)))
    whole = (total[first[1:]] - total[first[:-1]]) * powers(n, which, True)[first[:-1]]
    return mixed(whole + np.diff(first).astype(U64) * _STEP)


PLACE_BITS = 30


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each run of ``width`` values.

    Values count by their upper bits; the lower ones hold the place, so that minima of neighbouring
    runs are plain minima of arrays. Beyond 2 ** PLACE_BITS values the runs are taken in stretches.
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    stretch = (1 << PLACE_BITS) - width
    if len(values) > 1 << PLACE_BITS:
        return np.concatenate([begin + leftmost_minima(values[begin:begin + stretch + width - 1],
                                                       width)
                               for begin in range(0, len(values) - width + 1, stretch)])
    low = U64((1 << PLACE_BITS) - 1)
    best, span = (values & ~low) | np.arange(len(values), dtype=U64), 1
    while span < width:  # doubling: the smallest of two overlapping runs
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return (best & low).astype(np.int64)


def among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values are among sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts_of(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in pdf["text"]]
