"""Vector code compression: product quantisation whose codebooks are trained by ball k-means.

A vector becomes integers floor(SCALE * x) and is cut into ``PARTS`` equal parts. The parts at one
position have a codebook of ``ENTRIES`` entries. A round assigns every part to its nearest entry
and moves each entry to the mean of its parts; the result is that of plain rounds, to the last bit.

Ball k-means saves most distances of a round. The parts of an entry lie in a ball whose radius is
the distance of the farthest. An entry j can take parts of the ball of i only if half the distance
between both entries does not exceed that radius: these are i's neighbours, nearest first.
A part nearer to its entry than half the way to the nearest neighbour is in the stable core and
skips all work; so does a ball that did not move, nor its neighbours. Beyond the core the half
distances to the neighbours cut the ball into rings: a part in the k-th ring is compared with the
first k neighbours alone. The balls are those of the rows of one Arrow batch, so their radii need
no pass of their own; all comparisons are of squares of integers, so ties are exact.

Each round reads the table of the last one, with every row's codes, and writes its own together
with the sums of the parts, a row for each entry and batch, which Spark adds up. The driver holds the
codebooks: ``ENTRIES`` times the width of a vector. The last-but-one table is deleted.

Left out are rows whose vector is null or has a null or non-finite component, is of another length
than that of the smallest id, or has none or not a multiple of ``PARTS`` components; also rows with
a component of 2^24 or more after scaling, as sums of squares would leave 64 bits. Fewer vectors than
entries give a shorter codebook, no vectors an empty result. Rows that repeat an id are coded one
by one; ties for the first entries go by the vectors' bytes. A null id comes last and is coded too. Null
labels form one group. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rosterlens.llm.common import dropped, operator, rows, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 24   # of a scaled component
SALTS = 16          # a label's sum is joined to its rows in so many shares


# --- ball k-means on the parts of one position ---------------------------------------------------

def distances(parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the entry, or to its own where there are as many."""
    away = parts - entry
    return np.einsum("ij,ij->i", away, away)


def nearest(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest entry by looking at all, the first of equally near ones."""
    best, code = distances(parts, book[0]), np.zeros(len(parts), np.int64)
    for j in range(1, len(book)):
        d = distances(parts, book[j])
        nearer = d < best
        best[nearer], code[nearer] = d[nearer], j
    return code


def moved_balls(parts: np.ndarray, code: np.ndarray, last: np.ndarray,
                book: np.ndarray) -> tuple[np.ndarray, int]:
    """Nearest entries of ``book`` for parts whose nearest ones of ``last`` are ``code``.

    Also gives how many distances were looked at besides those to the own entries.
    """
    out = code.copy()
    own = distances(parts, book[code])
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    still = (last == book).all(1)
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(len(book) + 1))
    compared = 0
    for i in range(len(book)):
        ball = order[first[i]:first[i + 1]]
        if not len(ball):
            continue
        reach = 4 * own[ball]                         # (2 x distance) squared
        near = np.flatnonzero(between[i] <= reach.max())
        near = near[near != i]                        # neighbours: half the distance <= radius
        if not len(near) or (still[i] and still[near].all()):
            continue
        near = near[np.argsort(between[i][near], kind="stable")]
        ball = ball[np.argsort(-reach, kind="stable")]     # outermost first
        reach = 4 * own[ball]
        best, taken = own[ball], np.full(len(ball), i)
        # ring by ring: the k-th neighbour concerns the parts beyond half the way to it
        beyond = np.searchsorted(-reach, -between[i][near], "right")
        for j, n in zip(near, beyond):
            d = distances(parts[ball[:n]], book[j])
            compared += n
            nearer = (d < best[:n]) | ((d == best[:n]) & (j < taken[:n]))
            best[:n][nearer], taken[:n][nearer] = d[nearer], j
        out[ball] = taken
    return out, compared


# --- rounds over the table -----------------------------------------------------------------------

def _packed(parts: int, scale: int):
    """Usable vectors as little-endian 32-bit integers."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column("embedding")
            size = pa.compute.fill_null(pa.compute.list_value_length(vector), 0).to_numpy()
            value = np.floor(vector.flatten().to_numpy(zero_copy_only=False) * scale)
            end = np.cumsum(size)
            with np.errstate(invalid="ignore"):
                fine = np.concatenate(([0], np.cumsum(np.abs(value) < LARGEST)))  # NaN is not
            good = (size > 0) & (size % parts == 0) & (fine[end] - fine[end - size] == size)
            value = np.where(np.diff(fine) > 0, value, 0).astype("<i4")
            yield rows(vec_id=batch.column("vec_id").filter(pa.array(good)),
                       label=batch.column("label").filter(pa.array(good)),
                       whole=pa.array([value[b:e].tobytes() for b, e in
                                       zip((end - size)[good], end[good])], pa.binary()))
    return of


def _cut(whole: list[bytes], parts: int) -> np.ndarray:
    """``[part, row, component]`` of vectors."""
    flat = np.frombuffer(b"".join(whole), "<i4").reshape(len(whole), parts, -1)
    return np.ascontiguousarray(flat.transpose(1, 0, 2)).astype(np.int64)


def _round(parts: int, last: list[np.ndarray] | None, books: list[np.ndarray], final: bool):
    """Codes of every row; but for the final round, followed by the sums of the batch's parts."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _cut(batch.column("whole").to_pylist(), parts)
            code = np.empty((batch.num_rows, parts), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            if last is not None:
                before = np.frombuffer(b"".join(batch.column("code").to_pylist()),
                                       np.uint8).reshape(-1, parts)
            for p in range(parts):
                found = nearest(cut[p], books[p]) if last is None else moved_balls(
                    cut[p], before[:, p].astype(np.int64), last[p], books[p])[0]
                code[:, p] = found
                error += distances(cut[p], books[p][found])
            kind = batch.schema.field("label").type
            yield _full(batch.num_rows, kind, vec_id=batch.column("vec_id"),
                        label=batch.column("label"),
                        code=pa.array([c.tobytes() for c in code], pa.binary()), error=error,
                        **({} if final else {"whole": batch.column("whole")}))
            if not final:
                yield _sums(cut, code, [len(b) for b in books], kind)
    return of


def _sums(cut: np.ndarray, code: np.ndarray, sizes: list[int], kind: pa.DataType):
    found = [(p, e, int(n), cut[p][code[:, p] == e].sum(0)) for p in range(len(cut))
             for e, n in enumerate(np.bincount(code[:, p], minlength=sizes[p])) if n]
    part, entry, n, total = zip(*found)
    return _full(len(found), kind, part=pa.array(part, pa.int32()),
                 entry=pa.array(entry, pa.int32()), n=pa.array(n), sums=pa.array(list(total)))


def _full(size: int, kind: pa.DataType, **columns) -> pa.RecordBatch:
    types = {"vec_id": pa.int64(), "label": kind, "whole": pa.binary(), "code": pa.binary(),
             "error": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(),
             "sums": pa.list_(pa.int64())}
    return rows(**{name: columns.get(name, pa.nulls(size, of)) for name, of in types.items()})


def _moved(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries at the floored means of their parts; unused ones stay."""
    sums = table.where("part is not null").select("part", "entry", "n", F.posexplode("sums"))
    found = sums.groupBy("part", "entry", "pos").agg(
        F.sum("n").alias("n"), F.sum("col").alias("total")).collect()  # ENTRIES x width rows
    out = [b.copy() for b in books]
    for r in found:
        out[r["part"]][r["entry"], r["pos"]] = r["total"] // r["n"]
    return out


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components as decimal text, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


@operator
def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for each vector kept."""
    kind = embeddings.schema["label"].dataType.simpleString()
    table = stored(embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label",
        F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        _packed(parts, scale), f"vec_id long, label {kind}, whole binary"))
    in_order = table.orderBy(F.col("vec_id").asc_nulls_last(), "whole")
    least = in_order.select("whole").first()
    width = len(least["whole"]) if least else 0
    source = table.where(F.octet_length("whole") == width)
    chosen = [bytes(r["whole"]) for r in in_order.where(F.octet_length("whole") == width).select(
        "whole").limit(entries).collect()]
    books = list(_cut(chosen, parts)) if chosen else []
    last, row = None, ["vec_id", "label", "whole"]
    for r in range(rounds + 1):
        now = stored(source.select(*row).mapInArrow(
            _round(parts, last, books, r == rounds),
            f"vec_id long, label {kind}, whole binary, code binary, error long, part int, "
            "entry int, n long, sums array<long>"))
        dropped(table)
        table, source, row = now, now.where("part is null"), ["vec_id", "label", "whole", "code"]
        if r < rounds:
            last, books = books, _moved(now, books)
    # a label may have a third of all rows: its sum is added up where the rows are, and joined
    # to shares of them
    coded = source.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("_label"), "label_error",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("_label"))
                      & (F.col("salt") == F.col("_salt"))).select(
        "vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"))
