"""Embedding near-duplicates by cover trees and their dual traversal.

Vectors are compared within a label only. Unit vectors with a cosine of at least c lie no
further apart than sqrt(2 - 2c). The vectors of a label are dealt to leaves of bounded size; each
holds a cover tree: nested levels of centres with halving radii, every point within the radius
of its centre. Two trees are walked together from the top; a pair of nodes is dropped when
their centres are further apart than the threshold and both covering radii allow. The pairs of
points left are compared by cosine in double precision, so the result is exact.

Equal vectors are one point with a weight. Vectors that are null, zero, empty, or hold null or
non-finite numbers, and those of a null label, link with nothing. Vectors of different lengths
have no cosine and do not link. Rows of one id with one vector are links of each other. An empty table
gives an empty one. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rosterlens.llm.common import operator, stored
from rosterlens.llm.components import components

COSINE = 0.98
LEAF = 1024      # points of one tree, about
FINEST = 0.05    # radius below which nodes are not divided
SLACK = 1e-7     # rounding of distances; what lies within it is decided by the cosine
SIGNS = 20       # fixed random directions whose signs deal a label's vectors to leaves


# --- cover trees -----------------------------------------------------------------------------

def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Level:
    """Nodes of one level: centres, covering radii of their subtrees, parents, owner of a point."""

    def __init__(self, centre, radius, parent, owner):
        self.centre, self.radius, self.parent, self.owner = centre, radius, parent, owner


def cover_tree(points: np.ndarray) -> list[Level]:
    """Nested levels with halving radii over unit vectors.

    A node of the level above keeps its centre and gets more of them, greedily, until each of its
    points is within the level's radius of one; points go to the nearest.
    """
    n = len(points)
    everything = np.zeros(n, np.int64)
    first = distances(points, points[:1])[:, 0]
    levels = [Level(np.zeros(1, np.int64), np.array([first.max()]), np.zeros(1, np.int64),
                    everything)]
    radius = 1.0
    while radius >= FINEST and levels[-1].radius.max() > 0:
        above = levels[-1]
        centre, reach, parent, owner = [], [], [], np.empty(n, np.int64)
        order = np.argsort(above.owner, kind="stable")
        begin = np.searchsorted(above.owner[order], np.arange(len(above.centre) + 1))
        for node, own in enumerate(above.centre):
            mine = order[begin[node]:begin[node + 1]]
            if above.radius[node] <= radius:
                chosen = np.array([own])
                near = np.zeros(len(mine), np.int64)
                far = np.array([above.radius[node]])
            else:
                apart = distances(points[mine], points[mine])
                at = int(np.flatnonzero(mine == own)[0])
                picked, covered = [at], apart[at] <= radius
                while not covered.all():
                    at = int(np.argmin(covered))
                    picked.append(at)
                    covered |= apart[at] <= radius
                to = apart[picked]
                near = to.argmin(0)
                near[picked] = np.arange(len(picked))
                far = np.zeros(len(picked))
                np.maximum.at(far, near, to[near, np.arange(len(mine))])
                chosen = mine[picked]
            owner[mine] = near + len(centre)
            centre += chosen.tolist()
            reach += far.tolist()
            parent += [node] * len(chosen)
        levels.append(Level(np.array(centre), np.array(reach), np.array(parent), owner))
        radius /= 2
    return levels


def level_at(tree: list[Level], depth: int) -> Level:
    """Level ``depth``; below the finest, nodes are their own only children."""
    if depth < len(tree):
        return tree[depth]
    last = tree[-1]
    return Level(last.centre, last.radius, np.arange(len(last.centre)), last.owner)


def dual_traversal(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray,
                                                                         np.ndarray]:
    """Points of ``a`` and of ``b`` in node pairs that may be within ``reach``, and which may."""
    one, two = cover_tree(a), cover_tree(b)
    alive = np.ones((1, 1), bool)
    rows, columns = np.zeros(1, np.int64), np.zeros(1, np.int64)  # nodes still in some pair
    for depth in range(max(len(one), len(two))):
        x, y = level_at(one, depth), level_at(two, depth)
        if depth:
            place_x, place_y = np.full(rows.max(initial=0) + 1, -1), \
                np.full(columns.max(initial=0) + 1, -1)
            place_x[rows], place_y[columns] = np.arange(len(rows)), np.arange(len(columns))
            new_rows = np.flatnonzero(np.isin(x.parent, rows))
            new_columns = np.flatnonzero(np.isin(y.parent, columns))
            alive = alive[place_x[x.parent[new_rows]]][:, place_y[y.parent[new_columns]]]
            rows, columns = new_rows, new_columns
        apart = distances(a[x.centre[rows]], b[y.centre[columns]])
        alive = alive & (apart <= reach + SLACK + x.radius[rows][:, None]
                         + y.radius[columns][None])
        keep_x, keep_y = alive.any(1), alive.any(0)
        rows, columns, alive = rows[keep_x], columns[keep_y], alive[keep_x][:, keep_y]
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0), bool)
    x, y = one[-1], two[-1]
    place_x, place_y = np.full(len(x.centre), -1), np.full(len(y.centre), -1)
    place_x[rows], place_y[columns] = np.arange(len(rows)), np.arange(len(columns))
    mine, yours = np.flatnonzero(place_x[x.owner] >= 0), np.flatnonzero(place_y[y.owner] >= 0)
    return mine, yours, alive[place_x[x.owner[mine]]][:, place_y[y.owner[yours]]]


def spanning(linked: np.ndarray, ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Edges that join what ``linked`` joins: each row's and column's id with the smallest met."""
    top = np.iinfo(np.int64).max
    left, right = ids.copy(), other.copy()
    while True:
        new_right = np.minimum(right, np.where(linked, left[:, None], top).min(0))
        new_left = np.minimum(left, np.where(linked, new_right[None], top).min(1))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    edges = np.concatenate((np.stack((ids, left), 1), np.stack((other, right), 1)))
    return edges[edges[:, 0] != edges[:, 1]]


# --- on tables -------------------------------------------------------------------------------

@lru_cache(maxsize=16)
def _directions(width: int) -> np.ndarray:
    return np.random.default_rng(width).standard_normal((SIGNS, width))


def _usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors of usable rows and the signs of their products with fixed directions."""
    for pdf in batches:
        keep, unit, signs = [], [], []
        for i, v in enumerate(pdf["embedding"]):
            x = None if v is None else np.array([np.nan if e is None else e for e in v], float)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                continue
            x = x / np.abs(x).max()  # no overflow of squares
            x = x / np.sqrt((x * x).sum())
            directions = _directions(len(x))
            keep.append(i)
            unit.append(x)
            signs.append(int(((directions @ x > 0) << np.arange(SIGNS)).sum()))
        out = pdf.iloc[keep][["label", "head", "weight"]]
        yield out.assign(dim=np.array([len(x) for x in unit], np.int32), unit=unit, signs=signs)


def _rooted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centre and covering radius of a leaf."""
    points = np.stack(pdf["unit"].to_list())
    row = pdf.iloc[0]
    return pd.DataFrame({"label": [row["label"]], "dim": [row["dim"]], "leaf": [row["leaf"]],
                         "centre": [points[0]],
                         "radius": [float(distances(points, points[:1]).max())]})


def _linked(cosine: float):
    reach = float(np.sqrt(max(2 - 2 * cosine, 0)))

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("head")  # the same trees whenever the task is run again
        one = pdf[pdf["side"] == 0]
        same = bool((one["leaf"] == one["other"]).any())
        two = one if same else pdf[pdf["side"] == 1]
        a, b = np.stack(one["unit"].to_list()), np.stack(two["unit"].to_list())
        mine, yours, near = dual_traversal(a, b, reach)
        out = {"head": [], "to": [], "n": []}
        if len(mine):
            linked = near & (a[mine] @ b[yours].T >= cosine)
            ids, other = one["head"].to_numpy()[mine], two["head"].to_numpy()[yours]
            if same:
                linked &= mine[:, None] != yours[None]
            for id_, n in ((ids, linked @ two["weight"].to_numpy()[yours]),
                           *(() if same else
                             ((other, one["weight"].to_numpy()[mine] @ linked),))):
                out["head"] += id_[n > 0].tolist()
                out["to"] += id_[n > 0].tolist()
                out["n"] += n[n > 0].tolist()
            edges = spanning(linked, ids, other)
            out["head"] += edges[:, 0].tolist()
            out["to"] += edges[:, 1].tolist()
            out["n"] += [0] * len(edges)
        return pd.DataFrame(out).astype("int64")
    return of


@operator
def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding, label``."""
    classes = stored(vectors.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("head"), F.count("*").alias("weight")))
    usable = stored(classes.where("label is not null and head is not null").mapInPandas(
        _usable, "label int, head long, weight long, dim int, unit array<double>, signs int"))
    group = ["label", "dim"]
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / leaf))).cast("int")
    sizes = usable.groupBy(*group).agg(F.count("*").alias("n")).select(
        *group, F.least(bits, F.lit(SIGNS)).alias("bits"))
    coded = usable.join(sizes, group).withColumn(
        "code", F.col("signs").bitwiseAND(F.expr("shiftleft(1, bits) - 1")))
    full = coded.groupBy(*group, "code").agg(F.count("*").alias("n")).select(
        *group, "code", F.ceil(F.col("n") / leaf).alias("parts"))
    part = F.pmod(F.xxhash64("head"), F.col("parts"))
    points = stored(coded.join(full, [*group, "code"]).select(
        *group, "head", "weight", "unit", (F.col("code") * (1 << 40) + part).alias("leaf")))
    roots = stored(points.groupBy(*group, "leaf").applyInPandas(
        _rooted, "label int, dim int, leaf long, centre array<double>, radius double"))
    # the top of the walk: pairs of leaves, one row each, whose covering balls come near enough
    other = roots.select(*group, F.col("leaf").alias("other"), F.col("centre").alias("centre2"),
                         F.col("radius").alias("radius2"))
    product = F.aggregate(F.zip_with("centre", "centre2", lambda x, y: x * y), F.lit(0.0),
                          lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * product))
    reach = float(np.sqrt(max(2 - 2 * cosine, 0))) + SLACK
    pairs = stored(roots.join(other, group).where("leaf <= other").where(
        apart <= reach + F.col("radius") + F.col("radius2")).select(*group, "leaf", "other"))
    left = pairs.join(points, [*group, "leaf"]).withColumn("side", F.lit(0))
    right = pairs.where("leaf < other").join(
        points.withColumnRenamed("leaf", "other"), [*group, "other"]).withColumn(
        "side", F.lit(1)).select(*left.columns)
    found = stored(left.union(right).groupBy(*group, "leaf", "other").applyInPandas(
        _linked(cosine), "head long, to long, n long"))
    links = found.where("n > 0").groupBy("head").agg(F.sum("n").alias("links"))
    parts = components(found.where("n = 0").select(F.col("head").alias("a"),
                                                   F.col("to").alias("b")))
    per_class = usable.select("head", F.lit(True).alias("usable")).join(links, "head", "left") \
        .join(parts.withColumnRenamed("id", "head"), "head", "left")
    back = classes.join(per_class, "head", "left").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
        F.when(F.col("usable"), F.col("weight") - 1 + F.coalesce("links", F.lit(0)))
        .otherwise(0).alias("n_links"),
        F.when(F.col("usable"), F.coalesce("component", "head")).alias("component"))
    same = vectors["label"].eqNullSafe(back["_label"]) \
        & vectors["embedding"].eqNullSafe(back["_embedding"])
    out = vectors.join(back, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
