"""N-gram Jaccard join by a token-group matrix.

Documents are sets of 5-word shingles (tokens). Similar ones are put into groups; a group is
known by the union of its tokens, and the matrix says which groups a token is in. A document can
only be similar to a member of another group if that group's union covers its set to the
threshold, so only groups that pass this bound are opened and their members compared.

1. Equal sets are one class. A class whose tokens are mostly its own cannot be similar to any
   other: this is shown on a fixed quarter of all possible tokens, the same for every document.
2. The others are grouped: each is compared with the first class of its smallest hash and joins
   its group if similar. All other links are for the matrix to find.
3. Matrix: a token with one group says nothing about others. A class with fewer tokens shared
   between groups than the threshold asks for is done. For the rest, groups are looked up
   by the class's rarest tokens (as many as must meet any similar set), the overlap with each
   group's union is counted, and only groups that reach the threshold are opened. Of an opened
   group, a few members are compared first, then those that share enough rare differences from
   what most of it hold. This is done twice: at first a token shows its largest group alone, so
   that what belongs to a large group joins it in one step a class; the groups as they are then
   are looked at in full.

Every pair at or above the threshold is found or lies within one group already, so the components
are exact. No step emits the pairs within a group. Null or wordless texts have no tokens and are
linked with nothing. Rows that repeat an id are one document if their texts agree. A null id stays
null. An empty table gives an empty one. Other columns, whatever their names, are not looked at. A text
beyond ``CHUNK_BYTES`` is handled whole, in about 100 times its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterlens.llm.common import (U64, Words, dropped, mixed, named, numbered, operator, pieces,
                                   sequence_prints, signed, stored, texts_of, windows)
from rosterlens.llm.components import components

SHINGLE = 5
PERCENT = 80
LIKELY = 8       # members of an opened group that are compared before all others
SAMPLED = 4      # one in so many possible tokens shows that a document stands alone


def shingle_sets(texts: list[bytes], width: int = SHINGLE):
    """Distinct shingle hashes of each text: one sorted array and where each text's begin."""
    words = Words(texts, lower=True)
    doc, value = [], []
    if len(words.hash) >= width:
        hashed = windows(words.hash, width)
        inside = words.doc[:len(hashed)] == words.doc[width - 1:]
        doc.append(words.doc[:len(hashed)][inside])
        value.append(hashed[inside])
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):  # the whole sequence stands for itself
        prints = sequence_prints(words.hash, words.first, 1)
        doc.append(short)
        value.append(prints[short])
    if not doc:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))
    doc, value = doc[new], value[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))


def _summaries(width: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in pieces(batch):
                tokens, first = shingle_sets(texts_of(pdf), width)
                n = np.diff(first)
                out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n": n})
                for k in range(2):
                    out[f"print{k}"] = signed(sequence_prints(tokens, first, k))
                key = np.zeros(len(pdf), np.int64)
                some = n > 0
                if some.any():
                    key[some] = signed(np.minimum.reduceat(mixed(tokens + U64(1)),
                                                           first[:-1][some]))
                sample = tokens % U64(SAMPLED) == 0
                out["key"] = key
                out["sample"] = [signed(tokens[a:b][sample[a:b]])
                                 for a, b in zip(first, first[1:])]
                yield out
    return of


def _full_sets(width: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in pieces(batch):
                tokens, first = shingle_sets(texts_of(pdf), width)
                yield pdf.drop(columns="text").rename(columns={"doc_id": "doc"}).assign(
                    tokens=[signed(tokens[a:b]) for a, b in zip(first, first[1:])])
    return of


def least_overlap(n: Column, percent: int) -> Column:
    """Tokens that a set of ``n`` must share with any set similar to it."""
    return F.ceil(n * percent / 100).cast("long")


def similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _headed(left: DataFrame) -> DataFrame:
    """``doc_id, n, head, paired``: the first class of the hash, and whether it has others."""
    heads = left.groupBy("key").agg(F.min("doc").alias("head"),
                                    (F.count("*") > 1).alias("paired"))
    return left.join(heads, "key").select(F.col("doc").alias("doc_id"), "n", "head", "paired")


def _grouped(sets: DataFrame, percent: int) -> DataFrame:
    """``doc, n, tokens, group``: the group is the first class of the hash, if similar to it.

    Only sets that have another one to be compared with are exchanged.
    """
    first = sets.where("paired and doc = head").select(
        "head", F.col("n").alias("n2"), F.col("tokens").alias("t2"))
    same = _alike("n", "tokens", "n2", "t2", percent)
    met = sets.where("doc <> head").join(first, "head").select(
        "doc", "n", "tokens", F.when(same, F.col("head")).otherwise(F.col("doc")).alias("group"))
    return stored(met.union(sets.where("doc = head").select("doc", "n", "tokens", "head")))


def labelled(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc, group``: the component of each document, itself where it has no edge."""
    found = components(edges).withColumnsRenamed({"id": "doc", "component": "_group"})
    return docs.join(found, "doc", "left").withColumn(
        "group", F.coalesce("_group", "doc")).drop("_group")


def _contested(rows: DataFrame, percent: int) -> DataFrame:
    """Of ``doc, n, group, token``, the tokens that several groups hold, with their use ``df``.

    A class is done if the tokens that it shares with other groups are too few.
    """
    shown = stored(rows.groupBy("token").agg(
        F.min("group").alias("least"), F.max("group").alias("most"), F.count("*").alias("df"))
        .where("least <> most").select("token", "df"))
    known = rows.join(shown, "token")
    left = stored(known.groupBy("doc", "n").agg(F.count("*").alias("m"))
                  .where(F.col("m") >= least_overlap(F.col("n"), percent)).select("doc"))
    return stored(known.join(left, "doc"))


def _opened(member: DataFrame, groups: DataFrame, percent: int, largest: bool) -> DataFrame:
    """``doc, other``: the groups whose union of tokens covers a class as far as a link needs.

    With ``largest``, a token shows the largest of its groups only.
    """
    # Sorted by use, the first token that two similar sets share is among the rarest of both, as
    # many as leave fewer than the threshold behind them.
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("df", "token"))
    count = F.count("*").over(Window.partitionBy("doc"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    rarest = stored(member.withColumns({"rank": rank, "m": count}).where(
        F.col("rank") <= F.col("m") - least_overlap(F.col("n"), percent) + 1)
        .select("doc", "n", "group", "token", "rank", "m").join(sizes, "group"))
    found = rarest.groupBy("token", F.col("group").alias("other")).agg(
        F.min("n").alias("small"), F.max("n").alias("large"), F.min("size").alias("others_size"))
    if largest:
        found = found.groupBy("token").agg(F.min(F.struct(
            (-F.col("others_size")).alias("_"), "other", "small", "large", "others_size"))
            .alias("top")).select("token", "top.*").drop("_")
    # no member that fits is smaller than this, so a similar one shares so many tokens at least
    fitting = F.greatest("small", least_overlap(F.col("n"), percent))
    needed = F.ceil(percent * (F.col("n") + fitting) / (100 + percent)).cast("long")
    # a pair of groups is looked at from one side: from the smaller, of equal ones the larger id
    candidates = stored(rarest.join(found, "token").where(
        ((F.col("size") < F.col("others_size"))
         | ((F.col("size") == F.col("others_size")) & (F.col("group") > F.col("other"))))
        & (F.col("group") != F.col("other"))
        & (100 * F.col("n") >= percent * F.col("small"))
        & (100 * F.col("large") >= percent * F.col("n"))
        & (F.col("rank") <= F.col("m") - needed + 1))
        .groupBy("doc", "other").agg(F.min(needed).alias("needed")))
    dropped(rarest)
    unions = member.select("token", F.col("group").alias("other")).distinct()
    opened = stored(member.select("doc", "token").join(candidates, "doc")
                    .join(unions, ["token", "other"]).groupBy("doc", "other", "needed")
                    .agg(F.count("*").alias("bound")).where("bound >= needed")
                    .select("doc", "other"))
    dropped(candidates)
    return opened


def _heads(groups: DataFrame) -> DataFrame:
    """Of each group, ``other``, the smallest id and a few more, and how many it has."""
    return groups.groupBy(F.col("group").alias("other")).agg(F.array_distinct(F.array(
        F.min("doc"), *(F.min_by("doc", F.xxhash64("doc", F.lit(k))) for k in range(LIKELY - 1))))
        .alias("heads"), F.count("*").alias("size"))


def _to_heads(opened: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of classes to the heads of groups opened for them: one link joins two groups."""
    pairs = opened.join(_heads(groups), "other").select(
        "doc", "other", F.explode("heads").alias("b"))
    return _verified(pairs, sets, percent)


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``group, now``: the group that each one is part of with the links ``doc, other``."""
    joined = labelled(groups.select(F.col("group").alias("doc")).distinct(), links.join(
        groups, "doc").select(F.col("group").alias("a"), F.col("other").alias("b")))
    return stored(joined.select(F.col("doc").alias("group"), F.col("group").alias("now")))


def _between_groups(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Edges between members of different groups, by way of the token-group matrix."""
    member = _contested(sets.select("doc", "n", "group", F.explode("tokens").alias("token")),
                        percent)
    first = _to_heads(_opened(member, groups, percent, True), groups, sets, percent)
    groups = stored(groups.join(_merged(groups, first), "group").select(
        "doc", F.col("now").alias("group")))
    again = stored(member.select("doc", "n", "token").join(groups, "doc"))
    dropped(member)
    full = _contested(again, percent)
    dropped(again)
    opened = _opened(full, groups, percent, False)
    dropped(full)
    second = _to_heads(opened, groups, sets, percent)
    # what is joined by the heads needs no more looking at
    now = _merged(groups, second)
    apart = stored(opened.join(_heads(groups).where(F.size("heads") < F.col("size"))
                               .select("other"), "other").join(groups, "doc").join(now, "group")
                   .join(now.select(F.col("group").alias("other"),
                                    F.col("now").alias("others_now")), "other")
                   .where("now <> others_now").select("doc", "other"))
    edges = first.union(second).union(_in_opened(apart, sets, groups, percent))
    return edges.select(F.col("doc").alias("a"), "b")


def _in_opened(apart: DataFrame, sets: DataFrame, groups: DataFrame,
               percent: int) -> DataFrame:
    """Links of ``(doc, other)`` to members of the group ``other``.

    A group's core are the tokens that most of its members have. Two sets whose differences from
    the core have d1 and d2 tokens, o of them in common, differ in d1 + d2 - 2 o tokens. So a class
    near the core is surely similar to the member nearest to it; any other must share o > 0 tokens
    of these differences, which few do even where all members have nearly the same tokens.
    """
    size = groups.groupBy(F.col("group").alias("other")).agg(F.count("*").alias("size"))
    size = stored(apart.select("other").distinct().join(size, "other"))
    held_by = stored(groups.select("doc", F.col("group").alias("other")).join(size, "other"))
    sets = _picked(apart.select("doc").union(held_by.select("doc")), sets)
    use = stored(sets.join(held_by, "doc").select(
        "other", "size", F.explode("tokens").alias("token")).groupBy("other", "token").agg(
        F.count("*").alias("use"), F.first("size").alias("size"))
        .withColumn("core", 2 * F.col("use") > F.col("size")))
    core = size.select("other").join(use.where("core").groupBy("other").agg(
        F.collect_list("token").alias("core")), "other", "left").withColumn(
        "core", F.coalesce("core", F.array().cast("array<bigint>")))
    # of two sets with these weights, at least (weight + weight) / (2 (100 + percent)) differences
    # are common
    weight = (100 + percent) * F.size("d") - (100 - percent) * F.col("n")
    differing = F.concat(F.array_except("tokens", "core"), F.array_except("core", "tokens"))

    def differences(named: DataFrame) -> DataFrame:
        return stored(named.join(sets.select("doc", "n", "tokens"), "doc").join(core, "other")
                      .select("doc", "other", "n", differing.alias("d"))
                      .withColumn("w", weight.cast("long")))

    asking = differences(apart)
    inside = differences(held_by.select("doc", "other"))
    nearest = inside.groupBy("other").agg(F.min("w").alias("least"),
                                          F.min_by("doc", F.struct("w", "doc")).alias("b"))
    asking = asking.join(nearest, "other")
    sure = asking.where("w + least <= 0").select("doc", "other", "b")
    asking = asking.where("w + least > 0").drop("b")
    least_asking = asking.groupBy("other").agg(F.min("w").alias("least"))

    def common(w: Column, v: Column) -> Column:
        return F.ceil((w + v) / (2 * (100 + percent)))

    def rarest(sets_of: DataFrame) -> DataFrame:
        """The differences of which one must be common, from those that fewest members have."""
        met = F.when(F.col("core"), F.col("size") - F.col("use")).otherwise(F.col("use"))
        rank = F.row_number().over(Window.partitionBy("doc", "other").orderBy("met", "token"))
        return sets_of.withColumn("m", F.size("d")).withColumn("token", F.explode("d")).drop(
            "d").join(use, ["other", "token"], "left").withColumn(
            "met", F.coalesce(met, F.lit(0))).withColumn("rank", rank).withColumn(
            "after", F.col("m") - F.col("rank") + 1).where(
            F.col("after") >= common(F.col("w"), F.col("least"))).where("met > 0").select(
            "doc", "other", "token", "w", "after")

    members = rarest(inside.join(least_asking, "other")).withColumnsRenamed(
        {"doc": "b", "w": "v", "after": "after_b"})
    pairs = rarest(asking).join(members, ["other", "token"]).where(
        F.least("after", "after_b") >= common(F.col("w"), F.col("v"))).select(
        "doc", "other", "b").distinct()
    return sure.union(_verified(pairs, sets, percent))


def _picked(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of some classes: wide rows move once, whatever is joined to them after that."""
    wanted = stored(docs.distinct())
    return stored(sets.select("doc", "n", "tokens").join(wanted, "doc", "left_semi"))


def _alike(n1: str, t1: str, n2: str, t2: str, percent: int) -> Column:
    """Whether two whole sets of these sizes are similar."""
    a, b = F.col(n1), F.col(n2)
    fits = (100 * a >= percent * b) & (100 * b >= percent * a)
    return fits & similar(F.size(F.array_intersect(t1, t2)), a, b, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``doc, b`` whose whole sets are similar."""
    pairs = stored(pairs)
    some = _picked(pairs.select("doc").union(pairs.select(F.col("b").alias("doc"))), sets)
    own = some.select("doc", F.col("n").alias("n1"), F.col("tokens").alias("t1"))
    other = some.select(F.col("doc").alias("b"), F.col("n").alias("n2"),
                        F.col("tokens").alias("t2"))
    found = stored(pairs.join(own, "doc").join(other, "b").where(
        _alike("n1", "t1", "n2", "t2", percent)).select(*pairs.columns))
    dropped(some)
    return found


@operator
def similar_groups(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for each row of documents.

    ``class_id`` is the smallest id with the same set. Ids are taken to name one text each.
    """
    all_docs = stored(numbered(named(docs, "text").mapInPandas(
        _summaries(width), "doc_id string, n long, print0 long, print1 long, key long, "
                           "sample array<long>")))
    prints = ["print0", "print1", "n"]
    classes = all_docs.where("n > 0 and doc_id is not null").groupBy(*prints).agg(
        F.min("doc_id").alias("class_id"))
    narrow = all_docs.select("doc_id", *prints).join(classes, prints, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id")
    narrow = stored(narrow)

    # copies are few: the first of each class is what they leave, so the others are not exchanged
    copies = stored(narrow.where("doc_id <> class_id").select("doc_id").distinct())
    first = all_docs.join(copies, "doc_id", "left_anti").where("n > 0 and doc_id is not null")
    single = first.select("doc_id", F.explode("sample").alias("token")).groupBy("token").agg(
        F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
    alone = single.groupBy("doc_id").agg(F.count("*").alias("own"))
    once = first.select("doc_id", "n", "key").dropDuplicates(["doc_id"])
    left = stored(once.join(alone, "doc_id", "left").where(
        F.coalesce("own", F.lit(0)) <= F.col("n") - least_overlap(F.col("n"), percent)).select(
        F.col("doc_id").alias("doc"), "n", "key"))

    dropped(all_docs)
    # what is known of a class goes through the step that reads its text, so sets are not joined
    told = stored(docs.select("doc_id", "text").join(_headed(left), "doc_id").dropDuplicates(
        ["doc_id"]).mapInPandas(_full_sets(width), "doc long, n long, head long, paired boolean, "
                                                   "tokens array<long>"))
    sets = _grouped(told, percent)
    dropped(told)
    groups = stored(sets.select("doc", "group"))
    edges = groups.where("doc <> group").select(F.col("doc").alias("a"), F.col("group").alias("b"))
    edges = edges.union(_between_groups(sets, groups, percent))
    final = labelled(left.select("doc"), stored(edges)).select(
        F.col("doc").alias("class_id"), "group")
    return narrow.join(final, "class_id", "left").select(
        "doc_id", "n_shingles", "class_id",
        F.coalesce("group", "class_id", "doc_id").alias("component_id"))
