"""Host-level quality rules, in DataFrame functions only.

Each document is judged by its own rules; the failures are counted by host. A host's rate of
failures is shrunk towards that of all hosts with a beta prior fitted to the hosts themselves
(moments of their rates), so a host of few documents is not condemned by one. Verdicts on hosts
are joined back to the documents.

A null text has no words and fails its own rules. Rows without a host are judged by their own
rules alone. Repeated rows count as often as they stand there; a null id stays null. An empty table
gives an empty one. The words of one text are arrays in memory, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rosterlens.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20      # per cent of words
HOST_RATE = 0.5         # a host fails if its shrunk rate of failures is above


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that stand twice or more among the words of a text.

    Windows are sorted by two hashes, so equal ones are neighbours; the words that they cover are
    counted from the sorted places.
    """
    def window(i: Column) -> Column:
        own = [F.get(words, i + k) for k in range(WINDOW)]
        return F.struct(F.xxhash64(*own).alias("h"), F.hash(*own).alias("g"), i.alias("i"))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

    def twice(ordered: Column) -> Column:
        found = F.filter(ordered, lambda x, i: same(F.get(ordered, i - 1), x)
                         | same(F.get(ordered, i + 1), x))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda s, p: F.struct(
            (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")))["n"]

    spots = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window)
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(F.sort_array(spots), lambda ordered: covered(twice(ordered))))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id``, host and the counts of each whole text."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = docs.select(
        "doc_id", F.col(host).alias("host"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        .alias("n_dup_lines"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            lambda w: F.struct(F.size(w).cast("long").alias("n"),
                               repeated_words(w).alias("again"))).alias("_words"))
    return counts.select("doc_id", "host", F.col("_words.n").alias("n_words"), "word_chars",
                         "n_symbols", "n_dup_lines", F.col("_words.again").alias("n_repeat_words"))


def own_failure() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(judged: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """``host, docs, failures, rate, host_failed`` from ``host, base_failed``.

    The prior's mean and spread are those of the hosts' rates; where they do not spread, or more
    than a beta distribution can, the prior is worth one document.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"))
    mean, spread = F.col("mean"), F.col("spread")
    weight = F.when(spread > 0, F.greatest(F.lit(1.0), mean * (1 - mean) / spread - 1)) \
        .otherwise(1.0)
    strength = prior.select(mean.alias("mean"), weight.alias("weight"))
    shrunk = (F.col("failures") + F.col("mean") * F.col("weight")) \
        / (F.col("docs") + F.col("weight"))
    one_row = F.broadcast(strength)  # a single row
    return hosts.join(one_row, F.lit(True)).select(
        "host", "docs", "failures", shrunk.alias("rate"),
        (shrunk > host_rate).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """Counts, own failure, the host's shrunk rate and the verdict for each document."""
    judged = stored(measured(docs, host).withColumn("base_failed", own_failure()))
    verdicts = host_verdicts(judged, host_rate).select("host", "rate", "host_failed")
    kept = ~(F.col("base_failed") | F.coalesce("host_failed", F.lit(False)))
    return judged.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"), "host", F.col("rate").alias("host_rate"))
