"""What is read from texts, in the stage that scans them: term hits, keywords found, counted terms.

Texts are tokenised and searched once. What leaves the stage are the features; neither joins nor
exchanges nor later tables carry a text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from rosterlens import fixed_values as fv
from rosterlens.functions.basics import let
from rosterlens.functions.lexicon import text_hits
from rosterlens.functions.scores import phrases_found
from rosterlens.settings import Lexicon, Settings
from rosterlens.sources.scratch import Scratch, materialise

FEATURES = ("term_hits", "found", "terms")


def english_stop_words() -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def stop_words(settings: Settings) -> tuple[str, ...]:
    return settings.stop_words if settings.stop_words is not None else english_stop_words()


def _head(array: Column, start: int) -> Column:
    """All but one element: from ``start``, one shorter than the array."""
    return F.slice(array, start, F.greatest(F.size(array) - 1, F.lit(0)))


def with_terms(docs: DataFrame, text: str, stop: tuple[str, ...]) -> DataFrame:
    """Add ``terms``, an array of ``(term, tf)`` of words and word pairs, counted inside each row.

    Stop words leave before pairs are formed, so pairs bridge them. Counting
    is a sort of the row's terms followed by run lengths.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(fv.TOKEN), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))

    def in_order(u: Column) -> Column:
        pairs = F.zip_with(_head(u, 1), _head(u, 2), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.sort_array(F.concat(u, pairs))

    # a lambda is called for every element: one pass finds the runs, one counts them
    def starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                        lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def runs(s: Column) -> Column:
        return let(starts(s), lambda b: F.transform(b, lambda i, k: F.struct(
            F.get(s, i).alias("term"),
            (F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    # one expression: a filter that the optimizer moves below it repeats it once, not once an element
    return docs.withColumn("terms", let(words, lambda u: F.when(
        F.size(u) > 0, let(in_order(u), runs)).otherwise(none)))


def with_text_features(docs: DataFrame, text: str, lexicon: Lexicon, keywords: Iterable[str],
                       settings: Settings) -> DataFrame:
    """Put the features of ``text``, which is in lower case, in its place. A null text is empty.

    ``term_hits``: lexicon terms per domain; ``found``: which of ``keywords`` the text holds, in
    their order; ``terms``: its words and word pairs with their counts.
    """
    lower = F.coalesce(text, F.lit(""))
    return with_terms(docs.withColumns({
        "term_hits": text_hits(lower, lexicon), "found": phrases_found(lower, keywords), text: lower}),
        text, stop_words(settings)).drop(text)


def of_pool(features: DataFrame, pool: DataFrame, key: str,
            scratch: Scratch | None = None) -> DataFrame:
    """Features of the rows of ``pool``; both are written tables.

    Only keys are compared to find texts without a row. They are written: the size of that table
    tells Spark that it can drop them where the features are read, without an exchange of terms.
    """
    keep = materialise if scratch is None else scratch.keep
    orphans = keep(features.select(key).join(pool.select(key), key, "left_anti"))
    return features.join(orphans, key, "left_anti")
