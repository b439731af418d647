"""Token counts by a whole-token shortcut.

Offline, every vocabulary string is encoded alone: those that give exactly one token, themselves,
are proven whole. A pre-token among them counts one at sight; only the others are merged, each
once while it is remembered.

A null text is empty: no bytes, no tokens. Other columns are not looked at. Repeated rows are counted
one by one; a null id stays null. An empty table gives an empty one. The pre-tokens of one text stand in
memory whole, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rosterlens.llm.common import hand_out, named, numbered, pieces

WORD_END = "</w>"
REMEMBERED = 400_000


class Counts:
    """Number of tokens of texts.

    Tokens never hold white space, so what lies between two spaces counts by itself and is
    looked at once while it is remembered. Normalisation and pre-tokens are those of the file, by
    the library that reads it: its Unicode tables decide what a letter is.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.normal = self.tokenizer.normalizer.normalize_str
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = self.tokenizer.model.tokenize
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.around = re.compile("|".join(map(re.escape, special))).split if special \
            else lambda x: [x]
        self.whole = self.proven()
        self.merged: dict[str, int] = {}
        self.units: dict[str, int] = {}

    def proven(self) -> frozenset[str]:
        """Pre-tokens, as the vocabulary writes them, whose text alone encodes to one token."""
        letters = byte_letters()
        written, texts, ids = [], [], []
        for entry, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if not entry.endswith(WORD_END):
                continue
            own = entry[:-len(WORD_END)]
            try:
                text = bytes(letters[c] for c in own).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and [p for p, _ in self.split(text)] == [own]:
                written.append(own)
                texts.append(text)
                ids.append(i)
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return frozenset(w for w, i, e in zip(written, ids, found) if e.ids == [i])

    def word(self, x: str) -> int:
        if x in self.whole:
            return 1
        if x not in self.merged:
            self.merged[x] = len(self.merge(x))
        return self.merged[x]

    def unit(self, x: str) -> int:
        parts = self.around(x)
        return len(parts) - 1 + sum(self.word(w) for p in parts
                                    for w, _ in self.split(self.normal(p)))

    def of(self, texts: list[str]) -> list[int]:
        for store in (self.merged, self.units):
            if len(store) > REMEMBERED:
                store.clear()
        out = []
        for text in texts:
            units = text.split(" ")
            for x in units:
                if x not in self.units:
                    self.units[x] = self.unit(x)
            out.append(sum(map(self.units.__getitem__, units)))
        return out


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    return Counts(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of whole texts."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts = counts_of(tokenizer)
        for batch in batches:
            for pdf in pieces(batch):
                texts = [t or "" for t in pdf["text"]]
                n = np.array(counts.of(texts), np.int64)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(),
                                    "n_bytes": [len(t.encode()) for t in texts],
                                    "n_tokens": n, "over_limit": n > limit})

    hand_out(docs.sparkSession)
    return numbered(named(docs, "text").mapInPandas(
        of, "doc_id string, n_bytes long, n_tokens long, over_limit boolean"))
