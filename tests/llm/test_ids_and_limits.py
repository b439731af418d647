"""Exact ids, many sources, rare code points, long texts, plain versions of decoding and packing."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rosterlens.llm import (alignment, ctw, host_rules, jaccard, language_id, mixing, packing,
                            quality, substrings, suffix_dedup, token_counts, vector_codes, vectors)

BIG = 2 ** 53 + 1
A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(("the", "ra", "on", "li", "é"), k=rng.randint(1, 4)))
                    for _ in range(n))


@pytest.fixture(scope="module")
def big(spark):
    """Ids that doubles cannot tell apart, beside null ids, in one batch."""
    copied = prose(1, 120)
    rows = [(BIG + i, prose(i, 60) if i % 3 else copied, "xx" if i % 2 else "yy", f"s{i % 2}",
             BIG if i else None) for i in range(12)]
    rows += [(None, copied, None, None, None), (None, None, "xx", "s0", 3)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))


def test_every_operator_keeps_large_ids_beside_null_ones(spark, big):
    want = [BIG + i for i in range(12)] + [None, None]
    model = language_id.fit(big, F.lit(True))
    labels = big.select("doc_id", F.expr("cast(doc_id % 2 as int)").alias("label"))
    found = {
        "op1": language_id.predict(big, model), "op2": ctw.score(big, F.lit(False), 2),
        "op4": jaccard.similar_groups(big), "op5": host_rules.judge(big),
        "op7": mixing.mixed_order(big, mixing.square_root_weights(big)),
        "op8": substrings.repeats(big), "op9": suffix_dedup.dedup(big),
        "op10": token_counts.count_tokens(big, WORDS, 10), "op12": alignment.align(big, A, B),
        "op13": quality.score(big, quality.fit(big, labels, F.lit(True)))}
    for name, df in found.items():
        assert ids(df) == want, name
    pieces = packing.pack_documents(big, A)
    assert ids(pieces.where("piece = 0")) == want
    kept = language_id.accepted(big, model)
    assert set(ids(kept)) <= set(want) and set(ids(kept, "n_chars")) <= {BIG, 3, None}
    groups = {r["doc_id"]: r["component_id"] for r in found["op4"].collect()}
    assert groups[BIG + 9] == BIG and groups[BIG + 4] == BIG + 4   # 0, 3, 6, 9 are copies


def test_vector_operators_keep_large_ids(spark):
    rows = [(BIG + i if i else None, [1.0, i % 3 + 0.5] * 4, 1 if i % 4 else None)
            for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    want = [BIG + i for i in range(1, 9)] + [None]
    assert ids(vector_codes.compress(df), "vec_id") == want
    near = vectors.near_duplicates(df)
    assert ids(near, "vec_id") == want
    assert {r["vec_id"]: r["component_id"] for r in near.collect()}[BIG + 7] == BIG + 1


# --- mixing ------------------------------------------------------------------------------------

def plain_edf(shares, cycle):
    """Source of each slot, by looking at every source."""
    done, order = [0] * len(shares), []
    for t in range(cycle):
        ready = [(-(-(done[i] + 1) * cycle // p), p, i) for i, p in enumerate(shares)
                 if done[i] < p and done[i] * cycle // p <= t]
        pick = min(ready)[2]
        done[pick] += 1
        order.append(pick)
    return order


def test_taking_turns_equals_looking_at_every_source(spark):
    for shares in ([1], [5, 3, 2], [4, 4, 4, 1, 1, 1, 7, 7], [1] * 9 + [20], [13, 7, 7, 2, 2, 2]):
        cycle = sum(shares)
        df = spark.createDataFrame([(f"s{i:02d}", p) for i, p in enumerate(shares)],
                                   "source string, share long")
        got = sorted((r["at"], r["source"], r["turn"]) for r in
                     mixing.cycle_order(df, cycle).collect())
        want, seen = [], {}
        for t, i in enumerate(plain_edf(shares, cycle)):
            want.append((t, f"s{i:02d}", seen.get(i, 0)))
            seen[i] = seen.get(i, 0) + 1
        assert got == want, shares


def test_five_thousand_sources_keep_every_row(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5003))
        .alias("source"))
    got = mixing.mixed_order(rows, mixing.square_root_weights(rows), block=2)
    assert got.count() == 20_000 and got.select("doc_id").distinct().count() == 20_000
    assert got.groupBy("slot").agg(F.countDistinct("source").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError, match="sources do not fit"):
        mixing.mixed_order(rows, mixing.square_root_weights(rows), cycle=1000)


# --- tokens --------------------------------------------------------------------------------------

def fuzzed(n):
    rng = random.Random(12)
    planes = [(0x20, 0x7F), (0xA0, 0x24F), (0x300, 0x5FF), (0x600, 0x10FF), (0x2000, 0x2BFF),
              (0x3040, 0x9FFF), (0xAC00, 0xD7A3), (0xE000, 0xFFFF), (0x10000, 0x1FFFF),
              (0x20000, 0x2FA1F), (0xE0000, 0xE01EF)]
    texts = ["9)@\U00018d9dN", "\U00018d9d", "ǅ ŉ ﬁ", "<|endoftext|>a<|startoftext|>"]
    for _ in range(n):
        low, high = rng.choice(planes)
        texts.append("".join(chr(rng.choice((rng.randint(low, high), rng.randint(0x20, 0x7E))))
                             for _ in range(rng.randint(1, 12))))
    return texts


def test_counts_equal_the_library_on_all_planes():
    tokenizer, counts = Tokenizer.from_file(WORDS), token_counts.Counts(WORDS)
    texts = fuzzed(40_000)
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = counts.of(texts)
    assert [(t, a, b) for t, a, b in zip(texts, got, want) if a != b] == []


# --- language ID ------------------------------------------------------------------------------------

def test_decoding_equals_a_look_at_every_codeword():
    rng = np.random.default_rng(3)
    code = language_id.codewords(5)
    trust = rng.random(code.shape[1])
    model = language_id.Model(list("abcde"), code, np.zeros((1, code.shape[1])), trust / trust.sum())
    lean = rng.normal(0, 0.05, (40, code.shape[1]))
    lean[7] = 0                                      # a tie of all codewords: the first, unsure
    best, score, unsure = language_id.decoded(model, lean)
    for k, row in enumerate(lean):
        loss = [sum(w * np.log1p(np.exp(-language_id.SHARPNESS * (1 if bit else -1) * x))
                    for bit, x, w in zip(word, row, model.trust)) for word in code]
        assert best[k] == int(np.argmin(loss))
        near = [np.exp((min(loss) - x) * code.shape[1]) for x in loss]
        assert score[k] == pytest.approx(1 / sum(near))
        two = sorted(loss)[:2]
        assert unsure[k] == (two[1] - two[0] < language_id.AMBIGUOUS * max(loss))
    assert best[7] == 0 and unsure[7]


# --- packing ------------------------------------------------------------------------------------------

def plain_best_two_fit(lengths, capacity):
    """Bins of lengths, document by document."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        chosen, gap = [], capacity
        for x in list(left):                       # greedily, longest first
            if x <= gap:
                chosen.append(x)
                gap -= x
                left.remove(x)
        if gap and len(chosen) > 1:
            small = min(chosen)
            room = gap + small
            pairs = [(a + b, a, b) for a, b in itertools.combinations(left, 2) if a + b <= room]
            if pairs and max(pairs)[0] > small:
                _, a, b = max(pairs)
                chosen.remove(small)
                left += [small]
                for x in (a, b):
                    left.remove(x)
                    chosen.append(x)
                left.sort(reverse=True)
        bins.append(chosen)
    return bins


def test_plan_fills_bins_like_document_by_document():
    rng = random.Random(8)
    for trial in range(30):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 60))]
        plain = plain_best_two_fit(lengths, 64)
        plan = packing.plan({x: lengths.count(x) for x in set(lengths)}, 64)
        used = sorted(x for pattern, times in plan for x in pattern * times)
        assert used == sorted(x for b in plain for x in b) == sorted(lengths)
        assert abs(sum(times for _, times in plan) - len(plain)) <= 1
        # the first bin is the same; later ones may differ in how ties of a pair's sum are broken
        assert sum(plan[0][0]) == sum(plain[0])


# --- long texts ------------------------------------------------------------------------------------------

def test_long_texts_go_through_every_operator(spark):
    """Ten times the size at which a text is handled alone, beside short rows."""
    long_text = prose(5, 2_000_000)
    assert len(long_text.encode()) > 10 << 20
    rows = [(0, "short one", "xx", "a", 1), (1, long_text, "xx", "a", 1), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    n_bytes, n_words = len(long_text.encode()), 2_000_000
    model = language_id.fit(docs, F.lit(True))
    assert language_id.predict(docs, model).where("lang_pred = 'xx'").count() == 2
    assert {r["n_bytes"] for r in token_counts.count_tokens(docs, WORDS, 9).collect()} == {
        9, n_bytes, 0}
    sets = {r["doc_id"]: r["n_shingles"] for r in jaccard.similar_groups(docs).collect()}
    assert sets[0] == 1 and sets[1] > 1000
    words = {r["doc_id"]: r["n_words"] for r in substrings.repeats(docs).collect()}
    assert words == {0: 2, 1: n_words, 2: 0}
    pieces = packing.cut(docs, A).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    coded = Tokenizer.from_file(A).encode(long_text, add_special_tokens=False).ids
    assert {r["doc_id"]: r["n"] for r in pieces}[1] == len(coded) + 1
    got = {r["doc_id"]: r for r in alignment.align(docs, A, B).collect()}
    assert got[1]["n_a"] > 10 ** 6 and got[2]["n_a"] == 0
    quality_of = quality.score(docs, quality.fit(docs, docs.selectExpr(
        "doc_id", "cast(doc_id as int) label").where("doc_id < 2"), F.lit(True)))
    assert quality_of.count() == 3


def test_crc_of_a_piece_is_that_of_its_ids(spark):
    docs = spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")
    row = packing.pack_documents(docs, A).first()
    coded = [*Tokenizer.from_file(A).encode("the cat sat", add_special_tokens=False).ids, 0]
    assert row["ids_crc32"] == zlib.crc32(np.array(coded, "<u4").tobytes())


# --- context trees ---------------------------------------------------------------------------------------

def test_dictionary_of_a_block_equals_plain_counts():
    import pandas as pd
    texts = ["the cat sat", "", "the the cat", "no no no", "the cat sat"]
    trains = [True, True, False, True, False]
    pdf = pd.DataFrame({"text": texts, "trains": trains})
    counted, distinct = (ctw._dictionary(pdf, 2, c) for c in (True, False))
    for word in (True, False):
        want = {}
        for text, used in zip(texts, trains):
            raw = text.encode()
            if word:
                keys = ctw.signed(ctw.Words([raw], lower=True).hash).tolist()
            else:
                keys = ctw._padded([raw], 2)[0].tolist()
            for key in keys:
                want[key] = want.get(key, 0) + used
        key, n = counted[word]
        assert dict(zip(key.tolist(), n.tolist())) == want and sorted(want) == key.tolist()
        assert distinct[word][0].tolist() == key.tolist()
    nothing = ctw._dictionary(pdf[:0], 2)
    assert len(nothing[True][0]) == len(nothing[False][0]) == 0
    keys = np.array([3, 5, 9, 12])
    assert ctw._places(keys, np.array([9, 3, 12, 3, 5])).tolist() == [2, 0, 3, 0, 1]


def _pipeline_packed(spark, docs, path):
    docs.write.parquet(str(path))
    out = corpus_pipeline.packed(spark, spark.read.parquet(str(path)), "")
    return sorted((r["sequence_id"], r["offset"], r["doc_id"], r["piece"]) for r in out.collect())


def test_the_order_of_the_mix_decides_the_packed_sequences(spark, tmp_path):
    rows = [(i, " ".join(["word"] * (40 + 30 * (i % 11)))) for i in range(160)]
    schema = "doc_id long, text string"
    kept = {r[0]: r[1] for r in rows}
    there = spark.createDataFrame(rows, schema)
    mixes = {way: there.repartitionByRange(3, F.col("doc_id") * way).sortWithinPartitions(
        F.col("doc_id") * way) for way in (1, -1)}
    got = {way: _pipeline_packed(spark, df, tmp_path / f"m{way}") for way, df in mixes.items()}
    assert got[1] != got[-1]
    for way, found in got.items():
        assert sorted(f[2] for f in found) == sorted(kept)
        first = {}
        for sequence, _, doc, _ in found:
            first[sequence] = min(first.get(sequence, way * doc), way * doc)
        # sequences are numbered without gaps by their earliest document of the mix
        assert [first[s] for s in sorted(first)] == sorted(first.values())
        assert sorted(first) == list(range(len(first))) and first[0] == min(way * d for d in kept)
