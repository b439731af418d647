"""Vector codes, cross-tokenizer alignment and the quality classifier against plain versions."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlens.llm import alignment, quality, vector_codes

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
BIG = 2 ** 53 + 1
SCHEMA = "doc_id long, text string, label string, part string, block long, score double"


# --- vector codes ------------------------------------------------------------------------------

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(id, label, codes, error) of each usable vector, and the entries, by plain rounds."""
    usable = [(i, y, np.floor(np.asarray(v, np.float64) * 4096).astype(np.int64))
              for i, y, v in rows if v is not None and len(v)
              and all(x is not None and np.isfinite(x) for x in v)]
    usable.sort(key=lambda r: (r[0] is None, r[0], r[2].astype("<i4").tobytes()))
    x = np.array([v for _, _, v in usable]).reshape(len(usable), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(3)
        code = d.argmin(2)
        if r < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    error = d.min(2).sum(0)
    return [(i, y, "".join(f"{c:02x}" for c in code[:, k]), int(error[k]))
            for k, (i, y, _) in enumerate(usable)], books


def test_ball_rounds_equal_a_look_at_all_entries():
    rng = np.random.default_rng(0)
    for _ in range(100):
        k = rng.integers(1, 17)
        x = rng.integers(-6, 7, (rng.integers(1, 200), rng.integers(1, 5)))
        last = rng.integers(-6, 7, (k, x.shape[1]))   # ties and equal entries are common
        book = last + rng.integers(-2, 3, last.shape) * (rng.random((k, 1)) < .6)
        code = vector_codes.nearest(x, last)
        got, _ = vector_codes.moved_balls(x, code, last, book)
        assert (got == ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()


def test_balls_skip_work_where_entries_are_apart():
    rng = np.random.default_rng(1)
    centre = rng.integers(-9000, 9000, (16, 8))
    x = np.concatenate([c + rng.integers(-90, 90, (50, 8)) for c in centre])
    code = vector_codes.nearest(x, centre)
    book = np.array([x[code == i].mean(0) for i in range(16)]).astype(np.int64)
    got, compared = vector_codes.moved_balls(x, code, centre, book)
    assert (got == code).all() and compared == 0


def test_codes_match_plain_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(0, 3)) if i % 7 else None,
             (rng.normal(0, 0.2, 16) + (i % 4)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, 1, None), (301, 1, []), (302, None, [None] * 16), (303, 2, [float("nan")] * 16),
             (304, 2, [float("inf")] + [0.0] * 15), rows[5], rows[5], (BIG, 1, rows[7][2]),
             (None, 1, rows[8][2]), (None, None, rows[9][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding "
                               "array<float>, code string").repartition(3)
    found = vector_codes.compress(df)
    want, books = plain_codes(rows)
    sums = collections.Counter()
    for _, y, _, e in want:
        sums[y] += e
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    got = sorted(((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256)
                  for r in found.collect()), key=key)
    text = ",".join(str(x) for x in books.ravel())
    assert got == sorted(((*r, sums[r[1]], hashlib.sha256(text.encode()).hexdigest())
                          for r in want), key=key)


def test_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, label string, embedding array<double>"
    few = spark.createDataFrame([(i, "a", [float(i)] * 8) for i in range(3)]
                                + [(9, "a", [1.0] * 16), (10, "a", [1e9] * 8)], schema)
    got = {r.vec_id: r for r in vector_codes.compress(few).collect()}
    assert set(got) == {0, 1, 2} and all(r.error == 0 for r in got.values())
    assert [got[i].code for i in range(3)] == [f"{i:02x}" * 8 for i in range(3)]
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, "a", None)], schema)).count() == 0


# --- alignment -----------------------------------------------------------------------------------

def plain_alignment(texts):
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    own = alignment.pair_of(A, B)
    docs, df = [], collections.Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t or "")
        if not t or b"".join(own.b_bytes[i] for i in b) != whole:
            docs.append(None)
            continue
        spans = []
        for ids, of in ((a, own.a_bytes), (b, own.b_bytes)):
            end = np.cumsum([len(of[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *end], end, ids)))
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1]
                 if max(x[0], y[0]) < min(x[1], y[1])]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        said = ";".join("|".join(",".join(str(i) for s, e, i in side if lo < e <= hi)
                                 for side in spans) for lo, hi in zip([0, *ends], ends))
        docs.append((len(a), len(b), len(ends), links, said))
        df.update(set(links))
    top = collections.defaultdict(int)
    for (i, _), n in df.items():
        top[i] = max(top[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (
        *d[:3], len(d[3]), sum(df[x] == top[x[0]] for x in d[3]), sum(df[x] for x in d[3]),
        hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


def random_texts(n):
    rng = random.Random(4)
    alphabet = "aab be tth \n\t\r  ßéö日本😀<>|_0123'sS.,; ▁İ"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)]


def test_products_match_dense_ones():
    rng = np.random.default_rng(0)

    def sparse(x):
        r, c = np.nonzero(x)
        return alignment.Csr(np.searchsorted(r, np.arange(len(x) + 1)), c, x[r, c], x.shape[1])

    def dense(x):
        out = np.zeros((len(x.first) - 1, x.width), int)
        out[x.row_of, x.columns] = x.values
        return out

    for _ in range(100):
        m, k, n = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (m, k)), rng.integers(0, 3, (k, n))
        assert (dense(alignment.product(sparse(x), sparse(y))) == x @ y).all()
        assert (dense(sparse(x).transposed()) == x.T).all()


def test_numbers_come_out_of_bytes():
    values = np.array([0, 1, 127, 128, 300, 2 ** 21 - 1, 2 ** 21, 2 ** 40, 5])
    assert (alignment.read(alignment.written(values)) == values).all()
    assert len(alignment.read(alignment.written(values[:0]))) == 0


def test_alignment_matches_plain_version(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    texts = [None, "", " ", "▁x", "Hello wörld, 日本語 😀 <s> it's\n\n\tdon't   stop",
             "the the the cat sat", "  x  ", "<|endoftext|> a</s>", " " * 50, "the cat"]
    texts = texts + random_texts(60) + texts
    rows = [(BIG + i if i else None, t, "x", "y", 7, 0.5) for i, t in enumerate(texts)]
    found = alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
                      r.groups_sha256) for r in found}
    assert got == {r[0]: w for r, w in zip(rows, plain_alignment(texts))}
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align(empty, A, B).count() == 0 and alignment.links(empty, A, B).count() == 0


def test_links_are_rows(spark):
    texts = random_texts(40) + ["plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = alignment.align(df, A, B).agg(F.sum("n_links"), F.sum("n_shared")).first()
    overlap = alignment.links(df, A, B)
    assert overlap.count() == total[0] and overlap.agg(F.min("shared")).first()[0] >= 1
    grouped = alignment.links(df, A, B, by_group=True)
    assert grouped.count() == total[1]
    pair = ["doc_id", "a_index", "b_index"]   # tokens that overlap are in one group
    assert overlap.select(pair).subtract(grouped.select(pair)).count() == 0


def test_long_text_is_aligned_in_stretches():
    text = " ".join(random_texts(3000)).replace("▁", "")
    pair = alignment.pair_of(A, B)
    here = alignment.aligned(pair, [text])
    once = [np.concatenate(x) for x in zip(*here.links())]
    parts = [np.concatenate(x) for x in zip(*alignment.overlaps(here.a_end, here.b_end, 1000))]
    assert len(here.a) > 9000 and all((x[:2] == y[:2]).all() for x, y in zip(once, parts))
    pairs = [sorted(set(zip(x[0].tolist(), x[1].tolist()))) for x in (once, parts)]
    assert pairs[0] == pairs[1] and len(pairs[1]) == len(parts[0])
    assert once[2].sum() == parts[2].sum() == here.a_end[-1]


# --- quality ---------------------------------------------------------------------------------------

def plain_features(text, log2):
    """Distinct n-grams by looking at each word; features share a hash, so counts suffice."""
    words = text.split()
    out = len(words) + max(0, len(words) - 1) + 1
    gaps = "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in f" {text} ")
    return out + sum(" " not in gaps[i + 1:i + n - 1] for n in quality.NGRAMS
                     for i in range(len(gaps) - n + 1))


def test_features_are_counted_by_text():
    texts = ["", "a", "the cat", "ééé 日本 the\ncat", "  ", "x" * 40, "the cat"]
    each = [np.concatenate([b[t == i] for b, t in quality.features(texts)]) for i in range(7)]
    assert [len(x) for x in each] == [plain_features(t, 17) for t in texts]
    assert (np.sort(each[2]) == np.sort(each[6])).all()
    alone = np.concatenate([b for b, _ in quality.features(["ééé 日本 the\ncat"])])
    assert (np.sort(alone) == np.sort(each[3])).all()


def test_look_up_equals_the_mean_of_vectors():
    texts = ["good clean words here", "bad $$$ ### bad bad", "", "clean words"]
    bags = list(quality.bags(texts))
    logit = quality.trained(bags, np.array([1, 0, 0, 1]), 2, epochs=30)
    got = quality.Model([0, 1], logit, np.array([0.1, 0.2])).probabilities(texts)
    for (bucket, count), p in zip(bags, got):
        mean = (logit[bucket] * (count / count.sum())[:, None]).sum(0) + [0.1, 0.2]
        assert p == pytest.approx(quality.softmax(mean), abs=1e-6)
    assert got[0, 1] > 0.5 > got[1, 1]


def labelled_texts(n):
    rng = random.Random(9)
    good, bad = ("the", "and", "river", "small", "house"), ("$$$", "buy", "now", "###", "click")
    out = []
    for i in range(n):
        label = int(rng.random() < 0.8)
        out.append((i, " ".join(rng.choices(good if label else bad + good[:2], k=30)), label))
    return out


def test_classifier_tells_held_out_texts(spark):
    data = labelled_texts(400)
    docs = spark.createDataFrame([(i, t, "x", "y", 1, 2.0) for i, t, _ in data], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, label int")
    model = quality.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == y for i, _, y in data if i % 3 == 1]
    assert len(got) == 400 and np.mean(held) > 0.97
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(7), quality.fit(
        docs.repartition(5), labels, F.col("doc_id") % 3 != 1)).collect()}
    assert again == got   # the sample and the order of training do not depend on the partitions
    # the learned texts decide, not the labels of the held-out ones
    swapped = labels.withColumn("label", F.when(F.col("doc_id") % 3 == 1, 1 - F.col("label"))
                                .otherwise(F.col("label")))
    same = quality.fit(docs, swapped, F.col("doc_id") % 3 != 1)
    assert (same.logit == model.logit).all()


def test_classes_drawn_at_different_rates_keep_their_odds(spark):
    data = labelled_texts(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, label int")
    model = quality.fit(docs, labels, F.lit(True), rows_per_class=20)
    ones = sum(y for _, _, y in data)
    drawn = [(400 - ones) / np.exp(model.prior[0]), ones / np.exp(model.prior[1])]
    assert all(n == pytest.approx(round(n)) and 8 <= n <= 36 for n in drawn)
    few = quality.fit(docs, labels, F.lit(True), total_bytes=64 * 200)   # bounded by bytes
    drawn = [(400 - ones) / np.exp(few.prior[0]), ones / np.exp(few.prior[1])]
    assert all(20 <= n <= 70 for n in drawn)


def test_classifier_takes_odd_rows(spark):
    data = labelled_texts(60)
    long_text = " ".join(t for _, t, _ in data) * 300
    rows = [(i, t, "x", "y", 1, 2.0) for i, t, _ in data] + [
        (None, None, None, None, None, None), (BIG, "", "x", "y", 1, 2.0), (BIG, "!?", "x", "y", 1, 2.0),
        (0, data[0][1], "x", "y", 1, 2.0), (70, long_text, "x", "y", 1, 2.0)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    labels = spark.createDataFrame(
        [(i, y) for i, _, y in data] + [(None, 1), (5, 0), (5, 1), (70, 0), (2, 7), (BIG, None)],
        "doc_id long, label int")
    got = quality.score(docs, quality.fit(docs, labels, F.lit(True))).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id is not None)[-1][1] == BIG
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    none = spark.createDataFrame([], SCHEMA)
    no_labels = labels.limit(0)
    assert {r.score for r in quality.score(docs, quality.fit(docs, no_labels, F.lit(True)))
            .collect()} == {0.5}
    only_ones = labels.where("label = 1 and doc_id <> 5")
    assert {r.score for r in quality.score(docs, quality.fit(docs, only_ones, F.lit(True)))
            .collect()} == {1.0}
    assert quality.score(none, quality.fit(none, labels, F.lit(True))).count() == 0
