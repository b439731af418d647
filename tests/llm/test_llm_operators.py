"""Operators against plain versions of themselves, on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rosterlens.llm import (components, ctw, host_rules, jaccard, language_id, mixing, packing,
                            substrings, suffix_dedup, token_counts, vectors)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string"


def prose(seed, n, syllables=("the", "ra", "on", "li", "é", "st", "um")):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage, long_text = prose(1, 70), prose(2, 400)
    words = long_text.split()
    near = " ".join(words[:200] + ["changed"] + words[201:])
    texts = [
        None, "", "   \n\t ", "A.", "one two three", long_text, long_text, near,
        near + " tail", prose(3, 120) + " " + passage + "\n" + prose(4, 90),
        passage + " " + prose(5, 60), prose(6, 30) + " " + passage, "x " * 200, "x " * 200,
        ("same line here now\n" * 4) + prose(7, 40), "### $$$ %%% &&&", "日本語 テキスト ß İ 😀",
        "<|endoftext|> a<|startoftext|>b 's!'s don't  x", long_text.upper(), prose(8, 3000),
        "ab" * 300, "ONE two three"]
    out = [(i, t, "xx" if i % 2 else "yy", f"s{i % 3}" if i % 5 else None, 0, "clash")
           for i, t in enumerate(texts)]
    return out + [out[5], (None, long_text, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + \
        [(i, i + 1) for i in range(100, 160)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 6, 30):
        code = language_id.codewords(n)
        apart = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
        assert min(apart) >= (code.shape[1] // 3 if n > 2 else 1)


def test_language_id_learns_and_rejects(spark, docs, empty):
    german = ("sch", "ung", "der", "eit", "ver")
    rows = [(i, prose(i, 40, german) if i % 2 else prose(i, 40), "de" if i % 2 else "fr")
            for i in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(train, F.col("doc_id") < 200)
    got = by_id(language_id.predict(train, model))
    held = [got[i]["lang_pred"] == rows[i][2] for i in range(200, 300)]
    assert np.mean(held) > 0.98 and all(0 <= r["score"] <= 1 for r in got.values())
    odd = by_id(language_id.predict(docs, model))
    assert len(odd) == 22 and [odd[i]["lang_pred"] for i in (0, 1, 2, 15)] == ["und"] * 4
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 1, 2, 15)").count() == 0
    blank = language_id.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, blank).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def sequential_kt(bits):
    count, total = [0, 0], 0.0
    for b in bits:
        total += np.log((count[b] + 0.5) / (sum(count) + 1))
        count[b] += 1
    return total


def test_kt_estimate_matches_sequential_coding():
    bits = [0, 1, 1, 0, 1, 1, 1]
    assert ctw.log_kt(np.array([2]), np.array([5]))[0] == pytest.approx(sequential_kt(bits))


def plain_ctw(train, texts, depth):
    """Trees as dictionaries, node by node."""
    seen = {}
    for t in train:
        padded = b"\0" * depth + t
        for i in range(depth, len(padded)):
            for bit in range(8):
                place = (1 << bit) | (padded[i] >> (8 - bit))
                for d in range(depth + 1):
                    node = (padded[i - d:i], place)
                    seen.setdefault(node, [0, 0])[padded[i] >> (7 - bit) & 1] += 1
    weighted = {}
    for node in sorted(seen, key=lambda x: -len(x[0])):
        own = ctw.log_kt(*(np.array([float(x)]) for x in seen[node]))[0]
        below = [weighted[(bytes([c]) + node[0], node[1])][0] for c in range(256)
                 if (bytes([c]) + node[0], node[1]) in seen]
        total = np.logaddexp(own, sum(below)) + np.log(0.5) if len(node[0]) < depth else own
        weighted[node] = (total, np.exp(np.log(0.5) + own - total) if len(node[0]) < depth else 1)
    out = []
    for t in texts:
        padded, total = b"\0" * depth + t, 0.0
        for i in range(depth, len(padded)):
            for bit in range(8):
                place, p = (1 << bit) | (padded[i] >> (8 - bit)), None
                for d in range(depth, -1, -1):
                    node = (padded[i - d:i], place)
                    if node in seen:
                        own = (seen[node][1] + 0.5) / (sum(seen[node]) + 1)
                        w = weighted[node][1]
                        p = own if p is None else w * own + (1 - w) * p
                p = 0.5 if p is None else p
                total += np.log10(p if padded[i] >> (7 - bit) & 1 else 1 - p)
        out.append(total)
    return out


def test_ctw_matches_plain_trees(docs, rows, empty):
    def out(x):
        return x % 10 == 0
    got = by_id(ctw.score(docs, F.col("doc_id") % 10 == 0, 3))
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    train = [t for i, t in texts if i is None or not out(i)]
    some = [x for x in texts if x[0] is not None and x[0] not in (19,)]
    want = plain_ctw(train, [t for _, t in some], 3)
    for (i, _), w in zip(some, want):
        assert got[i]["score"] == pytest.approx(w, rel=1e-5, abs=1e-9)
    tokens = [x for t in train for x in [*re.findall(rb"[^\x20\x09-\x0D]+", t.lower()), None]]
    v, n = len(set(tokens)), len(tokens)
    for i, t in some:
        own = [*re.findall(rb"[^\x20\x09-\x0D]+", t.lower()), None]
        base = sum(np.log10((tokens.count(x) + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["n_tokens"] == len(own)
        assert got[i]["n_known"] == sum(x in tokens for x in own)
    assert got[0]["train_tokens"] == n and ctw.score(empty, F.lit(False)).count() == 0


def test_plan_uses_every_length_and_beats_first_fit():
    rng = random.Random(5)
    lengths = [rng.choice((3, 17, 40, 55, 61, 98, 100)) for _ in range(500)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.plan(counts, 100)
    used = [x for pattern, times in plan for x in pattern * times]
    assert sorted(used) == sorted(lengths) and all(sum(p) <= 100 for p, _ in plan)
    bins = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, b in enumerate(bins) if b >= x), None)
        if at is None:
            bins.append(100 - x)
        else:
            bins[at] -= x
    assert sum(t for _, t in plan) <= len(bins) and packing.plan({}, 100) == []
    # the smallest of 60 + 30 gives way to 22 + 18
    assert ((60, 22, 18), 1) in packing.plan({60: 1, 30: 1, 22: 1, 18: 1}, 100)


def test_packing_round_trip(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]),
                                 path, 256).collect()
    pieces, places = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text, *_ in rows[:22]:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 256 for r in own[1:]) and own[0]["start"] == 0
        for r in own:
            assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, path).count() == 0


def shingles(text):
    words = tuple(WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "")))
    return {words[i:i + 5] for i in range(len(words) - 4)} if len(words) >= 5 else \
        ({words} if words else set())


def plain_groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_jaccard_groups_match_brute_force(spark, docs, rows, empty):
    got = by_id(jaccard.similar_groups(docs))
    want = plain_groups({r[0]: r[1] for r in rows if r[0] is not None})
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert jaccard.similar_groups(empty).count() == 0
    # families of copies at and about the threshold, with many stragglers
    rng = random.Random(11)
    texts, n = {}, 0
    for family in range(4):
        base = prose(100 + family, 90).split()
        for _ in range(45):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 50)}"
            texts[n] = " ".join(words)
            n += 1
    order = list(texts)
    rng.shuffle(order)
    texts = {k: texts[i] for k, i in enumerate(order)}
    got = by_id(jaccard.similar_groups(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_groups(texts)


def test_sets_without_a_partner_are_not_exchanged(spark):
    """What is moved to compare sets with the first of their hash, and sets by pairs."""
    sets = spark.createDataFrame(
        [(i, 1, i, False, [i]) for i in range(50)] + [(60, 5, 60, True, [1, 2, 3, 4, 5]),
                                                      (61, 5, 60, True, [1, 2, 3, 4, 5]),
                                                      (62, 5, 60, True, [1, 2, 3, 4, 9])],
        "doc long, n long, head long, paired boolean, tokens array<long>")
    kept = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "stored", lambda df: kept.append(df) or df)
        grouped = jaccard._grouped(sets, 80)
        assert {r["doc"]: r["group"] for r in grouped.collect()} == {
            **{i: i for i in range(50)}, 60: 60, 61: 60, 62: 62}
        some = jaccard._verified(spark.createDataFrame([(61, 60), (62, 60)], "doc long, b long"),
                                 grouped, 80)
        assert [tuple(r) for r in some.collect()] == [(61, 60)]
    moved = next(df for df in kept if df.columns == ["doc", "n", "tokens"])
    assert sorted(r["doc"] for r in moved.collect()) == [60, 61, 62]


def test_host_rules_counts(docs, rows, empty):
    got = by_id(host_rules.judge(docs))
    for i, text, *_ in rows[:22]:
        words = WORD.findall(text or "")
        windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        again = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"],
                got[i]["n_dup_lines"], got[i]["base_failed"]) == (
            len(words), sum(map(len, words)), len(again), len(lines) - len(set(lines)), failed)
        assert got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
    assert host_rules.judge(empty).count() == 0


def test_a_bad_host_takes_its_documents_along_but_one_failure_does_not(spark):
    rows = [(f"h{h}", i < bad) for h, (n, bad) in enumerate([(100, 95), (1, 1), *[(100, 2)] * 20])
            for i in range(n)]
    got = {r["host"]: r for r in host_rules.host_verdicts(
        spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got["h0"]["host_failed"] and not got["h5"]["host_failed"]
    assert 0.02 < got["h1"]["rate"] < 1


def test_cover_tree_covers_and_nests():
    rng = np.random.default_rng(1)
    points = rng.standard_normal((200, 8))
    points[100:] = points[:100] + 0.02 * rng.standard_normal((100, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    levels = vectors.cover_tree(points)
    for up, down in zip(levels, levels[1:]):
        assert set(up.centre) <= set(down.centre)
    for level in levels:
        apart = np.linalg.norm(points - points[level.centre[level.owner]], axis=1)
        assert (apart <= level.radius[level.owner] + 1e-6).all()


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 6))
    rows, n = [], 0
    for i in range(300):
        v = base[i % 40] + rng.standard_normal(6) * rng.choice([0, 0.05, 0.2])
        rows.append((n, [float(np.float32(x)) for x in v], int(i % 3)))
        n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 6, 1), (n + 2, [float("nan")] * 6, 1),
             (n + 3, rows[0][1], None), (n + 4, [1.0, None] + [0.0] * 4, 0), (n + 5, [], 0),
             (n + 6, rows[3][1][:5], 0), (n + 7, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: tuple(r) for r in vectors.near_duplicates(df, leaf=16).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows
            if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if label[a] == label[b]
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (i, sum(i in e for e in links), root[i], root[i] == i) for i in root}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_mix_keeps_every_row_and_stays_within_a_block(spark, docs, empty):
    rows = [(i, "abc"[min(i // 400, 2)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)],
                                    "source string, weight double")
    got = mixing.mixed_order(df, weights, block=4, cycle=100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    slots = {r["slot"]: r["source"] for r in got}
    placed = dict.fromkeys("abc", 0)
    full = next(t for t in itertools.count() if t not in slots)
    assert full >= 190
    shares = dict(mixing.shares(weights, 100).collect())
    for t in range(full):
        placed[slots[t]] += 1
        assert all(abs(placed[s] - shares[s] / 100 * (t + 1)) < 1 for s in "abc")
    assert mixing.mixed_order(docs, mixing.square_root_weights(docs)).count() == docs.count()
    assert mixing.mixed_order(empty, mixing.square_root_weights(empty)).count() == 0


def plain_repeats(texts, width=50):
    first, out = {}, {}
    for i in sorted(texts):
        words = (texts[i] or "").encode().split()
        own = {tuple(words[k:k + width]): k for k in range(len(words) - width + 1)}
        for w in own:
            first.setdefault(w, i)
        gone = {p for k in range(len(words) - width + 1) if first[tuple(words[k:k + width])] < i
                for p in range(k, k + width)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_word_repeats_match_brute_force(docs, rows, empty):
    got = by_id(substrings.repeats(docs))
    want = plain_repeats({r[0]: r[1] for r in rows if r[0] is not None})
    assert {i: tuple(r)[1:] for i, r in got.items()} == want
    assert substrings.repeats(empty).count() == 0


def test_extensions_equal_a_look_at_all_windows(spark, monkeypatch):
    """Few words, so that an anchor has many surroundings: the earliest use settles some of them,
    others meet only among the rest; also anchors at the edges of texts and twice in one."""
    rng = random.Random(11)
    passages = [rng.choices("abcd", k=rng.randint(5, 14)) for _ in range(6)]
    texts = {}
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choices("abcdefgh", k=rng.randint(0, 9)) + rng.choice(passages)
        texts[(1 << 53) + 7 * i] = " ".join(words)
    monkeypatch.setattr(substrings, "ANCHORS_AT_ONCE", 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for window, anchor in ((8, 3), (7, 6)):
        want = plain_repeats(texts, window)
        got = by_id(substrings.repeats(docs, window, anchor))
        assert {i: tuple(r)[1:] for i, r in got.items()} == want
        assert sum(w[1] > 0 for w in want.values()) > 50


def test_extension_stops_at_the_first_other_word_and_at_edges():
    texts = [b"p q r A B C s t u", b"q r A B C s x u", b"A B C s"]
    words = substrings.Words(texts)
    at = np.array([words.first[d] + texts[d].split().index(b"A") for d in range(3)])
    context, left, right = substrings.around(words, at[:1], 3, 4)
    assert (left[0], right[0]) == (3, 3)
    n = substrings.extended(words, at, 3, 4, context.repeat(3, 0), left.repeat(3), right.repeat(3))
    assert [list(x) for x in n] == [[3, 2, 0], [3, 1, 1]]


def test_a_shared_passage_goes_on_as_runs():
    """A passage in every document leaves one row a document, not one a window."""
    passage = prose(21, 200)
    texts = {i: f"{prose(100 + i, 30)} <{i} {passage} {i}> {prose(400 + i, 30)}" for i in range(40)}
    words = substrings.Words([t.encode() for t in texts.values()])
    start, choice, values = substrings.anchors_of(words, 50, 18)
    at = np.unique(choice)
    context, left, right = substrings.around(words, at, 18, 32)
    first = np.unique(values[at], return_index=True)[1]  # of each key, in the earliest document
    keys, head = values[at][first].view(np.int64), words.doc[at][first]
    docs = pd.DataFrame({"block": 0, "doc_id": list(texts), "text": list(texts.values())})
    seeds = pd.DataFrame({"key": keys, "block": 0, "seed": True, "head": head, "left": left[first],
                          "right": right[first], "context": [c.tobytes() for c in context[first]]})
    heads = pd.DataFrame({"key": list(texts), "block": 0, "seed": False, "head": 0, "left": 0,
                          "right": 0, "context": b""})
    found = substrings._extensions(50, 18)(docs, pd.concat([seeds, heads]))
    runs = found[found["run"] > 0]
    assert sorted(runs["doc_id"]) == list(range(1, 40)) and set(runs["run"]) == {151}
    assert set(runs["start"]) == {31}


def plain_cuts(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if raw[k:k + length] in seen:
                gone[k:k + length] = True
            seen.add(raw[k:k + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [100, 1])
def test_byte_repeats_match_brute_force(docs, rows, empty, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_OF_ANCHOR", most)  # 1: all by string hashes
    got = by_id(suffix_dedup.dedup(docs))
    want = plain_cuts({r[0]: r[1] for r in rows if r[0] is not None})
    assert {i: tuple(r)[1:5] for i, r in got.items()} == want
    assert suffix_dedup.dedup(empty).count() == 0


def test_parts_of_surroundings_cover_each_place_once():
    starts, lead = np.array([77, 1, 30, 40]), np.array([76, 0, 50, 39])
    row, offset, places, begin, end = suffix_dedup.parts_of(starts, lead, 100, 24)
    for i in range(4):
        mine = row == i
        assert sorted(p for o, n in zip(offset[mine], places[mine]) for p in range(o, o + n)) \
            == list(range(starts[i]))
    # the core lies in each string of the part, and around the anchor
    assert (begin >= offset + places - 1).all() and (end <= offset + 100).all()
    assert (begin <= lead[row]).all() and (end >= lead[row] + 24).all() and (end - begin >= 80).all()


def test_a_common_anchor_alone_asks_for_no_strings(spark, monkeypatch):
    """Strings with a common anchor are hashed for what they share beyond it, not one by one."""
    rng = random.Random(8)
    anchor = "an anchor of 24 bytes ab"
    texts = {i: f"{''.join(rng.choices('abcdefgh', k=76))}{anchor}"
                f"{''.join(rng.choices('abcdefgh', k=76))}" for i in range(150)}
    rows = [(i, 0, 77, 76, bytearray(t.encode())) for i, t in texts.items()]
    compared = spark.createDataFrame(rows, "doc_id long, start int, starts int, lead int, bytes binary")
    copies, different = suffix_dedup._parts_to_compare(compared, 100, 24)
    assert copies.count() == 0 and different.count() == 0
    # a string that two of them share is found; so are those of a long passage used 40 times
    shared = texts[3][40:150]
    texts |= {200: "x" * 9 + shared + "yz", 201: texts[4][:120]}
    passage = prose(31, 60)
    texts |= {300 + i: f"{i} {passage[:200 + 3 * i]} {prose(600 + i, 9)}" for i in range(40)}
    monkeypatch.setattr(suffix_dedup, "MOST_OF_ANCHOR", 5)  # both ways
    got = by_id(suffix_dedup.dedup(spark.createDataFrame(
        list(texts.items()), "doc_id long, text string")))
    assert {i: tuple(r)[1:5] for i, r in got.items()} == plain_cuts(texts)


def test_classes_are_those_of_equal_prefixes():
    rng = random.Random(4)
    reads = ["".join(rng.choices("ab", k=60)).encode() for _ in range(30)]
    reads += [r[7:] + b"zz" for r in reads[:10]]
    starts = np.array([len(r) - 11 for r in reads])
    read, offset, later = suffix_dedup.later_starts(reads, starts, 12)
    seen = set()
    for r, o, late in zip(read, offset, later):
        assert (reads[r][o:o + 12] in seen) == late
        seen.add(reads[r][o:o + 12])


def test_token_counts_match_the_library(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = by_id(token_counts.count_tokens(docs, path, 100))
    for i, text, *_ in rows[:22]:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (
            len((text or "").encode()), n, n > 100)
    assert token_counts.count_tokens(empty, path, 1).count() == 0


def test_pipeline_stages_hand_on_documents(spark, docs, rows):
    sent = docs.drop("label").where("doc_id is not null").dropDuplicates(["doc_id"])
    have, texts = sent, {r[0]: r[1] for r in rows if r[0] is not None}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        have = spark.createDataFrame(stage(spark, have, "").collect(), sent.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in have.collect()}
    assert not {0, 1, 2, 15} & set(kept["language_id"])
    left = {i: texts[i] for i in kept["language_id"]}
    alone = {i for i, (_, c) in plain_groups(left).items() if i == c}
    assert set(kept["ngram_jaccard"]) == alone
    cuts = plain_cuts({i: texts[i] for i in alone})
    assert set(kept["suffix_array_dedup"]) == {i for i, c in cuts.items() if c[0] > c[1]}
    for i, text in kept["suffix_array_dedup"].items():
        assert hashlib.sha256(text.encode()).hexdigest() == cuts[i][3]
    assert kept["mixing"] == kept["suffix_array_dedup"]
    assert corpus_pipeline.STAGES[-1][1](spark, have, "").count() >= len(kept["mixing"])
