"""Order MinHash, counted phrases and ball-tree search against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revcast.llm import ball_tree, collocations, order_minhash as omh
from revcast.llm.common import mix64
from revcast.llm.quotient_filter import Packing
from tests.llm.helpers import AWKWARD, docs_of

# ---- Order MinHash


def plain_fingerprint(text):
    """Every function over every element, without thresholds or chunks."""
    codes = np.array([ord(c) for c in text], np.uint32)
    grams = omh.kmers(codes)
    seen, values = Counter(), []
    for g in grams.tolist():
        with np.errstate(over="ignore"):
            values.append(int(mix64(np.array([g], np.uint64) + np.uint64(seen[g]) * np.uint64(0x9E3779B97F4A7C15))[0]) >> 32)
        seen[g] += 1
    out = []
    for j in range(omh.FUNCTIONS):
        hashed = [((v ^ int(omh._FLIP[j])) * int(omh._FACTOR[j])) % (1 << 32) for v in values]
        at = sorted(sorted(range(len(hashed)), key=lambda p: (hashed[p], p))[: omh.TUPLE])
        total = int(omh._OF_FUNCTION[j])
        for place, p in enumerate(at):
            total += int(grams[p]) * int(omh._IN_TUPLE[place])
        out.append(int(mix64(np.array([total % (1 << 64)], np.uint64))[0]) >> 32)
    return "".join(f"{x:08x}" for x in out)


def share(a, b):
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / omh.FUNCTIONS


def plain_report(rows):
    """rows: (doc_id, text) in the order in which they follow each other."""
    out = []
    for k, (key, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(after)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, share(own, other), share(own, following)))
    return sorted(map(repr, out))


TEXTS = ["", "a", "ab", "abcdefg", "abcdefgh", "the the the the the the the", "日本語のテキスト、とても短い 🙂🙂🙂🙂🙂🙂🙂🙂🙂🙂", "word " * 40,
         "one two three four five six seven eight nine ten " * 7, None, " \n\t" * 30]


@pytest.mark.parametrize("ranges", [1, 4])
def test_report_equals_plain_version(spark, ranges):
    rows = [(10 * k, t) for k, t in enumerate(TEXTS)]
    got = omh.edited_report(docs_of(spark, rows), ranges=ranges).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_report(sorted(rows, key=lambda r: -r[0]))


def test_single_empty_and_repeated_rows(spark):
    one = omh.edited_report(docs_of(spark, [(1, "only one text, and no other one")])).collect()
    assert [r.near_next for r in one] == [1.0]
    assert omh.edited_report(docs_of(spark, [])).collect() == []
    got = omh.edited_report(docs_of(spark, AWKWARD), ranges=3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((k is None, k or 0) for k, _ in AWKWARD)
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    assert {r.doc_id: r.near_edited for r in got}[2] == 1.0


def test_fingerprints_follow_the_edit_distance(spark):
    words = [f"w{(k * 7919) % 4001}" for k in range(600)]
    text = " ".join(words)
    swapped = " ".join(words[300:] + words[:300])
    light = " ".join(words[:100] + ["changed"] + words[101:])
    other = " ".join(f"v{(k * 104729) % 5003}" for k in range(600))
    got = {r.doc_id: r.fingerprint for r in omh.fingerprints(docs_of(spark, enumerate([text, swapped, light, other, text]))).collect()}
    assert got[0] == got[4] == plain_fingerprint(text)
    assert share(got[0], got[2]) > 0.9 > 0.75 > share(got[0], got[1]) > share(got[0], got[3])  # same k-mers in another order count less
    pair = spark.createDataFrame([(got[0], got[1])], "a string, b string").select(omh.likeness("a", "b").alias("x")).first().x
    assert pair == share(got[0], got[1])


def test_long_text_in_one_row(spark):
    text = "".join(chr(97 + (k * k) % 23) for k in range(400_000))
    got = omh.edited_report(docs_of(spark, [(1, text), (2, "x" * 50_000)])).collect()
    assert {r.doc_id: r.n_chars for r in got} == {1: 400_000, 2: 50_000}


# ---- counting quotient filters


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([(2, 1), (2, 5), (3, 4), (3, 21), (2, 32), (3, 22), (3, 32)]), st.data())
def test_filters_give_back_what_went_in(shape, data):
    n, bits = shape
    rows = data.draw(st.lists(st.tuples(*[st.integers(0, min((1 << bits) - 1, 5 if data.draw(st.booleans()) else 1 << 40))] * n), max_size=60))
    pack = Packing(n, bits)
    halves = []
    shard_bits = data.draw(st.integers(0, 7))
    for part in (rows[::2], rows[1::2]):
        ids = [np.array([r[j] for r in part], np.int64) for j in range(n)]
        upper, low, counts = pack.count(*pack.keys(ids))
        assert len(part) == 0 or [tuple(int(c[k]) for c in pack.ids(*pack.keys(ids))) for k in range(len(part))] == part
        shard = pack.shard(upper, shard_bits)
        for s in np.unique(shard):
            mine = shard == s
            halves.append((int(s), pack.build(upper[mine], None if low is None else low[mine], counts[mine], shard_bits)))
    found = Counter()
    for s in {s for s, _ in halves}:
        upper, low, counts = pack.merge([f for t, f in halves if t == s])
        for *gram, c in zip(*pack.ids(upper, low), counts.tolist(), strict=True):
            found[tuple(int(g) for g in gram)] += int(c)
    assert found == Counter(rows)


def test_counters_of_more_than_a_byte():
    pack = Packing(2, 10)
    upper, low = pack.keys([np.arange(5), np.arange(5)])
    upper, low, counts = pack.count(upper, low, np.array([1, 254, 255, 256, 10**12], np.uint64))
    raw = pack.build(upper, low, counts)
    assert sorted(pack.read(raw)[2].tolist()) == [1, 254, 255, 256, 10**12]
    assert sorted(pack.merge([raw, raw])[2].tolist()) == [2, 508, 510, 512, 2 * 10**12]


# ---- collocations


def plain_collocations(rows, min_count, top):
    one, two, three = Counter(), Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            ws = [w for w in re.split("[ \t]", piece) if w]
            for f, n in ((one, 1), (two, 2), (three, 3)):
                f.update((lang, *ws[k : k + n]) for k in range(len(ws) - n + 1))
    f = one + two + three
    found = {g: a for g, a in (two + three).items() if a >= min_count}
    out = []
    for (lang, *ws), a in found.items():
        longer = [b for (other, *xs), b in found.items() if other == lang and len(xs) > len(ws) and any(xs[k : k + len(ws)] == ws for k in range(2))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cut = min((1_000_000 * a * a // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k) for k in range(1, len(ws)))
        out.append((lang, " ".join(ws), a, f[lang, *ws[: cut[1]]], f[lang, *ws[cut[1] :]], cut[0]))
    n = Counter()
    for (lang, _), c in one.items():
        n[lang] += c
    ranked = []
    for lang in {o[0] for o in out}:
        best = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[5], -o[2], o[1].encode()))[:top]
        ranked += [(lang, k + 1, p, a, left, right, n[lang], s) for k, (_, p, a, left, right, s) in enumerate(best)]
    return sorted(ranked)


PHRASES = [("New York is big, New York is far. new york IS here", "en"), ("a b c a b c a b c a b", "en"), ("a b c; a b d; a b d\x0ba b d", None),
           ("", "en"), (None, "de"), ("é à é à é à\té à", "fr"), ("x " * 50, "fr"), ("a\x00b c d a\x00b c d", "und"), ("one two one two one two", "")] * 3


def frame(spark, rows):
    return spark.createDataFrame([(k % 5 or None, t, lang, 1, "z") for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string")


@pytest.mark.parametrize("block, gathered", [(4 << 20, 1 << 22), (16, 8)])
def test_collocations_equal_plain_version(spark, monkeypatch, block, gathered):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "GATHERED", gathered)
    got = collocations.collocations(frame(spark, PHRASES), min_count=3, top=7)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(PHRASES, 3, 7)


def test_no_phrases(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [("too rare", "en"), (None, None)])).collect() == []


def test_very_long_text_is_cut_behind_pieces(spark):
    text = ("some words that come again, " * 40_000) + "and one end"
    numbers = [collocations.number_words(p)[2].sum() for p in collocations._slices(text.encode(), 1 << 16)]
    assert len(numbers) > 10 and sum(numbers) == 5 * 40_000 + 3
    got = {r.phrase: r.a for r in collocations.collocations(frame(spark, [(text, "en")])).collect()}
    assert got == {"some words that": 40_000, "words that come": 40_000, "that come again": 40_000}


# ---- ball-tree search


def plain_search(docs, items, k=50):
    term = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    cut = lambda t: term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    bags = [b for b in bags if b[1]]
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc, bag in bags:
            m = 50 + 50 * sum(bag.values()) * len(bags) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(cut(text)) if bag[t])
            if score:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(found)[:k])]
    return sorted(map(repr, out))


def corpus(n=700):
    rng = np.random.default_rng(5)
    vocabulary = [f"t{k}" for k in range(300)]
    weights = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 60), p=weights / weights.sum())) for _ in range(n)]
    return list(enumerate(texts)) + AWKWARD + [(None, texts[3]), (3, texts[3]), (10_000, texts[3])]


ITEMS = [(1, "T1 t2 t7, t40 t200!"), (2, "t3"), (3, ""), (4, None), (5, "nowhere"), (6, "t1 t1 t1"), (6, "t1 t1 t1"), (None, "t9 one CASE 日本"), (8, " ".join(f"t{k}" for k in range(0, 300, 7)))]


@pytest.mark.parametrize("group, leaf, max_bytes", [(8_192, 64, 1 << 20), (100, 4, 40)])
def test_search_equals_plain_version(spark, monkeypatch, group, leaf, max_bytes):
    monkeypatch.setattr(ball_tree, "GROUP", group)
    monkeypatch.setattr(ball_tree.BallTree.__init__, "__defaults__", (leaf,))
    docs = corpus()
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = ball_tree.lexical_search(docs_of(spark, docs), items, max_bytes=max_bytes).collect()
    assert sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == plain_search(docs, ITEMS)


def test_search_over_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_tree.lexical_search(docs_of(spark, corpus(20)), none).collect() == []
    assert ball_tree.lexical_search(docs_of(spark, []), some).collect() == []


def test_subtrees_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(2)
    n, terms = 4_000, 40
    rows = [np.sort(rng.choice(np.arange(g * 10, g * 10 + 10), rng.integers(1, 8), replace=False)) for g in rng.integers(0, terms // 10, n)]
    at = np.cumsum([0, *map(len, rows)])
    value = rng.integers(1, 1_000_000, int(at[-1]))
    tree = ball_tree.BallTree(at, np.concatenate(rows), value, terms)
    query = np.zeros(terms, np.int64)
    query[10:20] = rng.integers(1, 20_000, 10)
    best, seen = ball_tree._Best(50), 0
    for some, score in tree.visit(query, query.astype(float), best.least):
        best.add(score, some, np.zeros(len(some), bool))
        seen += len(some)
    everything = tree.scores(np.arange(n), query)
    assert best.score.tolist() == sorted(everything.tolist(), reverse=True)[:50]
    assert seen < n / 2
    for node, (below, *_) in enumerate(tree.nodes):
        assert tree.bound(node, query.astype(float)) >= tree.scores(below, query).max()
