"""License scans, decontamination, token files and BPE: against the plain way, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from revcast.llm import bpe_automaton, decontaminate, licenses, token_store
from revcast.llm.common import alnum_words, shared_path
from tests.llm.helpers import AWKWARD, LONG, docs_of

LETTERS = "aaaabbeinthsr.,'!1٣ \t\n\x1c\x85\xa0éÉÅǺΣςßİK日本🙂<|>"


def random_texts(n, seed=3, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most))) for _ in range(n)]


# --- licenses

def test_templates_accept_what_their_expressions_accept():
    templates = licenses.default_templates()
    automaton = licenses.TemplateAutomaton(templates)
    rng = random.Random(1)
    vocabulary = sorted({w for t in templates for k, w in ((p[0], p[1]) for p in t.parts) if k == "word" for w in w})
    for _ in range(300):
        t = rng.choice(templates)
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))]
        for kind, what in t.parts:
            if kind == "word":
                words.append(rng.choice(sorted(what)))
            elif kind == "any":
                words += ["zzz"] * rng.randint(0, what + (rng.random() < 0.1))
        words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "qqq"
        found = {k for k, _, _ in automaton.scan([w.encode() for w in words])}
        joined = " " + " ".join(words) + " "
        assert found == {k for k, t in enumerate(templates) if re.search(t.regex(), joined)}


def test_optional_and_replaceable_regions():
    t = licenses.Template.parse("t", "x", "grant [[free of charge]] to {*2} users")
    a = licenses.TemplateAutomaton([t])
    scan = lambda s: a.scan(s.encode().split())
    assert scan("we grant free of charge to all kind users now") == [(0, 1, 9)]
    assert scan("grant to users") == [(0, 0, 3)]
    assert scan("grant free to users") == [] and scan("grant to a b c users") == []
    with pytest.raises(ValueError):
        licenses.Template.parse("t", "x", "{*2} words")


def test_license_names_and_identifiers(spark):
    cases = {
        "// SPDX-License-Identifier: MIT": "mit,spdx",
        "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0,spdx",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0,spdx",
        "SPDX-License-Identifier: LGPL-2.1": "lgpl,spdx",
        "SPDX-License-Identifier: AGPL-3.0-only": "agpl,spdx",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0,spdx",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause,spdx",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2.0,spdx",
        "SPDX-License-Identifier: LicenseRef-own": "spdx",
        "the BSD 3-Clause License": "bsd-3-clause",
        'BSD 2-Clause "Simplified" License': "bsd-2-clause",
        "Mozilla Public License Version 2.0": "mpl-2.0",
        "under GNU GPL v3": "gpl-3.0",
        "under GNU GPL version 2": "gpl-2.0",
        "a clause of 3 lines, no licence": "",
        "the gnu gpl has 3 versions": "",
    }
    got = {r.doc_id: r for r in licenses.license_report(docs_of(spark, list(enumerate(cases)))).collect()}
    assert {t: got[k].labels for k, t in enumerate(cases)} == cases
    assert not any(r.n_base for r in got.values())


GPL_NOTICE = """
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
APACHE_NOTICE = """
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License."""


def test_whole_license_notices(spark):
    gpl2 = GPL_NOTICE.replace("version 3", "version 2")
    cases = [
        (GPL_NOTICE, "gpl,gpl-3.0,gpl-3.0-or-later"),
        (gpl2, "gpl,gpl-2.0,gpl-2.0-or-later"),
        (GPL_NOTICE[:GPL_NOTICE.index("#\n# This program is dist")], "gpl,gpl-3.0,gpl-3.0-or-later"),  # the second part may be missing
        (GPL_NOTICE.replace("any later", "any earlier"), "gpl,gpl-3.0"),  # a mandatory word differs
        (GPL_NOTICE.replace("General", "Lesser General"), "lgpl,lgpl-3.0-or-later"),
        (gpl2.replace("General", "Lesser General").replace("version 2", "version 2.1"), "lgpl,lgpl-2.1-or-later"),
        (GPL_NOTICE.replace("General", "Affero General"), "agpl,agpl-3.0-or-later"),
        (APACHE_NOTICE, "apache,apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
         "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
         "gpl,gpl-3.0,gpl-text"),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
         "apache,apache-2.0,apache-text"),
        ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
         "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
         "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
         "CONSEQUENTIAL DAMAGES", "bsd-disclaimer"),
    ]
    got = {r.doc_id: r.labels for r in licenses.license_report(docs_of(spark, [(k, t) for k, (t, _) in enumerate(cases)])).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
    whole = {r.doc_id: r.matches for r in licenses.find_licenses(docs_of(spark, [(0, GPL_NOTICE), (7, APACHE_NOTICE)])).collect()}
    last = max((m for m in whole[0] if m.label == "gpl-3.0-or-later"), key=lambda m: m.end)
    assert GPL_NOTICE[last.end_char - 7:last.end_char] == "details"  # the optional part belongs to the match
    assert max(m.weight for m in whole[7]) > 0.999999


def test_licenses_on_awkward_rows(spark):
    rows = AWKWARD + [(20, "MIT License. Mit-license! Licensed under the Apache License, Version 2.0"), (21, "GNU General\nPublic (License) v3")]
    got = {r.doc_id: r for r in licenses.license_report(docs_of(spark, rows)).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].first_word is None and got[1].labels == "" and got[1].score == 0
    assert (got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels) == (3, 0, 7, "apache,mit")
    assert got[20].labels == "apache,apache-2.0,mit" and got[21].labels == "gpl,gpl-3.0"
    spans = {r.doc_id: r.matches for r in licenses.find_licenses(docs_of(spark, rows)).collect()}
    m = next(m for m in spans[21] if m.base)
    assert rows[-1][1][m.start_char:m.end_char] == "GNU General\nPublic (License"
    assert licenses.license_report(docs_of(spark, [])).count() == 0
    assert licenses.license_report(docs_of(spark, rows)).count() == len(rows)


# --- decontamination

def brute_contamination(text, items):
    words = alnum_words((text or "").encode())
    hit, who = set(), set()
    for i, t in items:
        w = alnum_words((t or "").encode())
        for win in ([w[k:k + 13] for k in range(len(w) - 12)] if len(w) >= 13 else [w] if w else []):
            for p in range(len(words) - len(win) + 1):
                if words[p:p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    who.add(str(i) if i is not None else "")
    return len(words), len(hit), sorted(who)


def test_contamination_equals_brute_force_in_one_part_and_in_many(spark):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(30)] + ["É", "the"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for k in range(12)]
    items += [(3, items[3][1]), (None, "a null id item"), (40, None), (41, "  "), (42, "..")]
    docs = list(AWKWARD)
    for k in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        piece = alnum_words((rng.choice(items)[1] or "").encode()) if rng.random() < 0.7 else []
        at = rng.randint(0, len(words))
        docs.append((100 + k, " ".join(words[:at] + [p.decode() for p in piece] + words[at:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.MAX_BYTES, 60):
        got = decontaminate.find_contamination(docs_of(spark, docs), bench, max_bytes=limit).collect()
        want = sorted((repr(i), *map(repr, brute_contamination(t, items))) for i, t in docs)
        assert sorted((repr(r.doc_id), repr(r.n_words), repr(r.n_hit), repr(sorted(r["items"]))) for r in got) == want
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
        text = dict(docs)
        for r in got:
            for s in r.spans:
                inside = alnum_words(text[r.doc_id][s.start_char:s.end_char].encode())
                assert len(inside) == s.end - s.first


def test_decontamination_keeps_columns_and_clean_rows(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = docs_of(spark, [*AWKWARD, (50, "x " + passage), (51, LONG + " " + passage)])
    bench = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert left.count() == len(AWKWARD) + 1  # 20 of 60,020 words are less than a twentieth
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == docs.count()
    assert decontaminate.contamination_report(docs.where("false"), bench).count() == 0


# --- token files

@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(token_store._path("byte_bpe_50k.json"))


def test_token_file_equals_the_library(spark, byte_tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_BYTES", 1 << 10)
    special = ["a <|endoftext|> b", "<|endoftext|>", "  <|endoftext|>x  ", "x" * 500 + " y" * 3, "don't we'll 'sx"]
    rows = [(i, t) for i, t in AWKWARD if i is not None] + [(100 + 3 * k, t) for k, t in enumerate(random_texts(400) + special)]
    docs = docs_of(spark, rows).repartition(5)
    path = shared_path(spark, "test-tokens")
    token_store.write_tokens(docs, path)
    got = token_store.read_tokens(spark, path).orderBy("doc_id", "start").collect()
    start = 0
    want = sorted((i, byte_tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    assert len(got) == len(want)
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_file_of_null_ids_and_of_nothing(spark):
    got = token_store.token_file_report(docs_of(spark, [(None, "b"), (3, None), (1, "a a")])).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (1, 2), (3, 5)] and got[2].n_tokens == 1
    assert token_store.token_file_report(docs_of(spark, [])).count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 50, 300):
        counts = rng.integers(1, 1000, n)
        heap = counts.tolist()
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert cost == (counts * token_store.code_lengths(counts)).sum()
    steep = token_store.code_lengths((1.7 ** np.arange(40)).astype(np.int64) + 1, 8)
    assert steep.max() <= 8 and (2.0 ** -steep).sum() <= 1
    with pytest.raises(ValueError):
        token_store.code_lengths(np.ones(300, np.int64), 8)


# --- BPE automaton

@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe_automaton.vocabulary_path())


def test_automaton_equals_the_library(spark, word_tokenizer):
    rng = random.Random(8)
    texts = random_texts(1500, 9) + ["a" * n for n in range(1, 80)] + ["".join(rng.choice("abe") for _ in range(60)) for _ in range(100)]
    texts += ["a<|endoftext|>b <|startoftext|><|endoftext|", "<|endoftext|>", "İStanbul ΑΣ ΑΣΑ", LONG]
    rows = [*AWKWARD, *((100 + k, t) for k, t in enumerate(texts))]
    got = sorted(bpe_automaton.token_digests(docs_of(spark, rows).coalesce(2)).collect(), key=repr)
    want = []
    for i, t in rows:
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids
        back = word_tokenizer.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(back)))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert bpe_automaton.token_digests(docs_of(spark, [])).count() == 0


def test_encode_then_decode_through_ids(spark, word_tokenizer):
    rows = [(1, "The cat sat."), (2, None)]
    got = {r.doc_id: r for r in bpe_automaton.encode_texts(docs_of(spark, rows)).collect()}
    ids = word_tokenizer.encode("The cat sat.", add_special_tokens=False).ids
    assert got[1]["__ids"] == ids and got[1]["__decoded"] == word_tokenizer.decode(ids, skip_special_tokens=False)
    assert got[2]["__ids"] == [] and got[2]["__decoded"] == ""


def test_compiled_automaton_looks_at_no_merges(word_tokenizer, monkeypatch):
    bpe = bpe_automaton.WordBpe(bpe_automaton.vocabulary_path())

    def never(*_):
        raise AssertionError("a merge was looked at after compiling")

    for name in ("chain", "_allowed", "_gadget"):
        monkeypatch.setattr(bpe_automaton.MergeGadgets, name, never)
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (1, 2, 3, 7, 20, 150, 250, 900) for _ in range(20)]
    for w in words + ["a" * n for n in (1, 2, 3, 8, 199, 200, 201, 333)] + ["naïveté", "日本語" * 90]:
        ids = word_tokenizer.encode(w, add_special_tokens=False).ids
        assert bpe.encode(w) == ids, w
        codes = bpe.inside[np.frombuffer(w.encode(), np.uint8)] if w.isalpha() and w.islower() and w.isascii() else None
        if codes is not None:
            codes[-1] = bpe.at_end[ord(w[-1])]
            assert bpe.automaton._reach_one(codes.tolist()) == bpe.automaton._reach(codes, np.array([0]), np.array([len(codes)])).tolist()


def test_automaton_of_a_toy_merge_list_replays_the_merges():
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "c"), ("a", "a"), ("aa", "b"), ("bc", "a"), ("b", "ab")]
    automaton = bpe_automaton.TokenAutomaton(list("abc"), merges)
    rank = {m: k for k, m in enumerate(merges)}
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        parts = list(word)
        while True:
            best = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
            if best is None:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert automaton.encode(word, len(word)) == parts, word
