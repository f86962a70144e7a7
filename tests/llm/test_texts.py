"""Operators on single texts, against brute force, the libraries, and exact round trips."""

import gzip
import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionloom.llm import bpe, langid, license_scan, linefreq, mixing, multihash, tokenfile, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
ODD = [
    None,
    "",
    " \n\t",
    "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>x",
    "don't 's ''t I'LL WE'VE",
    "ΑΣ Σας İstanbul ǅ ﬁ ½ ① 12345",
    "日本語 テスト 🎉🎉 a\x1cb \x85c d é É",
    "x" * 3000 + "!" * 3000,
    "\x00\x01 a\x7fb",
]
LIBRARY = Tokenizer.from_str(SPEC)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def frame(spark, texts):
    """Clashing extra columns, an id that is null and one that repeats."""
    rows = [(i, t, "x", 1, 2.0) for i, t in enumerate(texts)] + [(None, "null id", "x", 1, 2.0), (0, texts[0], "x", 1, 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, ids int, score double")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_bpe_is_the_library(text):
    own = bpe.tokenizer(SPEC)
    assert (own.encode(text), own.encode_bytes(text)[1]) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.text(alphabet=st.characters(min_codepoint=0x300, max_codepoint=0x36F), max_size=3), st.sampled_from(["İ", "'s", "'LL", ",", "Σ", "ς", " ", "\x1d", "<|endoftext|>", "가", "각", "á̧"])), max_size=12).map("".join))
def test_both_encoders_are_the_library_on_all_planes(text):
    own = bpe.tokenizer(SPEC)
    ids, decoded = library(text)
    assert (own.encode(text), own.encode_bytes(text)[1]) == (ids, decoded)
    assert np.frombuffer(tokenfile.library(SPEC).encode(text), "<u4").tolist() == ids


@pytest.mark.parametrize("pattern", ["%s,", "a%s1", "x%s y"])
def test_both_encoders_on_every_code_point(pattern):
    """Of planes 0 to 2 and 14; beyond them a sample, as nothing is assigned there."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x2FA20 or 0xE0000 <= c < 0xE0200 or c % 997 == 0)]
    texts = [pattern % chr(c) for c in points]
    own, lib = bpe.tokenizer(SPEC), tokenfile.library(SPEC)
    want = [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]
    assert not [t for t, ids in zip(texts, want, strict=True) if own.encode(t) != ids]
    assert not [t for t, ids in zip(texts, want, strict=True) if lib.encode(t) != np.array(ids, "<u4").tobytes()]


def test_tokens_by_suffix_links_are_all_that_end_there():
    """The automaton's tokens at each position against a search for every suffix in the vocabulary."""
    own = bpe.tokenizer(SPEC)
    known = {}
    for s, t in enumerate(own._token):
        if t >= 0:
            known[own.tokens[t]] = t
    for word in ("internationalization", "theeere", "strengths", "zzxqj"):
        state = size = 0
        for end, c in enumerate([*word.encode(), own.END], 1):
            while (to := own._go.get(state << 9 | c)) is None and state:
                state, size = own._link[state], own._length[own._link[state]]
            state, size = (0, 0) if to is None else (to, size + 1)
            at, found = own._near[state if own._length[state] == size else own._link[state]], []
            while at:
                found.append(own._token[at])
                at = own._near[own._link[at]]
            spelled = word + "</w>" if end > len(word) else word[:end]
            want = [known[spelled[k:]] for k in range(min(end, len(word))) if spelled[k:] in known]
            assert found == want


def test_bpe_query(spark):
    got = bpe.encode_decode(frame(spark, ODD), PATH).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.ids, r.decoded) == library(ODD[r.doc_id])
    assert bpe.encode_decode(frame(spark, ODD).limit(0), PATH).count() == 0


def test_bpe_documents(spark, sf):
    for r in bpe.encode_decode(spark.read.parquet(f"{sf}/documents.parquet"), PATH, keep=("text",)).collect():
        assert (r.ids, r.decoded) == library(r.text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_number_coding_round_trip(numbers):
    x = np.array(numbers, np.uint32)
    control, data = tokenfile.encode_ranks(x)
    assert len(control) == -(-len(x) // 4)
    assert tokenfile.decode_ranks(control, data, len(x)).tolist() == numbers
    block = tokenfile.pack([None, 5], np.array([0, len(x)]), x, 17)
    ids, lengths, ranks, start = tokenfile.unpack(block)
    assert (ids, lengths.tolist(), ranks.tolist(), start) == ([None, 5], [0, len(x)], numbers, 17)


@pytest.mark.parametrize("odd", [True, False])
def test_token_files(spark, sf, tmp_path, odd):
    docs = frame(spark, ODD) if odd else spark.read.parquet(f"{sf}/documents.parquet")
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(docs, path, PATH)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.select("doc_id", "text").collect()))
    want, start = [], 0
    for has, i, _, text in rows:
        ids = [*library(text)[0], 1]
        want.append((i if has else None, start, ids))
        start += len(ids)
    got = sorted(((r.start, r.doc_id, r.tokens) for r in tokenfile.read_tokens(spark, path).collect()))
    assert [(i, s, t) for s, i, t in got] == want
    sums = {(r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read_checksums(spark, path).collect()}
    assert sums == {(s, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for _, s, t in want}


def test_token_files_of_nothing(spark, tmp_path):
    tokenfile.write_tokens(frame(spark, ODD).limit(0), f"file://{tmp_path}/none", PATH)
    assert tokenfile.read_checksums(spark, f"file://{tmp_path}/none").count() == 0


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict(docs, langid.train(docs)).collect()
    held = [r for r in got if langid.held_out(r.doc_id)]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.h for r in docs.select("doc_id", (langid.bucket("doc_id") == 1).alias("h")).collect()} == {i: langid.held_out(i) for i in truth}


def test_families_and_votes_against_plain_python(spark):
    """Five languages in two families and one of its own: the prediction and score follow from the hyperplanes by counting one-versus-one wins, family first."""
    words = {"en": "the and of to is that with for", "de": "der und die das ist nicht mit ein", "sv": "och att det som en på är av", "fr": "le la et les des est une dans", "it": "il che di la per non una sono", "xx": "zqa wxk qqz vkk zzx kqw xvz wwq"}
    rng = np.random.default_rng(0)
    rows = [(lang, " ".join(rng.choice(w.split(), 12))) for lang, w in words.items() for _ in range(25)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.langs == sorted(words) and model.families == ["=germanic", "=romance", "=xx"]
    planes = {p: (w, b) for p, w, b in zip(model.pairs, model.weights, model.bias, strict=True)}
    assert len(planes) == 3 + 3 + 1  # between families, within germanic, within romance

    def vote(names, x):
        if len(names) == 1:
            return names[0], 1.0
        m = {p: sum(float(a) * float(b) for a, b in zip(planes[p][0], x, strict=True)) + planes[p][1] for p in planes if set(p) <= set(names)}
        assert len(m) == len(names) * (len(names) - 1) // 2
        wins = {n: sum((v >= 0) == (p[0] == n) for p, v in m.items() if n in p) for n in names}
        total = {n: sum(v if p[0] == n else -v for p, v in m.items() if n in p) for n in names}
        best = max(names, key=lambda n: (wins[n], total[n]))
        chances = [1 / (1 + np.exp(-4 * (v if p[0] == best else -v))) for p, v in m.items() if best in p]
        return best, sum(chances) / len(chances)

    for lang, text in [*rows[::9], ("en", "the der und och"), ("it", "il la le that"), ("xx", "zqa the")]:
        x = langid.features(text)
        family, p = vote(model.families, x)
        own = [n for n in model.langs if f"={langid.FAMILY_OF.get(n, n)}" == family]
        best, q = vote(own, x)
        got, score = model.predict(text)
        assert got == best and abs(score - p * q) < 1e-4, (lang, text)
    assert np.mean([model.predict(t)[0] == lang for lang, t in rows]) > 0.98


def test_language_sample_is_bounded(spark):
    """A hot id, very many labels and repeated rows don't grow the sample over its bound."""
    rows = [(0, f"word{i} the cat", "en") for i in range(3000)] + [(0, "the same", "en")] * 3000 + [(i, f"bla {i} x", f"l{i % 300}") for i in range(1, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    original = langid.fit_vectors
    langid.fit_vectors = lambda texts, langs: seen.append((texts, langs)) or original(texts, langs)
    try:
        model = langid.train(df, max_per_lang=20, max_langs=7, max_texts=100)
    finally:
        langid.fit_vectors = original
    texts, langs = seen[0]
    assert len(texts) <= 100 and len(set(langs)) <= 7 and "en" in langs and len(model.langs) <= 7


def test_language_edge_cases(spark):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(12)] + [(20 + i, f"der hund und die katze {i}", "de") for i in range(12)]
    rows += [(40 + i, f"le chien et la maison {i}", "fr") for i in range(12)] + [(60, None, "en"), (61, "", "fr"), (62, "123 !?", None), (None, "the dog", "en"), (63, "\U00020000\U00020001", None), (64, "the cat", None), (64, "the cat", None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    model = langid.train(df)
    got = {}
    for r in langid.predict(df, model).collect():
        got.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 6)))
    for i in (60, 61, 62):
        assert got[i] == {("und", 0.0)}
    assert {p for p, _ in got[64]} == {"en"} and {p for p, _ in got[25]} == {"de"} and {p for p, _ in got[45]} == {"fr"}
    kept = langid.relabel(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    nothing = df.limit(0)
    assert langid.predict(nothing, langid.train(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.train(df.where("lang IS NULL"))).collect()} == {"und"}
    one = langid.train(df.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(df, one).collect()} == {"en", "und"}


def base_places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


LICENCES = [None, "", "CC-BY cc by cc cc by", "All rights reserved. all RIGHTS reserved!", "GNU General-Public License general public general public license", "é cc by\x85x cc  by", license_scan.TEMPLATES["mit"], "foo " + license_scan.TEMPLATES["apache-2.0"].replace("the license is", "x") + " bar", "cc " * 5000 + "by"]


def test_licences_against_brute_force(spark, sf):
    texts = LICENCES + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = frame(spark, texts)
    for r in license_scan.scan_licences(df).collect():
        if r.doc_id is None:
            continue
        n, places = base_places(texts[r.doc_id])
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    got = {r.doc_id: r for r in license_scan.scan_licences(frame(spark, LICENCES)).collect()}
    assert "mit" in got[6].labels.split(",") and got[6].spans[0].label == "mit" and got[6].spans[0].cover == 1.0
    assert "apache-2.0" in got[7].labels.split(",")
    assert license_scan.scan_licences(df.limit(0)).count() == 0


ONE_LINE = {
    "mit": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "MIT licensed"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "License: Apache-2.0"],
    "bsd": ["Distributed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "isc": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "gpl-notice": ["Licensed under the GNU General Public License.", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License v3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "lgpl-notice": ["Licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "cc0-1.0": ["Released under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by-notice": ["Available under the Creative Commons Attribution licence", "SPDX-License-Identifier: CC-BY-3.0"],
    "gpl-3.0-notice": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
}


def test_each_licence_by_its_notice_and_its_one_line_forms(spark):
    assert set(ONE_LINE) == set(license_scan.TEMPLATES) - {"copyright-notice"}
    rows = [(label, t) for label, forms in ONE_LINE.items() for t in [license_scan.TEMPLATES[label], *forms, f"Some text.\n{forms[0]} More of it."]]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in license_scan.scan_licences(df).collect():
        label, text = rows[r.doc_id]
        assert label in r.labels.split(",") and label in {s.label for s in r.spans} and r.score >= license_scan.MIN_COVER, text
    odd = ["Das ist eine Lizenz, license mit Text", "released under the old bridge", "licensed under the GNU GPL, version 3", "Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: r.labels for r in license_scan.scan_licences(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "", 2: "gpl-3.0-notice", 3: "cc-by"}


def test_phrases_of_one_word_and_their_neighbours(spark):
    texts = ["the gpl is here", "gpl gpl", "gpl", "a gpl b cc by c", "x" * 10 + " gpl."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licences(df, base={"gpl": "g", "cc by": "c"}).collect()}
    assert got == {0: (1, 1, 1, "g"), 1: (2, 0, 1, "g"), 2: (1, 0, 0, "g"), 3: (2, 1, 3, "c,g"), 4: (1, 1, 1, "g")}


def test_whole_licences(spark):
    """Each whole text in other line breaks and case, with a copyright line and a clause changed, is labelled and told from its relatives."""
    texts = [(label, "Copyright (c) 2020 A. Person\n" + re.sub(r"\s+", "\n", t.upper()).replace("DAMAGES", "LOSSES", 1)) for label, t in license_scan.WHOLE.items()]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    for r in license_scan.scan_licences(df).collect():
        labels = set(r.labels.split(","))
        assert texts[r.doc_id][0] in labels and len(labels & {"bsd-2-clause", "bsd-3-clause"}) == texts[r.doc_id][0].startswith("bsd")
        assert not labels & ({"mit", "isc", "zlib", "bsl-1.0", "unlicense", "apache-2.0"} - {texts[r.doc_id][0]})


def naive_runs(text, templates):
    """Maximal places of words that stand in one template, by trying every stretch."""
    words = [w for w in license_scan.words(text) if w]
    known = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    ends = [max([j for j in range(i, len(words) + 1) if j == i or tuple(words[i:j]) in known]) for i in range(len(words))]
    return [(i, e) for i, e in enumerate(ends) if e - i >= license_scan.MIN_RUN and (i == 0 or ends[i - 1] < e)]


def best_chain(places, last=None):
    """By trying every chain."""
    best = 0
    for end, start, at in places:
        if last is None:
            best = max(best, end - start + best_chain(places, (end, start, at)))
        elif (end, start, at) != last and end >= last[0] and at > last[2] and start - last[0] <= license_scan.MAX_GAP:
            best = max(best, min(end - max(start, last[0]), at - last[2]) + best_chain(places, (end, start, at)))
    return best


@pytest.mark.parametrize("at", range(5, 45, 5))
@pytest.mark.parametrize("stray", ["the software without restriction", "copies of the software", "permission is hereby granted free of charge"])
def test_stray_runs_break_no_licence(at, stray):
    """Words of its own, at another place than their own, in the middle of the notice; several copies are several spans."""
    w = license_scan.TEMPLATES["mit"].split()
    text = " ".join([*w[:at], stray, *w[at:]])
    scanner, short = license_scan._scanner(tuple(license_scan.BASE.items()), tuple(license_scan.TEMPLATES.items())), license_scan._scanner(tuple(license_scan.SHORT.items()), ())
    *_, labels, score, spans = scanner.report(text, short)
    assert "mit" in labels.split(",") and score >= 0.9
    *_, spans = scanner.report(" ".join([text, "and more " * 20, text, text]), short)
    assert [label for label, *_ in spans].count("mit") == 3


EXPRESSIONS = {
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND (BSD-3-Clause OR Zlib)": "bsd,gpl-notice,zlib",
    "SPDX-License-Identifier: LGPL-2.1-or-later OR MPL-2.0": "lgpl-notice,mpl-2.0",
    "SPDX-License-Identifier: Foo-1.0 OR BSL-1.0": "bsl-1.0",
    "SPDX-License-Identifier: ISC": "isc",
    "// SPDX-License-Identifier: AGPL-3.0-or-later\n// some MIT like text": "agpl-3.0",
    "Licensed under the Apache License 2.0 and MIT license.": "apache-2.0,mit",
    "Released under the MIT License or the Boost Software License, as you like": "bsl-1.0,mit",
    "Released under the MIT License and with love": "mit",
    "SPDX-License-Identifier:": "",
    "spdx license identifier with or and": "",
}


def test_spdx_expressions(spark):
    texts = list(EXPRESSIONS)
    got = {texts[r.doc_id]: r.labels for r in license_scan.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == EXPRESSIONS
    assert {label for label in license_scan.WHOLE if label not in ("bsd-2-clause", "bsd-3-clause", "gpl-3.0-notice")} <= set(license_scan._TAGGED.values())


def test_an_affero_notice_is_no_plain_one(spark):
    texts = [license_scan.TEMPLATES["agpl-3.0"], license_scan.TEMPLATES["gpl-notice"]]
    got = [set(r.labels.split(",")) for r in license_scan.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert "agpl-3.0" in got[0] and "gpl-notice" not in got[0] and "gpl-notice" in got[1] and "agpl-3.0" not in got[1]


def test_runs_against_every_stretch():
    templates = ["a b c d e f", "c d e a b", "x a b c y", "d d d d"]
    scanner = license_scan.Scanner({}, [(t, t) for t in templates])
    rng = np.random.default_rng(3)
    split = [[w.encode() for w in t.split()] for t in templates]
    for _ in range(300):
        text = " ".join(rng.choice(list("aabbccddefxyz?"), rng.integers(0, 25)))
        _, _, runs = scanner.scan(text)
        assert [(s, e) for s, e, _ in runs] == naive_runs(text, split), text
        spans = scanner.spans(runs)
        for t in {t for _, _, s in runs for t, _ in scanner.ends[s]}:
            assert round(max(c for u, _, _, c in spans if u == t) * len(split[t])) == best_chain([(e, s, at + 1) for s, e, state in runs for u, at in scanner.ends[state] if u == t])
        for t, start, end, cover in spans:
            assert 0 < cover <= 1 and end - start <= len(text.split())
            # Words covered are in order in the template, so no more than the longest common subsequence.
            a, b = split[t], [w for w in license_scan.words(text) if w][start:end]
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            assert round(cover * len(a)) <= best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=20))
def test_matching_statistics(templates, text):
    a = license_scan.Automaton()
    for t in templates:
        last = 0
        for c in t:
            last = a.extend(last, c)
    subs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    state = length = 0
    for k, c in enumerate(text):
        state, length = a.step(state, length, c)
        want = max([n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in subs])
        assert length == want


def test_fingerprints_algebra():
    f = multihash.Fingerprint
    a, b = ["one", "two", "two"], ["three"]
    assert f.of([*a, *b]) == f.of([*b, *reversed(a)]) == f.of(a).add(b)
    assert f.of([*a, *b]).remove(b) == f.of(a) and f.of(a) != f.of(["one", "two"])
    assert f.from_hex(f.of(a).hex()).hex() == f.of(a).hex()
    many = [f"line {i}" for i in range(2000)]
    assert f.of(many).likeness(f.of(many[::-1])) == 1.0
    assert 0.5 < f.of(many).likeness(f.of(many[:1800] + ["other"] * 10)) < 1.0
    assert f.of(many).likeness(f.of([f"else {i}" for i in range(2000)])) < 0.1
    assert f.of_text(None) == f.of_text("") == f() and f().likeness(f.of(a)) == 0.0


def multiset_likeness(a, b):
    a, b = Counter(a), Counter(b)
    return (a & b).total() / (a | b).total() if a or b else 1.0


def test_likeness_of_repetitive_and_long_texts():
    f = multihash.Fingerprint
    few, menu, long = [f"cell {i % 14}" for i in range(167)], ["menu"] * 5000, [f"line {i % 40_000}" for i in range(100_000)]
    cases = [(few, few[:150]), (few, few[:125] + [f"new {i}" for i in range(42)]), (menu, menu[:4000] + ["x"] * 1000), (long, long[:75_000] + ["y"] * 25_000), (["a"] * 9, ["a"] * 8), (["a"], ["b"]), (few, menu)]
    for a, b in cases:
        assert abs(f.of(a).likeness(f.of(b)) - multiset_likeness(a, b)) < 0.15, (len(a), len(b))
        assert f.of(a).likeness(f.of(b)) == f.of(b).likeness(f.of(a))
    assert f.of(few).add(menu).remove(few).hex() == f.of(menu).hex()


def test_near_edited_is_the_multiset_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = [r.text or "" for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id, r.text or ""))]
    got = [r.near_edited for r in sorted(multihash.fingerprints(docs).select("doc_id", "near_edited").collect(), key=lambda r: r.doc_id)]
    edited = [multihash.edited_text(t, texts[(k + 1) % len(texts)]) for k, t in enumerate(texts)]
    off = np.abs(np.array(got) - [multiset_likeness(multihash.units(a), multihash.units(b)) for a, b in zip(texts, edited, strict=True)])
    assert off.mean() < 0.04 and off.max() < 0.25


def test_fingerprints_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    check_fingerprints(docs, rows, multihash.with_following.__defaults__[0])
    near = multihash.fingerprints(docs).toPandas()
    assert near["near_edited"].mean() > near["near_next"].mean() + 0.3


def check_fingerprints(df, rows, per_range):
    got = multihash.fingerprints(df)
    want = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got.collect())) == sorted((i or -1, n, h) for i, n, h in want)


def test_fingerprints_edge_cases(spark, monkeypatch):
    rows = [(None, "n" * 9), (1, None), (2, ""), (3, "a. b! c?\nd" * 50), (3, "a. b! c?\nd" * 50), (4, "é" * 7), (5, "z" * 200_000), (6, "x y z" * 10)] + [(10 + i, f"text {i} " * 20) for i in range(40)]
    df = spark.createDataFrame([(*r, "q", 3) for r in rows], "doc_id long, text string, id string, rng int")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    check_fingerprints(df, order, None)
    original = multihash.with_following
    monkeypatch.setattr(multihash, "with_following", lambda d, i, t: original(d, i, t, rows_per_range=5))
    check_fingerprints(df, order, None)
    check_fingerprints(df.where("doc_id IS NOT NULL"), [r for r in order if r[0] is not None], None)
    check_fingerprints(df.where("doc_id = 4"), [r for r in order if r[0] == 4], None)
    assert multihash.fingerprints(df.limit(0)).count() == 0
    same = {r.fingerprint for r in multihash.fingerprints(df).collect() if r.doc_id == 3}
    assert len(same) == 1


PAGES = [(1, "u1", "p" * 100), (2, "u2", "p" * 100), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "é" * 50), (6, "u6", "é" * 50), (7, "u7", "s" * 99), (8, "u8", "s" * 99), (9, "u9", "x\r\n\r\ny" * 40), (None, "u0", "p" * 100), (1, "u1", "p" * 100), (10, "u", "w" * 300_000)]


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, first int")
    path = f"file://{tmp_path}/archives"
    index = warc.write_archives(df, path)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.read_records(index, path).collect()]
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min(j for j, _, h in PAGES if j is not None and h == html) if len(raw) >= 100 else i
        new = first == i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if new else "revisit", None if new else first, raw))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    some = warc.read_records(index.where("page_id IN (4, 9)"), path).collect()
    assert {r.page_id: r.url for r in some} == {4: "u%0D%0A4", 9: "u9"}
    for f in tmp_path.glob("archives/*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    nothing = warc.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_records(nothing, f"file://{tmp_path}/none").count() == 0


def test_revisits_are_read_from_their_responses(spark, tmp_path):
    page = hashlib.sha512(b"page").hexdigest() * 3
    df = spark.createDataFrame([(i, f"u{i}", page if i % 3 else f"{i}" * 200) for i in range(1, 60)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/archives"
    index = warc.write_archives(df, path)
    some = warc.read_records(index.where("page_id IN (4, 5, 6)"), path).collect()
    assert {(r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in some} == {(4, "revisit", 1, page.encode()), (5, "revisit", 1, page.encode()), (6, "response", None, b"6" * 200)}
    at = index.where("page_id = 1").first()
    with open(tmp_path / "archives" / at.file, "r+b") as f:
        f.seek(at.offset)
        good = f.read(at.length)
        f.seek(at.offset)
        other = warc.record(1, "u1", b"q" * 400, hashlib.sha256(b"q" * 400).hexdigest(), None)
        assert len(other) <= len(good)
        f.write(other + good[len(other) :])
    assert warc.read_records(index.where("page_id = 6"), path).count() == 1
    with pytest.raises(Exception, match="no response with its digest for the revisit of page 4"):
        warc.read_records(index.where("page_id = 4"), path).collect()
    with open(tmp_path / "archives" / at.file, "r+b") as f:
        f.seek(at.offset)
        bad = warc.record(1, "u1", b"q" * 400, at.digest, None)
        f.write(bad + good[len(bad) :])
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_records(index.where("page_id = 4"), path).collect()


def test_reading_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPAN", 1 << 12)
    df = spark.createDataFrame([(i, "u", "".join(chr(97 + i * k % 25) for k in range(300))) for i in range(500)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(df, f"file://{tmp_path}/archives")
    read = warc.read_records(index, f"file://{tmp_path}/archives", payloads=False)
    assert index.select("file").distinct().count() == 1 and read.count() == 500
    wanted = index.select("file", "offset", "length").withColumns({"own": F.lit(True), "target": F.lit(False)})
    assert warc._fetched(wanted, f"file://{tmp_path}/archives", False).groupBy(F.spark_partition_id()).count().count() >= 8


def test_ranges_coalesce():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP, 5), ("a", 26 + 3 * warc.GAP, 5), ("b", 0, warc.RUN), ("b", warc.RUN, 1)]
    assert list(warc.runs(rows)) == [[0, 1, 2], [3], [4], [5]]


LINES = [(i, "menu\nbody %d\n\nmenu\nend" % i, "h1") for i in range(20)] + [(100, "menu\nx", "h2"), (101, None, None), (102, "", "h1"), (103, "menu", None), (104, "menu", "h1"), (104, "menu", "h1")]


def test_line_dedup(spark):
    df = spark.createDataFrame([(*r, 1, "b") for r in LINES], "doc_id long, text string, source string, n int, lines string")
    got = linefreq.drop_boilerplate(df, ratio=0.5, counts=("before", "dropped"))
    assert got.columns == [*df.columns, "before", "dropped"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.text, r.before, r.dropped))
    assert by[3] == [("body 3\n", 5, 3)] and by[100] == [("menu\nx", 2, 0)] and by[101] == [(None, 0, 0)]
    assert by[102] == [("", 1, 0)] and by[103] == [("menu", 1, 0)] and by[104] == [("", 1, 1)] * 2
    assert linefreq.drop_boilerplate(df.limit(0)).count() == 0


def test_blank_lines_stay(spark):
    """Lines of white space alone, as in texts with CRLF, and columns named as the operator's own."""
    rows = [(i, f"a{i}\r\n\r\nmenu\r\n\t\r\nc", "h", 1, 2, 3) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host int, bad int, kept int")
    got = linefreq.drop_boilerplate(df, ratio=0.5)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.host, r.bad, r.kept) for r in got.collect()) == [(i, f"a{i}\r\n\r\n\t\r", 1, 2, 3) for i in range(9)]


def test_long_lists_and_long_pages(spark):
    """A host with hundreds of boilerplate lines, and a page of 100,000 lines."""
    menu = [f"menu {k}" for k in range(300)]
    pages = [(i, "\n".join([*menu, f"own {i}", *menu[:5]])) for i in range(10)] + [(10, "\n".join(f"line {k}" for k in range(100_000)) + "\nmenu 7")]
    df = spark.createDataFrame([(*r, "h") for r in pages], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linefreq.drop_boilerplate(df, ratio=0.5).collect()}
    assert {i: got[i] for i in range(10)} == {i: f"own {i}" for i in range(10)} and got[10] == pages[10][1].removesuffix("\nmenu 7")


def test_mixing(spark):
    rows = [(i, "a b c d e", lang, f"src{s}") for i, (lang, s) in enumerate([("en", 0)] * 100 + [("de", 1)] * 10 + [("fr", 7)] * 30 + [("es", 12)] * 4)]
    rows += [(500, None, "en", "src0"), (501, "", None, None), (None, "x y", "en", None), (3, "a b c d e", "en", "src0")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, lang string, source string, full int, target string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total = sum(r.n_tokens for r in got)
    taken = sum(r.n_tokens * r.copies for r in got)
    assert 0.6 * total - 5 * 8 <= taken <= 0.6 * total + 5 * 8 and max(r.copies for r in got) <= 3
    assert {r.copies for r in got if r.source == "src12"} == {3}  # short of its target: all epochs, the rest goes to siblings
    out = mixing.taken(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df).collect() == got
    assert mixing.mix(df.limit(0)).count() == 0


def filled(budget, children):
    """name -> (cap, weight); exact water filling, each share rounded down."""
    open_, got, left = {k: v for k, v in children.items() if v[1] > 0}, {}, Fraction(budget)
    while open_:
        level = left / sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap <= w * level]
        if not full:
            return got | {k: int(w * level) for k, (_, w) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[0]
            left -= got[k]
    return got


@pytest.mark.parametrize("zero", ["none", "lang", "all"])
def test_budgets_with_weight_nought(spark, zero):
    """Random trees against exact fractions: what a child of weight 0 could hold is no room of its parent's."""
    rng = np.random.default_rng(len(zero))
    weights = {"domain": {"d0": 0 if zero in ("domain", "all") else 7, "d1": 3}, "lang": {"l0": 0 if zero in ("lang", "all") else 4}, "source": {f"s{k}": 0 if zero in ("source", "all") and k % 3 == 0 else int(rng.integers(1, 30)) for k in range(40)}}
    tree = {(f"d{i}", f"l{j}", f"s{k}"): int(rng.integers(0, 10 ** rng.integers(1, 6))) for i in range(4) for j in range(3) for k in range(int(rng.integers(1, 60)))}
    df = spark.createDataFrame([(*k, n) for k, n in tree.items()], "__domain string, __lang string, __leaf string, n long")
    for share in (0.3, 2.0):
        got = {tuple(r[:3]): r.target for r in mixing.budgets(df, weights, share, 3).collect()}
        w = lambda level, name: weights[level].get(name, 10)
        some = {k: 3 * n for k, n in tree.items() if w("domain", k[0]) and w("lang", k[1]) and w("source", k[2])}
        caps = lambda depth, under: {x: (sum(c for k, c in some.items() if k[: depth + 1] == (*under, x)), w(("domain", "lang", "source")[depth], x)) for x in {k[depth] for k in some if k[:depth] == under}}
        want = {(d, la, s): b3 for d, b1 in filled(int(sum(tree.values()) * share), caps(0, ())).items() for la, b2 in filled(b1, caps(1, (d,))).items() for s, b3 in filled(b2, caps(2, (d, la))).items()}
        assert got == want


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [(f"d{d}", lang, "s", n) for d, lang, n in ((0, "en", 200), (0, "xx", 10_000), (1, "en", 1000))]
    df = spark.createDataFrame(rows, "__domain string, __lang string, __leaf string, n long")
    got = {tuple(r[:2]): r.target for r in mixing.budgets(df, {"domain": {"d0": 50, "d1": 50}, "lang": {"xx": 0}}, 1200 / 11_200, 1).collect()}
    assert got == {("d0", "en"): 200, ("d1", "en"): 1000}


def test_mix_with_very_long_text_and_weight_nought(spark):
    rows = [(1, "a b " * 200_000, "en", "src0"), (2, "c d", "de", "src0"), (3, "e f g", "en", "src9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_tokens, r.copies) for r in mixing.mix(df, weights={"domain": {}, "lang": {"de": 0}, "source": {}}, share=3.0).collect()}
    assert got == {1: (400_000, 3), 2: (2, 0), 3: (3, 3)}


@pytest.mark.parametrize("n", [100, 1000, 20_000, 100_000, 1_000_000])
def test_likeness_at_any_length(n):
    """Disjoint, half equal and equal texts of that many different units; and a text twice against once."""
    f = multihash.Fingerprint
    a, b, c = (f.of([f"{x}{i}" for i in range(n)]) for x in "abc")
    half = f.of([f"a{i}" for i in range(n // 2)] + [f"c{i}" for i in range(n - n // 2)])
    assert a.likeness(b) < 0.15 and a.likeness(c) < 0.15 and abs(a.likeness(half) - 1 / 3) < 0.15
    assert a.likeness((b + a) - b) == 1.0 and abs(a.likeness(a + a) - 0.5) < 0.15
    assert abs((a + b).likeness(a + b + c) - 2 / 3) < 0.15


def test_near_next_is_the_multiset_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    texts = [r.text or "" for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id, r.text or ""))]
    got = [r.near_next for r in sorted(multihash.fingerprints(docs).select("doc_id", "near_next").collect(), key=lambda r: r.doc_id)]
    off = np.abs(np.array(got) - [multiset_likeness(multihash.units(a), multihash.units(texts[(k + 1) % len(texts)])) for k, a in enumerate(texts)])
    assert off.mean() < 0.05 and off.max() < 0.25


def test_caches_hold_no_long_keys(spark):
    own, lib = bpe.tokenizer(SPEC), tokenfile.library(SPEC)
    for k in range(7):
        text = f"{k}" + "ab" * 500_000
        assert len(own.encode_bytes(text)[0]) // 4 == len(lib.encode(text)) // 4
    for held in ({**own.chunk, **own.chunk.older}, {**own.piece, **own.piece.older}, lib.known, lib.older, lib.pieces):
        assert max(map(len, held), default=0) <= 64
    small = tokenfile.LibraryTokenizer(SPEC, 5)
    texts = ["the cat sat on the mat, and more words came by", "the cat again <|endoftext|> and the mat", "x" * 70 + " the cat", "", "one two three four five six seven eight"] * 3
    assert [small.encode(t) for t in texts] == [np.array(library(t)[0], "<u4").tobytes() for t in texts]


def test_token_ids_of_slices():
    """Stretches of a batch, with and without text beyond ASCII, odd blanks and endings."""
    import pyarrow as pa

    lib = tokenfile.LibraryTokenizer(SPEC)
    texts = ["The Cat SAT", None, "\u00c9t\u00e9\u00a0fin\u3000x", "", "H\u0331 I\u0307 it's don't### 'S", "a\u0085b\x1cc <|endoftext|> d", " End&&& (x) 12,5%% "] * 5
    for size in (1, 4, 35):
        for k in range(0, len(texts), size):
            ids, sizes = lib.encode_all(pa.array(texts).slice(k, size), 1)
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*library(t or "")[0], 1] for t in texts[k : k + size]]


def test_whole_pieces_are_what_the_automaton_finds():
    own = bpe.tokenizer(SPEC)
    some = sorted(own.whole)[::23]
    direct = [own.piece.make(p) for p in some]
    whole, own.whole = own.whole, {}
    try:
        assert direct == [own.piece.make(p) for p in some]
    finally:
        own.whole = whole


def test_training_takes_features_of_whole_texts_from_the_executors(spark, sf, monkeypatch):
    """The same model as from the texts on the driver; a very long text, and one without any letter."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10_001, "word and " * 100_000, "en"), (10_002, "12 34 !", "en"), (10_003, "x" * 10, "qq")], docs.schema)
    docs = docs.unionByName(more)
    seen = {}
    monkeypatch.setattr(langid, "fit_vectors", lambda v, langs, f=langid.fit_vectors: seen.update(n=len(v), langs=langs, v=v) or f(v, langs))
    model = langid.train(docs)
    rows = docs.where((langid.bucket("doc_id") != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang").distinct().collect()
    assert seen["n"] == len(rows) and Counter(seen["langs"]) == Counter(r.lang for r in rows)
    key = lambda v: b"" if v is None else v.tobytes()
    assert sorted(map(key, seen["v"])) == sorted(key(langid.features(r.text)) for r in rows)
    assert model.langs == sorted({r.lang for r in rows if langid.features(r.text) is not None})


def test_both_encoders_take_slices_and_words_spelled_like_added_tokens():
    """Ids and decoded texts of stretches of a batch; upper case turns into an added token's spelling, but isn't one."""
    import pyarrow as pa

    own, lib = bpe.WordBPE(SPEC), tokenfile.LibraryTokenizer(SPEC)
    texts = ["The Cat SAT", None, "Été fin　x", "", "<|ENDOFTEXT|> a", "a\u0085b\x1cc <|endoftext|><|ENDOFTEXT|> d", " End&&& (x) 12,5%% ", "<|endoftext|>"] * 4
    for size in (1, 5, 32):
        for k in range(0, len(texts), size):
            part, want = pa.array(texts).slice(k, size), [library(t or "") for t in texts[k : k + size]]
            ids, n, decoded = own.encode_all(part)
            assert [(x.tolist(), d) for x, d in zip(np.split(ids, np.cumsum(n)[:-1]), decoded.to_pylist(), strict=True)] == want
            ids, n = lib.encode_all(part)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [w[0] for w in want]


def test_a_batch_encodes_each_distinct_chunk_once():
    import pyarrow as pa

    own, seen = bpe.WordBPE(SPEC), []
    own.chunk.make = lambda c, make=own.chunk.make: seen.append(c) or make(c)
    long = "y" * 80  # not held
    own.encode_all(pa.array([f"{long} the cat {long}", f"the {long}"] * 50))
    assert sorted(seen) == ["cat", "the", long]
