"""Licence scans with a generalised suffix automaton over licence words.

All templates, passages and whole texts of licences, go into one suffix automaton whose letters are words. A file is
streamed through it once: after each word the automaton knows the longest run
of words, ending here, that stands in some template (the matching statistic).
Runs of at least MIN_RUN words that stand in one template are chained where they rise in the file and in the template,
at most MAX_GAP words apart in the file, by dynamic programming over all of a template's runs, so a stray run of its own words breaks no chain. A template is labelled
where its best chain covers enough of its words.
Base phrases are templates too; they are reported wherever all of their words stand consecutively.
So are the short forms of each licence, one-line declarations and SPDX tags: each place is a span that is covered as a whole. What follows one by `and`, `or` or `with`,
as in SPDX expressions, is read on: further names and tags are spans of their own, exceptions are passed over.

Null and empty texts have no words and no labels. Words that stand in no template
break every run, so only runs of known words are walked, and of these none that is shorter than any phrase. Rows that repeat are scanned each.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from sessionloom.llm.automaton import Automaton
from sessionloom.llm.common import per_text, worker_cache
from sessionloom.llm.licence_texts import WHOLE

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Well-known passages of public licences, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
    "agpl-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "cc0-1.0": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "cc-by-notice": "this work is licensed under a creative commons attribution",
    "gpl-3.0-notice": "released under the gnu general public license version 3",
    "cc-by-4.0": "this text is available under cc by 4 0",
    "copyright-notice": "copyright c all rights reserved",
}
#: Names by which a one-line declaration calls a licence, and the starts of its SPDX identifiers, by the label of its notice.
NAMES = {
    "mit": (("mit license", "mit licence", "expat license"), ("mit",)),
    "apache-2.0": (("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache software license version 2 0"), ("apache 2 0",)),
    "bsd": (
        ("bsd license", "bsd licence", "bsd 2 clause license", "bsd 3 clause license", "2 clause bsd license", "3 clause bsd license", "new bsd license", "modified bsd license", "simplified bsd license", "revised bsd license"),
        ("bsd 2 clause", "bsd 3 clause"),
    ),
    "isc": (("isc license", "isc licence"), ("isc",)),
    "gpl-notice": (("gnu general public license", "gnu gpl", "gpl", "gplv2"), ("gpl 2 0",)),
    "agpl-3.0": (("gnu affero general public license", "affero general public license", "gnu agpl", "agpl", "agplv3"), ("agpl 1 0", "agpl 3 0")),
    "lgpl-notice": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl", "lgplv2 1", "lgplv3"), ("lgpl 2 0", "lgpl 2 1", "lgpl 3 0")),
    "mpl-2.0": (("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"), ("mpl 2 0",)),
    "unlicense": (("unlicense",), ("unlicense",)),
    "cc0-1.0": (("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal"), ("cc0 1 0",)),
    "cc-by-notice": (("creative commons attribution",), ("cc by 1 0", "cc by 2 0", "cc by 2 5", "cc by 3 0")),
    "gpl-3.0-notice": (("gnu general public license version 3", "gnu general public license v3", "gnu general public license 3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gpl 3 0", "gplv3"), ("gpl 3 0",)),
    "cc-by-4.0": (("cc by 4 0", "creative commons attribution 4 0"), ("cc by 4 0",)),
    "zlib": (("zlib license", "zlib licence", "zlib libpng license"), ("zlib",)),
    "bsl-1.0": (("boost software license", "boost software license version 1 0", "boost software license 1 0", "boost license"), ("bsl 1 0",)),
}
_LEADS = ("under", "under the", "under a", "under an", "under the terms of", "under the terms of the")
#: Short forms and their labels. "license mit" is left to the SPDX tag: "mit" is a German word.
SHORT = {f"{lead} {name}": label for label, (names, _) in NAMES.items() for name in names for lead in _LEADS}
SHORT |= {f"spdx license identifier {tag}": label for label, (_, tags) in NAMES.items() for tag in tags}
SHORT |= {f"{lead} {tag}": label for label, (_, tags) in NAMES.items() for tag in tags if tag not in ("mit", "zlib") for lead in ("license", "licence")}
SHORT |= {f"license {name}": label for label, (names, _) in NAMES.items() for name in names if len(name.split()) > 1}
SHORT |= {"mit licensed": "mit", "bsd licensed": "bsd", "isc licensed": "isc", "apache 2 0 licensed": "apache-2.0", "the unlicense": "unlicense"}
#: Names and tags as tuples of words, the longest first, that may go on after `and`, `or` and `with`; the bare tag only in SPDX expressions.
_NAMED = {tuple(n.encode().split()): label for label, (names, _) in NAMES.items() for n in names}
_TAGGED = {tuple(t.encode().split()): label for label, (_, tags) in NAMES.items() for t in tags}
_LONGEST = max(map(len, [*_NAMED, *_TAGGED]))
MIN_RUN = 3
MIN_COVER = 0.75
MAX_GAP = 12
#: ASCII letters lower, digits and everything from 0x80 on stay, the rest separates.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


def chains(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(words covered, first word, end word) of the best chain that ends with each of places(end, start, end in the template), which are sorted.

    A run goes on from one that ends no later in the file, earlier in the template, and at most MAX_GAP words before it; it covers what is new in both.
    """
    best: list[tuple[int, int]] = []
    for k, (end, start, at) in enumerate(places):
        top = end - start, start
        for j in range(k - 1, -1, -1):
            e, _, to = places[j]
            if e < start - MAX_GAP:
                break
            if to < at:
                top = max(top, (best[j][0] + min(end - max(start, e), at - to), best[j][1]))
        best.append(top)
    return [(covered, first, end) for (covered, first), (end, _, _) in zip(best, places, strict=True)]


def continued(got: list[bytes], lines: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further (first word, end word, label): names that go on after a short form by `and`, `or` or `with`, and all licences of an SPDX expression.

    An expression begins after `spdx license identifier` even if its first licence is not known; of a known one `only` and `or later` are passed over.
    """
    def at(k: int, spdx: bool) -> tuple[int, str] | None:
        for n in range(min(_LONGEST, len(got) - k), 0, -1):
            label = _NAMED.get(key := tuple(got[k : k + n])) or (_TAGGED.get(key) if spdx else None)
            if label:
                return k + n, label
        return None

    def after(k: int) -> int:
        """Behind `only`, `or later` and `plus`."""
        while k < len(got) and (got[k] in (b"only", b"plus") or got[k : k + 2] == [b"or", b"later"]):
            k += 1 + (got[k] == b"or")
        return k

    out, spdx = [], [k + 3 for k, w in enumerate(got[:-3]) if w == b"spdx" and got[k + 1 : k + 3] == [b"license", b"identifier"]]
    reach = 0
    for begin, tags in sorted([(k, True) for k in spdx] + [(e, False) for _, e, _ in lines if not any(s <= e <= s + _LONGEST for s in spdx)]):
        if begin < reach:
            continue
        k = begin
        if tags:
            found = at(k, True)
            if found:
                out.append((k, *found))
                k = found[0]
            else:  # not known: up to the next connective, which must come soon
                k = next((j for j in range(k + 1, min(k + _LONGEST, len(got))) if got[j] in (b"and", b"or", b"with")), len(got))
        k = after(k)
        while k + 1 < len(got) and got[k] in (b"and", b"or", b"with"):
            if got[k] == b"with":  # an exception: up to its name's end and version
                e = next((j for j in range(k + 1, min(k + 8, len(got))) if got[j] == b"exception"), None)
                if e is None:
                    break
                k = e + 1
                while k < len(got) and got[k].isdigit():
                    k += 1
                continue
            n = k + 1 + (not tags and got[k + 1] == b"the")
            found = at(n, tags) if n < len(got) else None
            if not found:
                break
            out.append((n, *found))
            k = after(found[0])
        reach = k
    return out


class Scanner:
    """The automaton with, for each state, the templates that hold its string and where it ends in them."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]]):
        """base: phrase -> label; templates: (label, text), a label as often as it has texts. Texts are read as files are."""
        texts = [[w for w in words(t) if w] for t in [*base, *[t for _, t in templates]]]
        self.labels = [*base.values(), *[label for label, _ in templates]]
        self.sizes = [len(t) for t in texts]
        self.n_base = len(base)
        self.shortest = min([MIN_RUN, *self.sizes])  # shorter runs of known words hold nothing
        vocabulary: dict[bytes, int] = {}
        self.automaton = a = Automaton()
        seqs = []
        for t in texts:
            seqs.append([vocabulary.setdefault(w, len(vocabulary) + 1) for w in t])
            a.add(seqs[-1])
        self.vocabulary = vocabulary
        ends: list[set] = [set() for _ in a.go]
        for t, ids in enumerate(seqs):
            state = 0
            for at, c in enumerate(ids):
                state = a.go[state][c]
                ends[state].add((t, at))
        for s in sorted(range(1, len(a.go)), key=lambda s: -a.length[s]):
            ends[a.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]
        # Base phrases that are suffixes of a state's longest string, with their lengths.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in a.go]
        home = {}
        for t in range(self.n_base):
            state = 0
            for c in seqs[t]:
                state = a.go[state][c]
            home.setdefault(state, []).append((t, self.sizes[t]))
        for s in range(1, len(a.go)):
            p = s
            while p > 0:
                self.phrases[s] += home.get(p, [])
                p = a.link[p]

    def scan(self, text: str | None):
        """(n_words, base places as [(start, phrase)], runs as [(start, end, state)]); a run is a maximal match of MIN_RUN words or more."""
        got = [w for w in words(text) if w]
        ids = np.fromiter(map(self.vocabulary.get, got, repeat(0)), np.int32, len(got))
        known = np.flatnonzero(ids)
        places, runs = [], []
        if len(known):
            cuts = np.flatnonzero(np.diff(known) > 1) + 1
            starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(known)]])
            long = stops - starts >= self.shortest
            for lo, hi in zip(known[starts[long]].tolist(), known[stops[long] - 1].tolist(), strict=True):
                self._walk(ids[lo : hi + 1].tolist(), lo, places, runs)
        return len(got), places, runs

    def _walk(self, ids: list[int], offset: int, places: list, runs: list) -> None:
        a, state, length = self.automaton, 0, 0
        for k, c in enumerate(ids):
            was, had = state, length
            state, length = a.step(state, length, c)
            if length <= had and had >= MIN_RUN:
                runs.append((offset + k - had, offset + k, was))
            for t, n in self.phrases[state]:
                if n <= length:
                    places.append((offset + k + 1 - n, t))
        if length >= MIN_RUN:
            runs.append((offset + len(ids) - length, offset + len(ids), state))

    def spans(self, runs: list) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, share covered): each template's best chain of runs, and its further ones that cover MIN_COVER and lie apart from those."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in runs:
            for t, at in self.ends[state]:
                if t >= self.n_base:
                    by.setdefault(t, []).append((end, start, at + 1))
        out = []
        for t, places in by.items():
            places.sort()
            taken: list[tuple[int, int]] = []
            for covered, first, end in sorted(chains(places), key=lambda c: (-c[0], -c[1], c[2])):
                if taken and covered < MIN_COVER * self.sizes[t]:
                    break
                k = bisect_left(taken, (end, 0))
                if k and taken[k - 1][1] > first:
                    continue
                taken.insert(k, (first, end))
                out.append((t, first, end, covered / self.sizes[t]))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def longest(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, end word, label) of the base places that no longer one holds."""
        out, reach = [], 0
        for start, end, t in sorted(((s, s + self.sizes[t], t) for s, t in self.scan(text)[1]), key=lambda x: (x[0], -x[1])):
            if end > reach:
                out.append((start, end, self.labels[t]))
                reach = end
        return out

    def report(self, text: str | None, short: Scanner) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans): score is 1 with a base place or a short form, else the best cover."""
        n, places, runs = self.scan(text)
        spans = self.spans(runs) if runs else []
        lines = short.longest(text)
        if lines or (text and "spdx" in text.lower()):
            lines = sorted({*lines, *continued([w for w in words(text) if w], lines)})
        starts = [s for s, _ in places]
        base = {self.labels[t] for _, t in places}
        enough = [x for x in spans if x[3] >= MIN_COVER]
        # Licences share passages: what lies in a place that another one covers better, or as well with more words, is not its own.
        good = lambda x: (round(x[3], 9), x[3] * self.sizes[x[0]])
        enough = [x for x in enough if not any(y[1] <= x[1] and y[2] >= x[2] and y[0] != x[0] and good(y) > good(x) for y in enough)]
        found = [(self.labels[t], s, e, c) for t, s, e, c in enough]
        found = sorted(found + [(label, s, e, 1.0) for s, e, label in lines], key=lambda x: x[1])
        score = 1.0 if places or lines else min(1.0, max((c for *_, c in spans), default=0.0))
        return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in found})), score, found


@worker_cache
def _scanner(base: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(base), list(templates))


def scan_licences(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE,
    templates: dict[str, str] = TEMPLATES,
    short: dict[str, str] = SHORT,
    whole: dict[str, str] = WHOLE,
) -> DataFrame:
    """One row for each row of documents: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    base and short map phrases to labels, templates and whole labels to passages and to whole texts of licences.
    """
    key, lines = (tuple(base.items()), (*templates.items(), *whole.items())), (tuple(short.items()), ())

    def run(texts):
        scanner, forms = _scanner(*key), _scanner(*lines)
        return [scanner.report(t, forms) for t in texts]

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long, cover: double>>"
    return per_text(documents, id_col, text_col, run, fields, (_scanner,)).withColumnRenamed("id", id_col)
