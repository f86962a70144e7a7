"""Operators over the whole corpus: fill-in-middle, source divergence, language model; against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionloom.llm import divergence, fim, ngram_lm

SCHEMA = "doc_id long, text string, lang string, source string, n int, h long"


def frame(spark, rows):
    """rows of (doc_id, text, lang, source), with columns named as the operators' own."""
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def fill_in_middle(doc_id, text):
    text = text or ""
    u = re.findall("[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(u), "plain", None, None, text
    if h4 % 100 < 50:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \né日🎉\r"), max_size=80), st.integers(0, 3000))
def test_line_ends_and_their_lists(text, more):
    text += "x" * more
    at = np.cumsum([len(u) for u in re.findall("[^\n]*\n|[^\n]+", text)]).astype(int).tolist()
    assert fim.ends(text).tolist() == at
    made = fim.elias_fano(np.array(at, np.int64))
    assert fim.size(made) == len(at) and [fim.select(made, k) for k in range(len(at) + 1)] == [0, *at]
    if at:
        assert len(made) <= 9 + 2 + len(at) * (3 + np.log2(at[-1] / len(at))) / 8 + 1


TEXTS = [None, "", "\n", "one line", "a\nb\nc", "a\nb\nc", "a\nb\nc\n", "é\n日本\n🎉🎉\nend", "x <P> y\nz", "<S>\n<S", "a<\nb<S\nc<M", "crlf\r\nis\r\ntwo\r\n", "l\n" * 60_000, "w" * 300_000]


def test_fill_in_middle(spark):
    rows = [(10 * i + k, t, "en", "s") for i, t in enumerate(TEXTS) for k in range(4)] + [(None, "n\nm\n", None, None), (3, "a\nb", "en", "s"), (3, "a\nb", "en", "s"), (3, "other\ntext\n", "en", "s")]
    got = fim.fill_in_middle(frame(spark, rows), keep_cols=("h", "source"))
    assert got.columns == ["doc_id", "h", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *fill_in_middle(i, t), t or "", 2) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back, r.h) for r in out), key=repr) == want
    assert {r.form for r in out} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(frame(spark, rows).limit(0)).count() == 0


def test_a_list_of_another_text_is_never_used(spark):
    """As if all these texts shared one hash: their lists come from one of them, and the content tells."""
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(["ab\ncd\nef", "a\nbcd\nef", "abcd\nef\n", "abcdefgh", "\n\n\n\n\n\n\n\n"])])
    index = fim.text_index(docs)
    assert index.count() == 5
    wrong = index.crossJoin(index.where("n = 8").select(F.col("n").alias("m"), F.col("ends").alias("e"))).select("h", "n_chars", F.col("m").alias("n"), F.col("e").alias("ends"))
    for made in (wrong, index):
        got = fim.transform(docs, made).collect()
        assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted((r.doc_id, *fill_in_middle(r.doc_id, r.text)) for r in docs.collect())


def test_one_list_for_all_copies(spark):
    rows = [(i, "same\ntext\n" * 3, "en", "s") for i in range(500)] + [(1000 + i, f"own\n{i}", "en", "s") for i in range(50)]
    docs = frame(spark, rows).repartition(8)
    assert fim.text_index(docs).count() == 51
    plan = fim.transform(docs, fim.text_index(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def divergences(rows, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in own for w in set(d[2]))
        kept = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: w.encode())
        tf = {s: Counter(w for d in own if d[1] == s for w in d[2] if seen[w] >= 3) for s in {d[1] for d in own}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (c.total() + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in tf.items()}, share(sum(tf.values(), Counter()))
        for s in tf:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in tf if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if tf[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k) for k, (w, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{chr(97 + w % 26)}{'x' * (w // 26)}" for w in (rng.zipf(1.4, 40) % 90)), ("en", "de", None)[i % 3], f"src{i * i % 11}" if i % 4 else "hot") for i in range(400)]
    rows += [(900, None, "en", "silent"), (901, "", "en", "silent"), (902, "a A é É Ünï 日本 a1b", "en", None), (902, "a A é É Ünï 日本 a1b", "en", None), (None, "É é x", "en", "src1")]
    rows += [(903, "rare words here", "xx", "a"), (904, None, "xx", "b"), (905, "rare", "xx", "c"), (906, "alone alone", "yy", "a"), (907, "alone " * 70_000 + "b", "yy", "a"), (908, "alone b", "yy", "a"), (909, "b", "yy", "a")]
    return rows


@pytest.mark.parametrize(("slice_bytes", "block", "chunk"), [(1 << 26, 4, 1 << 21), (300, 1, 50), (2000, 3, 500), (2000, 100, 1)])
def test_divergences(spark, monkeypatch, slice_bytes, block, chunk):
    monkeypatch.setattr(divergence, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = corpus()
    docs = frame(spark, rows).repartition(5)
    assert sorted(map(tuple, divergence.divergences(docs, top=7).collect())) == divergences(rows, 7)


def test_divergences_of_nothing(spark):
    assert divergence.divergences(frame(spark, corpus()).limit(0)).count() == 0


@pytest.mark.parametrize("blocks", range(1, 12))
def test_each_two_blocks_meet_once(spark, blocks):
    met = divergence.tournament(blocks)
    assert sorted(tuple(sorted(m[1:])) for m in met) == [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    assert all(len({x for m in met if m[0] == r for x in m[1:]}) == 2 * sum(m[0] == r for m in met) for r in range(blocks + 1))
    hosts = Counter(m[1] for m in met)
    assert not met or max(hosts.values()) - min(hosts[b] for b in range(blocks)) <= 2
    last = blocks - 1 + blocks % 2
    sql = spark.range(blocks).selectExpr("CAST(id AS INT) AS block", f"{last} AS last", f"explode(sequence(0, {max(last - 1, 0)})) AS turn").withColumn("host", F.expr(divergence._OPPONENT)).where(f"host < {blocks} AND {divergence._TRAVELS}")
    if blocks > 1:
        assert sorted((r.turn, r.host, r.block) for r in sql.collect()) == sorted(met)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**15), st.integers(0, 10**15), st.integers(1, 10**9))
def test_shares_are_exact(count, more, v):
    n = count + more
    assert int(divergence.shares(count, n, v)) == 1 + 10**9 * (count + 1) // (n + v)


class Plain:
    """The model by dictionaries of tuples."""

    def __init__(self, texts, order):
        self.order, self.a = order, {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            t = [None] * (order - 1) + ngram_lm.tokens(t)
            self.a[order].update(tuple(t[i : i + order]) for i in range(len(t) - order + 1))
        self.counts = Counter(w for t in texts for w in ngram_lm.tokens(t))
        for k in range(order - 1, 0, -1):
            self.a[k] = Counter(g[1:] for g in self.a[k + 1])
        self.cut, self.context = {}, {}
        for k, a in self.a.items():
            tally = Counter(a.values())
            self.cut[k] = (0, *ngram_lm.discounts([tally[x] for x in (1, 2, 3, 4)]))
            for g, n in a.items():
                c = self.context.setdefault(g[:-1] if k > 1 else (), [0, 0])
                c[0] += n
                c[1] += self.cut[k][min(n, 3)]

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.counts) + 1)
        if gram[:-1] not in self.context:
            return lower
        n, (s, rest) = self.a[k][gram], self.context[gram[:-1]]
        return (max(n - self.cut[k][min(n, 3)], 0) + rest * lower) / s

    def scores(self, text):
        t, total = ngram_lm.tokens(text), self.counts.total()
        padded = [None] * (self.order - 1) + t
        base = math.fsum(math.log10((self.counts[w] + 1) / (total + len(self.counts) + 1)) for w in t)
        return len(t), sum(w in self.counts for w in t), base, math.fsum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(t)))


def lm_rows():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{w}" if w % 7 else f"W{w}\x0b" for w in rng.zipf(1.3, rng.integers(0, 60)) % 50), "en", "s") for i in range(300)]
    rows += [(400, None, "en", "s"), (401, "", "en", "s"), (None, "w1 w2 Ünknown\x85here", "en", "s"), (7, "w1 w2 w3", "en", "s"), (7, "w1 w2 w3", "en", "s"), (402, "hot " * 70_000, "en", "s"), (403, " \t\n", None, None)]
    return rows


@pytest.mark.parametrize(("order", "shard_bytes", "chunk"), [(1, 100, 200), (2, 1 << 26, 1 << 20), (2, 50, 1), (3, 1000, 300), (4, 200_000, 1000)])
def test_language_model(spark, monkeypatch, order, shard_bytes, chunk):
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
    rows = lm_rows()
    docs = frame(spark, rows).withColumn("score", F.lit("x")).repartition(3)
    model = ngram_lm.train(docs, ngram_lm.bucket("doc_id") != 2, order=order)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    plain = Plain([t for i, t, *_ in rows if not held(i)], order)
    assert (model.tokens, model.kinds) == (plain.counts.total(), len(plain.counts))
    assert {k: (0, *c) for k, c in model.cut.items()} == plain.cut
    got = sorted((r.doc_id or -1, r.text or "", r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram_lm.score(docs, model, ("doc_id", "text")).collect())
    want = sorted((i or -1, t or "", *plain.scores(t)) for i, t, *_ in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_sum_to_one(spark, order):
    docs = frame(spark, lm_rows())
    model = ngram_lm.train(docs, order=order)
    words = np.arange(model.kinds + 2)
    words = words[words != model.kinds]
    for before in ([model.kinds] * (order - 1), [3, 5][: order - 1], [0, model.kinds + 1][: order - 1], [model.kinds, 4][: order - 1]):
        p = 10 ** model.log10([*[np.full(len(words), b) for b in before], words])
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_language_model_of_nothing(spark):
    docs = frame(spark, lm_rows())
    model = ngram_lm.train(docs.limit(0))
    assert {(r.n_known, r.base_score, r.score) for r in ngram_lm.score(docs, model).collect()} == {(0, 0.0, 0.0)}
    assert ngram_lm.score(docs.limit(0), ngram_lm.train(docs)).count() == 0


def test_held_out_texts_are_likelier_than_under_single_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = ngram_lm.bucket("doc_id") == 2
    model = ngram_lm.train(docs, ~held)
    got = ngram_lm.score(docs.where(held), model).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_files_of_another_store_are_copied_once(tmp_path, monkeypatch):
    from sessionloom.llm import common

    monkeypatch.setattr(common, "_copies", {})
    store = common.Store(f"file://{tmp_path}/x")
    with store.create("a") as f:
        f.write(b"some bytes")
    assert store.local("a") == f"{tmp_path}/x/a"
    store.mapped = False
    path = store.local("a")
    assert path == store.local("a") != f"{tmp_path}/x/a" and open(path, "rb").read() == b"some bytes"
    assert common.Store("s3a://bucket/folder?region=us-east-1").root == "bucket/folder"
