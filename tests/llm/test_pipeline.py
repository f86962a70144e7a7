"""The pipeline as a whole against plain Python: no Spark, one document after the other."""

import hashlib
import itertools
import os
import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from sessionloom.llm import bpe, common, langid, minhash, mixing, queries


def lines_kept(docs):
    pages, on = Counter(), Counter()
    for d in docs:
        pages[d["source"]] += 1
        for line in {x for x in d["text"].split("\n") if x.strip(" ")}:
            on[d["source"], line] += 1
    bad = {k for k, n in on.items() if n >= 3 and n / pages[k[0]] > 0.1}
    return [{**d, "text": "\n".join(x for x in d["text"].split("\n") if (d["source"], x) not in bad)} for d in docs]


def first_of_groups(docs):
    sets = {}
    for d in docs:
        w = d["text"].encode().lower().split()
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def fill(budget, children):
    """children: name -> (cap, weight); each gets its share, what one can't take goes to the others, in exact fractions."""
    open_, got = {k: v for k, v in children.items() if v[1] > 0}, {}
    left = Fraction(budget)
    while open_:
        level = left / sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap <= w * level]
        if not full:
            return got | {k: int(w * level) for k, (_, w) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[0]
            left -= got[k]
    return got


def mixed(docs):
    def domain(source):
        m = re.fullmatch("src([0-9]+)", source)
        return f"d{int(m[1]) // 5}" if m else "other"

    leaves = defaultdict(list)
    for d in docs:
        n = len(re.findall("[^\t-\r ]+", d["text"]))
        leaves[domain(d["source"]), d["lang"], d["source"]].append((d, n))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = lambda level, name: mixing.WEIGHTS[level].get(name, 10)

    def caps(depth, under):
        out = Counter()
        for k, n in size.items():
            if k[:depth] == under:
                out[k[depth]] += 3 * n
        return out

    out, total = [], int(sum(size.values()) * 0.6)
    for dom, b1 in fill(total, {k: (c, weight("domain", k)) for k, c in caps(0, ()).items()}).items():
        for lang, b2 in fill(b1, {k: (c, weight("lang", k)) for k, c in caps(1, (dom,)).items()}).items():
            for src, target in fill(b2, {k: (c, weight("source", k)) for k, c in caps(2, (dom, lang)).items()}).items():
                rows, n = leaves[dom, lang, src], size[dom, lang, src]
                full = target // n if n else 0
                rest, before = target - full * n, 0
                key = lambda r, e=full: hashlib.md5(f"11:{e}:{r[0]['doc_id']}".encode()).hexdigest()
                for d, t in sorted(rows, key=key):
                    out += [d] * (full + (before < rest))
                    before += t
    return out


def test_pipeline_against_plain_python(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = [{**d, "lang": p} for d in docs if (p := model.predict(d["text"])[0]) != "und"]
    docs = mixed(first_of_groups(lines_kept(docs)))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((d["doc_id"], d["lang"], d["source"], library.encode(d["text"], add_special_tokens=False).ids) for d in docs)
    got = sorted((r.doc_id, r.lang, r.source, r.ids) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b\nc", "en", "src1", 5), (2, "", "fr", None, 0), (3, "the cat sat on the mat", "en", "src0", 22), (3, "the cat sat on the mat", "en", "src0", 22), (4, "w " * 50_000, None, "src0", 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, full int, __x string"
    for odd in (spark.createDataFrame([(*r, 1, "y") for r in rows], schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, odd, "")
            assert out.columns == odd.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() == odd.count()


def test_last_stage_decodes(spark):
    texts = ["The cat sat on the mat.", "Ünïcödé  and   spaces\n", "", None]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_workers_drop_what_other_stages_kept(spark):
    """Python workers outlive a stage; what the last stage's tokenizer holds goes when another stage begins."""
    docs = spark.range(64).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text", "'en' AS lang").repartition(16)
    bpe.encode_decode(docs, queries.vocabulary_path()).write.format("noop").mode("overwrite").save()
    held = common.per_text(docs, "doc_id", "text", lambda texts: [(bpe.tokenizer.cache_info().currsize,)] * len(texts), "n int")
    assert {r.n for r in held.collect()} == {0}
    bpe.encode_decode(docs, queries.vocabulary_path()).write.format("noop").mode("overwrite").save()
    seen = langid.predict(docs, langid.fit(["some words", "quelques mots"], ["en", "fr"]))
    assert seen.where("lang_pred IS NULL").count() == 0
    minhash.near_duplicates(docs).count()
    held = common.per_text(docs, "doc_id", "text", lambda texts: [(minhash._words.cache_info().currsize,)] * len(texts), "n int", (bpe.tokenizer,))
    assert {r.n for r in held.collect()} == {0}


def test_registry():
    names = __spark_entry__.queries()
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == list(queries.QUERIES)
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "bpe"]


@pytest.fixture(scope="module")
def without(tmp_path_factory):
    """A copy of the repository without both llm folders: the root and the environment for it, where only this repository isn't found."""
    root, copy = os.path.dirname(os.path.abspath(__spark_entry__.__file__)), tmp_path_factory.mktemp("without") / "r"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(root)]
    return copy, os.environ | {"PYTHONPATH": os.pathsep.join(others)}


@pytest.mark.parametrize("pipeline_file", [True, False])
def test_everything_else_imports_without_these(without, pipeline_file):
    root, env = without
    if not pipeline_file:
        (root / "corpus_pipeline.py").unlink(missing_ok=True)
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=root, env=env, capture_output=True, text=True)
    assert "covis_93" in got.stdout and "op1_" not in got.stdout and "pipeline" not in got.stdout.split(), got.stderr


def test_other_tests_pass_without_these(without):
    """All test files load, and those of fixtures, scale and some queries run; the others, which train models or run long plans, are the same files that run beside this one."""
    root, env = without
    some = "test_fixtures or stretches or 64_bits or ranks_in_arrays or held_tables or limited_before or (test_query and (ground_truth or visit_events or covis_217 or popular_topk or quantile_filter))"
    got = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", some], cwd=root, env=env, capture_output=True, text=True)
    assert got.returncode == 0, got.stdout[-3000:]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE_SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
