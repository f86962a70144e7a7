"""Every query of the catalogue against its SQL twin on the smallest tables, plans, models and streams."""

import glob
import os

import duckdb
import numpy as np
import pytest

from sessionloom import catalog
from sessionloom.operators import candidates, evaluation, features, models, sampling, sessions
from sessionloom.plans import recommender
from sessionloom.sources import adapters
from sessionloom.streaming import live

#: Long plans; one of them stands for all here, and the driver compares the rest.
SLOW = {"vote_fast", "vote_clicks", "pad_popular"}


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names, rows = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(float(r[i])) if type(r[i]).__name__ == "Decimal" else plain(r[i]) for i in at) for r in rows), key=repr)
    assert rows and got == want


def test_pushdown(spark, sf):
    plan = adapters.user_events(spark, sf).select("aid")._jdf.queryExecution().toString()
    assert "NOT (event_type" in plan.replace("(NOT ", "NOT (").replace("Not(EqualTo(event_type", "NOT (event_type") and "value" not in plan.split("ReadSchema:")[-1].split("\n")[0]


def test_models(spark, sf):
    e = adapters.visit_events(spark, sf)
    assert models.item_vectors(e, size=8).count() == e.select("aid").distinct().count()
    assert models.item_factors(e, rank=4, rounds=1).count() == e.select("aid").distinct().count()


def test_recommender(spark, sf):
    predictions, results = recommender.recommend(adapters.visit_events(spark, sf), catalog.vector_sets(spark, sf), catalog.T_MIN, catalog.T_MAX, hold=catalog.held, rounds=1, folds=2, classes=("clicks", "orders"))
    rows = {r.type: r for r in results.collect()}
    assert predictions.count() and set(rows) <= {"clicks", "orders"} and all(r.n_found <= r.n_gts for r in rows.values())


def test_streams(spark, sf, tmp_path):
    adapters.user_events(spark, sf).write.parquet(f"{tmp_path}/in")
    batch = live.live_popularity(live.with_time(spark.read.parquet(f"{tmp_path}/in"))).count()
    source = spark.readStream.schema("session long, aid long, ts long, type int, eid long").parquet(f"{tmp_path}/in")
    q = live.live_popularity(live.with_time(source)).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("live").count() == batch > 0
    assert live.live_subsessions(live.with_time(spark.read.parquet(f"{tmp_path}/in"))).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{tmp_path}/in").count()


def test_registered_models_have_the_reference_settings(spark, sf, monkeypatch):
    """mf_train: 64 dimensions and 20 rounds; w2v_train: 5 passes."""
    seen, als, w2v = [], models.ALS, models.Word2Vec
    monkeypatch.setattr(models, "ALS", lambda **how: seen.append((how["rank"], how["maxIter"])) or als(**how))
    monkeypatch.setattr(models, "Word2Vec", lambda **how: seen.append(how["maxIter"]) or w2v(**how))
    assert {len(r.vec) for r in catalog.QUERIES["mf_train"](spark, sf).limit(5).collect()} == {64}
    assert catalog.QUERIES["w2v_train"](spark, sf).limit(5).count() == 5
    assert seen == [(64, 20), 5]


def test_feature_table_is_made_of_its_parts(spark, sf):
    """517 features and 243 ranks; each family against the operator (held against SQL on its own) or plain Python."""
    k = catalog.Kept(spark, sf)
    sets = catalog.vector_sets(spark, sf)
    pairs = candidates.labelled(k.pairs.where("session % 3 = 0"), k.truth)
    table = recommender.feature_table(pairs, k.kept, k.events, sets, catalog.T_MIN, catalog.T_MAX, hold=catalog.held)
    made = [c for c in table.columns if c not in ("session", "candidates", "gt_clicks", "gt_carts", "gt_orders")]
    assert len([c for c in made if not c.endswith("_rank")]) == 517 and len([c for c in made if c.endswith("_rank")]) == 243
    got = {(r.session, r.candidates): r.asDict() for r in table.collect()}
    assert len(got) == pairs.count() > 100
    weights, no_clicks = features.session_weights(k.kept), features.session_weights(k.kept, no_click=True)
    parts = [(features.covisitation_features(pairs, k.kept, catalog.matrix(k.events, n), weights, f"matrix_{n}"), {}) for n in ("temporal", "217", "239")]
    for name in ("mf_1", "mf_1_9_buys"):
        vectors, buys = sets[name]
        last = sessions.last_items(k.kept, types=(1, 2) if buys else (0, 1, 2))
        # A session without carts and orders has no last ones.
        parts.append((features.last_item_similarity(pairs, last, vectors, name=name), {}))
        parts.append((features.factor_features(pairs, k.kept, vectors, no_clicks if buys else weights, name), {f"{name}_{w}_{a}": f"{name}_{w.removeprefix('w_')}_{a}" for w in features.EVENT_WEIGHTS for a in ("mean", "sum", "max")}))
        parts.append((features.sequence_features(pairs, k.kept, vectors, name), {f"{name}_{x}": f"{name}_seq_{x}" for x in ("max", "mean", "count", "wgt_1", "wgt_2", "last", "type")}))
    for e, suffix in ((k.events, ""), (k.kept, "_w")):
        totals = features.weighted_popularity(e, suffix).withColumnRenamed("aid", "candidates")
        parts.append((pairs.join(totals, "candidates", "left").na.fill(0.0, totals.columns[1:]), {}))
    for part, names in parts:
        columns = [c for c in part.columns if c not in pairs.columns]
        for r in part.collect():
            row = got[r.session, r.candidates]
            for c in columns:
                assert row[names.get(c, c)] == pytest.approx(r[c], abs=1e-9), c
    # Ranks: descending in the session, ties take the smallest.
    by = {}
    for (session, _), row in got.items():
        by.setdefault(session, []).append(row)
    for rows in by.values():
        for c in ("w_recsys", "matrix_157_mean", "mf_1_seq_max", "popularity_day_clicks", "orders_w_time_w"):
            for row in rows:
                assert row[f"{c}_rank"] == min(255, 1 + sum(x[c] > row[c] for x in rows)), c


def test_popular_items_pad_their_own_class(spark):
    events = spark.createDataFrame([(1, a, 1, t, k) for k, (a, t) in enumerate([(5, 0)] * 3 + [(6, 0)] * 2 + [(7, 1)] * 2 + [(8, 1)] + [(9, 2)])], "session long, aid long, ts long, type int, eid long")
    lists = spark.createDataFrame([(1, "clicks", [6]), (1, "carts", [1, 2]), (1, "orders", []), (2, "orders", [1, 2, 3, 4])], "session long, type string, preds array<long>")
    got = {(r.session, r.type): r.preds for r in evaluation.padded(lists, candidates.by_class(candidates.popular(events)), 4).collect()}
    assert got == {(1, "clicks"): [6, 5, 6], (1, "carts"): [1, 2, 7, 8], (1, "orders"): [9], (2, "orders"): [1, 2, 3, 4]}
    lines = {r.session_type: r.labels for r in evaluation.submission(lists).collect()}
    assert lines == {"1_clicks": "6", "1_carts": "1 2", "1_orders": "", "2_orders": "1 2 3 4"}


def test_visits_of_a_user_with_very_many_pauses(spark):
    rows = [(u, k, k * 100_000, 0, u * 10_000 + k) for u in (1, 2, 3) for k in range(1001 if u < 3 else 1)]
    got = adapters.visits(spark.createDataFrame(rows, "session long, aid long, ts long, type int, eid long"))
    assert got.select("session").distinct().count() == len(rows)
    assert {r.session for r in got.where("aid < 1000").collect()} == {u * 1000 + k for u, k, *_ in rows if k < 1000}


def test_factors_of_large_ids(spark):
    rows = [(s * 10**12 + 7, a * 10**11, 1, 0, s * 100 + a) for s in range(30) for a in range(s % 7, 9)]
    e = spark.createDataFrame(rows, "session long, aid long, ts long, type int, eid long")
    ids = {r.session: r.dense for r in models.dense_ids(e, "session").collect()}
    assert ids == {s * 10**12 + 7: s for s in range(30)}
    got = models.item_factors(e, rank=3, rounds=2).collect()
    assert {r.aid for r in got} == {a * 10**11 for a in range(9)} and all(len(r.vec) == 3 for r in got)


def test_factors_keep_one_round_on_disk(spark, monkeypatch):
    """Item factors are checkpointed after each round, whose shuffled factors then go; blocks grow with the pairs, and don't change what is learnt."""
    rows = [(s, a, 1, 0, s * 100 + a) for s in range(60) for a in range(12) if (s % 2 == a % 2) or (s + a) % 11 == 0]
    e = spark.createDataFrame([*rows, (None, 1, 1, 0, -1), (1, None, 1, 0, -2)], "session long, aid long, ts long, type int, eid long")
    seen, als = [], models.ALS
    monkeypatch.setattr(models, "ALS", lambda **how: seen.append(how) or als(**how))
    vectors = [{r.aid: np.array(r.vec) for r in models.item_factors(e, rank=4, rounds=8).collect()}]
    monkeypatch.setattr(models, "USERS_A_BLOCK", 20)
    monkeypatch.setattr(models, "ITEMS_A_BLOCK", 30)
    vectors.append({r.aid: np.array(r.vec) for r in models.item_factors(e, rank=4, rounds=8).collect()})
    n = len(rows)
    assert [(h["checkpointInterval"], h["numUserBlocks"], h["numItemBlocks"]) for h in seen] == [(1, 10, 10), (1, -(-n // 20), -(-n // 30))] and n > 300
    assert spark.sparkContext.getCheckpointDir()
    for found in vectors:
        unit = {a: v / np.linalg.norm(v) for a, v in found.items()}
        alike = [[unit[a] @ unit[b] for a in unit for b in unit if a < b and (a % 2 == b % 2) is same] for same in (True, False)]
        assert set(found) == set(range(12)) and min(alike[0]) > max(alike[1])


def test_search_and_early_stop(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, 2))
    rows = spark.createDataFrame([(i // 4, i, float(a), float(b), int(a + 0.3 * b > 0.7)) for i, (a, b) in enumerate(x)], "session long, candidates long, a double, b double, gt int")
    found = models.tune_ranker(rows, "gt", ["a", "b"], depths=(1, 3), rounds=(1, 3)).collect()
    assert len(found) == 4 and [r.auc for r in found] == sorted((r.auc for r in found), reverse=True) and found[0].auc > 0.9
    stopped = models.train_ranker(rows, "gt", ["a", "b"], rounds=30, depth=2, stop_share=0.3, tolerance=0.05)
    assert 1 <= len(stopped.trees) < 30 == len(models.train_ranker(rows, "gt", ["a", "b"], rounds=30, depth=2).trees)


def test_quantile_is_exact(spark):
    rng = np.random.default_rng(2)
    for keys in ([5], [1, 1, 1, 9], rng.integers(-(10**12), 10**12, 997).tolist(), rng.integers(0, 7, 500).tolist()):
        df = spark.createDataFrame([(k,) for k in [*keys, None]], "session long")
        for share in (0.0, 0.1, 0.5, 0.93, 1.0):
            assert sampling.quantile(df, share, "session").first().q == pytest.approx(float(np.quantile(np.array(keys, float), share)))


def test_vectors_and_folds_from_files(spark, tmp_path):
    m = np.random.default_rng(0).random((25, 4)).astype("float32")
    np.save(tmp_path / "m.npy", m)
    got = {r.aid: r.vec for r in adapters.read_npy(spark, f"{tmp_path}/m.npy", rows_per_read=10).collect()}
    assert len(got) == 25 and all(got[i] == pytest.approx(m[i].tolist()) for i in range(25))
    (tmp_path / "folds.csv").write_text("session,fold\n1,0\n2,3\n")
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "session long, aid long")
    assert sorted((r.session, r.fold) for r in adapters.with_folds_file(rows, f"{tmp_path}/folds.csv").collect()) == [(1, 0), (2, 3)]
