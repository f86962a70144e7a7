"""The store of sums: adding, removing and rewriting files gives what a full run gives, and reads changed files only."""

import shutil

import pytest
from pyspark.sql import functions as F

from sessionloom import catalog
from sessionloom.functions import hold
from sessionloom.operators import features
from sessionloom.plans.refreshed import Store, Sums
from sessionloom.sources import adapters


@pytest.fixture
def parts(spark, sf, tmp_path):
    events = adapters.visit_events(spark, sf)
    for k in range(4):
        events.where(F.pmod("session", F.lit(4)) == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return events, tmp_path


OF = Sums(lambda e: features.with_hours(e, catalog.T_MIN), ("aid", "type", "day", "hour"), ("n",))


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_adding_removing_and_rewriting(spark, parts, monkeypatch):
    events, at = parts
    store, opened = Store(spark, f"file://{at}/store", OF), []
    every = type(spark.read)
    plain = every.parquet
    monkeypatch.setattr(every, "parquet", lambda self, *paths, **how: opened.extend(p for p in paths if "/in/" in p) or plain(self, *paths, **how))

    def check(of, n_read):
        left = events.where(F.pmod("session", F.lit(4)).isin(*of)) if of else events.limit(0)
        total = store.refresh([f"{at}/in"])
        assert len(opened) == n_read
        opened.clear()
        assert rows(features.popularity_week(total)) == rows(features.popularity_week(left))
        assert rows(features.popularity_day(total, catalog.T_MIN)) == rows(features.popularity_day(left, catalog.T_MIN))
        assert rows(features.popularity_hour(total)) == rows(features.popularity_hour(left))

    shutil.move(f"{at}/in/3", f"{at}/three")
    check((0, 1, 2), 3)
    v = store.version()
    check((0, 1, 2), 0)
    assert store.version() == v  # nothing changed, nothing written
    shutil.move(f"{at}/three", f"{at}/in/3")
    shutil.rmtree(f"{at}/in/1")
    check((0, 2, 3), 1)
    shutil.rmtree(f"{at}/in/0")
    check((2, 3), 0)
    events.where(F.pmod("session", F.lit(4)) == 1).coalesce(1).write.mode("overwrite").parquet(f"{at}/in/2")  # written anew with other events
    check((1, 3), 1)
    store.prune()
    assert rows(store.total()) == rows(OF.prepare(events.where(F.pmod("session", F.lit(4)).isin(1, 3))).groupBy(*OF.keys).agg(F.sum("n")))
    # A run that broke off before its manifest is not seen, and written over.
    store.total().write.parquet(f"file://{at}/store/{store.version() + 1}/total")
    check((1, 3), 0)
    events.where(F.pmod("session", F.lit(4)) == 0).coalesce(1).write.parquet(f"{at}/in/0")
    check((0, 1, 3), 1)
    shutil.rmtree(f"{at}/in")
    events.limit(0).coalesce(1).write.parquet(f"{at}/in/x")
    check((), 1)


def test_listing_reads_no_content(spark, parts):
    from sessionloom.plans.refreshed import listed

    _, at = parts
    assert listed(spark, [f"{at}/in"]).count() == 4
    plan = listed(spark, [f"{at}/in"])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert hold.folders(spark, f"{at}/nothing") == []
