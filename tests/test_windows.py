"""Windows kept up to date against the full computation after each batch."""

import datetime
import random

from pyspark.sql import functions as F

from newsloom.operators.windows import WindowStore, merged, partials

KEYS, SETS = ("concept", "geo"), ("units", "actors")


def full(rows, today):
    out = {}
    for concept, geo in {r[:2] for r in rows}:
        for days in (7, 30, 90):
            age = lambda r: (today - r[2]).days
            own = [r for r in rows if r[:2] == (concept, geo)]
            now, prior = [r for r in own if 0 <= age(r) < days], [r for r in own if days <= age(r) < 2 * days]
            if now:
                out[concept, geo, days] = (len(now), len({r[3] for r in now} - {None}), len({r[4] for r in now} - {None}), len(now) - len(prior), min(r[2] for r in now), max(r[2] for r in now), len({r[2] for r in now}))
    return out


def got(df):
    return {(r["concept"], r["geo"], r["days"]): (r["n"], r["units"], r["actors"], r["momentum"], r["first_day"], r["last_day"], r["active_days"]) for r in df.collect()}


def test_windows_after_each_batch(spark, tmp_path):
    """Late and future days, null members, numbers far apart, a batch applied twice, a reference day that moves on past everything."""
    rng = random.Random(9)
    start = datetime.date(2024, 1, 1)
    store = WindowStore(spark, f"file://{tmp_path}/store", KEYS, SETS)
    seen, before = [], None
    for batch, today in enumerate([60, 60, 63, 90, 400]):
        day = start + datetime.timedelta(days=today)
        rows = [(rng.randrange(6), rng.choice(["TR", "EU"]), start + datetime.timedelta(days=rng.randrange(today + 3) if batch != 4 else 395), rng.choice([None, 1, 2, 3, 40_000, 10**12, 10**12 + 1]), rng.randrange(5)) for _ in range([80, 40, 5, 3, 1][batch])]
        seen += rows
        df = spark.createDataFrame(rows, "concept long, geo string, day date, units long, actors long")
        touched = store.apply(batch, df, day.isoformat(), before and before.isoformat())
        if batch == 1:
            touched = store.apply(batch, df, day.isoformat(), before.isoformat())
        assert got(store.current()) == full(seen, day)
        if batch == 1:
            assert {k[:2] for k in got(touched)} <= {r[:2] for r in rows}
        before = day
    store.clear()


def test_no_expand_in_the_plan(spark):
    df = spark.createDataFrame([(1, "TR", datetime.date(2024, 1, 1), 1, 1)], "concept long, geo string, day date, units long, actors long")
    plan = merged(partials(df, KEYS, SETS), KEYS, SETS, F.lit("2024-01-03").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "bitmap_or_agg" in plan


def test_parts_follow_the_rows(spark, monkeypatch):
    """More rows are dealt to more tasks, and what is grouped is narrow: no row carries a bitmap of a whole range."""
    from newsloom.operators import windows

    monkeypatch.setattr(windows, "PART", 100)
    rows = spark.range(2_000).select((F.col("id") % 50).alias("concept"), F.concat(F.lit("g"), F.col("id") % 2).alias("geo"), F.lit("2024-01-01").cast("date").alias("day"), (F.col("id") * 1000 - 5).alias("units"), F.col("id").alias("actors"))
    parts = partials(rows, KEYS, SETS)
    assert parts.rdd.getNumPartitions() == 60 and dict(parts.dtypes)["bits"] == "bigint"
    out = merged(parts, KEYS, SETS, F.lit("2024-01-02").cast("date")).where("days = 7").collect()
    assert len(out) == 50 and all((r["n"], r["units"], r["actors"], r["active_days"]) == (40, 40, 40, 1) for r in out)
