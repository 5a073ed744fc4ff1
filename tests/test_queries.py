"""Every core query with SQL returns what another engine returns; the others return stable rows."""

import pandas as pd
import pytest

from newsloom.plans import registry


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return ""
        if isinstance(v, float):
            return f"{v:.5f}"
        if isinstance(v, int) and not isinstance(v, bool) or type(v).__name__.startswith(("int", "Int")):
            return f"{float(v):.5f}"
        return str(v).removesuffix(" 00:00:00")

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, medium, name):
    got, expected = registry.QUERIES[name](spark, medium).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) == len(expected)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_and_repeats(spark, small, name):
    first = registry.QUERIES[name](spark, small)
    assert rows(first.toPandas()) == rows(registry.QUERIES[name](spark, small).toPandas())


@pytest.mark.parametrize("name", ["status_counts", "provenance_trace", "signal_aggregates", "ingest_gate", "current_observations"])
def test_native_plans(spark, small, name):
    plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "ReadSchema" in plan
