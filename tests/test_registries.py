"""Registries laid over each other, field by field."""

from newsloom.operators import registries as R

ROWS = [("a", "base", "yes", None, "t1", "A"), ("a", "overlay", "no", "u2", None, "B"), ("b", "overlay", None, "u3", "t3", None), ("b", "base", None, None, "t4", "C"), ("c", "abroad", "x", None, "t5", "A"), ("a", "batch2", "z", "z", "z", "Z"), ("burs_d", "burs", None, None, None, "A"), ("d", "burs", None, None, None, None), ("e", "base", None, None, None, None), ("e", "base", None, None, None, None), (None, "base", None, None, None, None)]
SCHEMA = "source_id string, layer string, fetch_enabled string, source_url string, title string, source_tier string"


def test_effective_fields(spark):
    got = {r["source_id"]: tuple(r)[1:] for r in R.effective(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got["a"] == ("yes", "u2", "t1", "B", ["base", "overlay", "batch2"]) and got["b"] == (None, "u3", "t3", "C", ["base", "overlay"])
    assert got["c"] == ("x", None, "t5", "A", ["abroad"]) and got["e"] == (None, None, None, None, ["base"])


def test_violations(spark):
    got = {tuple(r) for r in R.violations(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {("a", "batch2", "collision"), ("d", "burs", "prefix"), ("e", "base", "duplicate"), (None, "base", "no_id")}
    assert R.violations(spark.createDataFrame([], SCHEMA)).count() == R.effective(spark.createDataFrame([], SCHEMA)).count() == 0
