"""Cubes of six dimensions as a source publishes them, checked and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cubes as C
from ..sources.tables import load
from .registry import query

DIMENSIONS = ("freq", "unit", "segment", "priority", "nation", "time")
#: Fixed values of the tables.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CONTRACT = C.Contract(DIMENSIONS, {"freq": ("A",), "unit": ("NR",), "segment": SEGMENTS}, {"segment": SEGMENTS}, "time", labelled=("nation",))
_COUNTS = "counts AS (SELECT n_regionkey AS region, n_name AS nation, c_mktsegment AS segment, o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS time, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"
_GRID = """grid AS (SELECT * FROM (SELECT DISTINCT segment FROM counts) CROSS JOIN (SELECT DISTINCT priority FROM counts) CROSS JOIN (SELECT DISTINCT region, nation FROM counts) CROSS JOIN (SELECT DISTINCT time FROM counts)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY segment, priority, nation, time) - 1 AS position FROM grid)"""


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text for each region: orders by segment, priority, nation and year. Small counts are left out and some cells are flagged; three regions print what a source must not."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation"))
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    counts = rows.groupBy("region", "nation", F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("time")).agg(F.count("*").alias("n"))
    names = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}_names")  # noqa: E731  categories of a dimension: a handful
    shared = counts.agg(names("segment"), names("priority"), names("time"))
    dims = counts.groupBy("region").agg(names("nation")).crossJoin(F.broadcast(shared))
    own = ("segment", "priority", "nation", "time")
    at = F.lit(0).cast("long")
    for d in own:
        at = at * F.size(f"{d}_names") + F.array_position(F.col(f"{d}_names"), F.col(d)) - 1
    cells = counts.join(F.broadcast(dims), "region").withColumn("at", at)
    values = cells.where("n % 11 > 0").groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("string"), F.col("n").cast("double")))).alias("value"))
    flags = cells.where("n % 5 = 0").groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("string"), F.lit("e")))).alias("status"))
    index = lambda c: F.map_from_entries(F.transform(c, lambda x, i: F.struct(x, i)))
    category = lambda c: F.struct(F.struct(index(c).alias("index"), F.map_from_entries(F.transform(c, lambda x: F.struct(x, F.initcap(x)))).alias("label")).alias("category"))
    lists = {"freq": F.array(F.lit("A")), "unit": F.array(F.lit("NR")), **{d: F.col(f"{d}_names") for d in own}}
    r = F.col("region")
    printed = F.when(r == 2, F.map_concat("value", F.create_map(F.lit("100000"), F.lit(1.0)))).otherwise(F.col("value"))
    body = F.to_json(F.struct(
        F.lit("dataset").alias("class"), F.lit("2.0").alias("version"), F.when(r == 3, "yesterday").otherwise("2024-01-15T23:00:00+0200").alias("updated"),
        F.when(r == 1, F.array(*map(F.lit, reversed(DIMENSIONS)))).otherwise(F.array(*map(F.lit, DIMENSIONS))).alias("id"), F.array(*(F.size(c) for c in lists.values())).alias("size"),
        F.map_from_arrays(F.array(*map(F.lit, lists)), F.array(*map(category, lists.values()))).alias("dimension"), printed.alias("value"), F.col("status"),
    ))
    return dims.join(values, "region").join(flags, "region", "left").select(r.alias("cube_id"), body.alias("body"))


@query(f"""WITH {_COUNTS}, {_GRID} SELECT region AS cube_id, position, 'A' AS freq, 'NR' AS unit, segment, priority, nation, time, CASE WHEN n % 11 > 0 THEN CAST(n AS DOUBLE) END AS value, CASE WHEN n % 11 > 0 THEN 'measured' ELSE 'missing' END AS state, CASE WHEN n % 5 = 0 THEN 'e' ELSE '' END AS flag
FROM numbered LEFT JOIN counts USING (region, nation, segment, priority, time) WHERE region IN (0, 4)""")
def cube_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each cell of the cubes that keep their contract, with its coordinates, state and flag."""
    cells = C.cells(C.accepted(C.published(_published(spark, sf_dir)), CONTRACT))
    return cells.select("cube_id", "position", *(F.col("coordinates")[d].alias(d) for d in DIMENSIONS), "value", "state", "flag")


@query("SELECT 1 AS cube_id, 'dimensions' AS code, 'time,nation,priority,segment,unit,freq' AS detail FROM region WHERE r_regionkey = 1 UNION ALL SELECT 2, 'position', '100000' FROM region WHERE r_regionkey = 2 UNION ALL SELECT 3, 'updated', 'yesterday' FROM region WHERE r_regionkey = 3")
def cube_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What published cubes break of their contract, as rows."""
    return C.violations(C.published(_published(spark, sf_dir)), CONTRACT)
