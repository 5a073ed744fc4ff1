"""The versioned observation store: current values, revisions, releases, lineage, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import period_bounds
from ..functions.rules import all_matches, first_match
from ..operators import graph
from ..operators.latest import winner
from ..sources.cubes import decode
from ..sources.tables import VERSIONS_SQL, load, versions
from .registry import query

#: A total order of versions: release, then every other column, as keys repeat.
ORDER = ("release_rank", "release_id", "line", "source", "value", "quantity", "flag", "state")
_ORDER_SQL = "release_rank, release_id, line, source, value, quantity, flag, state"
_DESC_SQL = ", ".join(f"{c} DESC" for c in ORDER)


@query(f"WITH {VERSIONS_SQL} SELECT series_id, period, value, release_id, n - 1 AS revisions FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY {_DESC_SQL}) AS r, count(*) OVER (PARTITION BY series_id, period) AS n FROM versions WHERE flag <> 'R') WHERE r = 1")
def current_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force for each series and period, and how often it was revised: one aggregate, no sort."""
    eligible = versions(spark, sf_dir).where("flag <> 'R'")
    best = eligible.groupBy("series_id", "period").agg(F.max(F.struct(*ORDER)).alias("b"), (F.count("*") - 1).alias("revisions"))
    return best.select("series_id", "period", F.col("b.value").alias("value"), F.col("b.release_id").alias("release_id"), "revisions")


@query(f"WITH {VERSIONS_SQL} SELECT series_id, period, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC, {_DESC_SQL}) AS r FROM versions WHERE flag <> 'R') WHERE r = 1")
def series_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each series."""
    rows = versions(spark, sf_dir).where("flag <> 'R'")
    return winner(rows, ["series_id"], ["period", *ORDER], ["period", "value"])


@query(f"""WITH {VERSIONS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY release_id, line, source, release_rank, value, quantity, flag, state) AS arrival FROM versions),
 m AS (SELECT *, max(release_rank) OVER (PARTITION BY series_id, period ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a)
SELECT series_id, period, arrival, CASE WHEN best IS NULL THEN 'new_release' WHEN release_rank < best THEN 'backfill' WHEN release_rank = best THEN 'same_release' ELSE 'revised' END AS kind FROM m""")
def revision_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version by how it stood to the best one known when it arrived: late ones are backfill, never dropped."""
    arrived = Window.partitionBy("series_id", "period").orderBy("release_id", "line", "source", "release_rank", "value", "quantity", "flag", "state")
    rows = versions(spark, sf_dir).withColumn("arrival", F.row_number().over(arrived).cast("long"))
    best = F.max("release_rank").over(Window.partitionBy("series_id", "period").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("best", best)
    kind = first_match([("new_release", F.col("best").isNull()), ("backfill", F.col("release_rank") < F.col("best")), ("same_release", F.col("release_rank") == F.col("best"))], "revised")
    return rows.select("series_id", "period", "arrival", kind.alias("kind"))


@query("""WITH t AS (SELECT o_custkey AS cell, year(o_orderdate) AS y, round(max(o_totalprice), 2) AS v FROM orders GROUP BY ALL), c AS (SELECT * FROM t WHERE y = 2000), p AS (SELECT * FROM t WHERE y = 1999)
SELECT coalesce(c.cell, p.cell) AS cell, CASE WHEN p.cell IS NULL THEN 'new' WHEN c.cell IS NULL THEN 'missing' WHEN c.v = p.v THEN 'confirmed' ELSE 'revised' END AS delta FROM c FULL OUTER JOIN p ON c.cell = p.cell""")
def release_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two releases of a cube compared cell by cell."""
    t = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell"), F.year("o_orderdate").alias("y")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    c, p = t.where("y = 2000").select("cell", F.col("v").alias("now")), t.where("y = 1999").select("cell", F.col("v").alias("old"))
    rule = first_match([("new", F.col("old").isNull()), ("missing", F.col("now").isNull()), ("confirmed", F.col("now") == F.col("old"))], "revised")
    return c.join(p, "cell", "full_outer").select("cell", rule.alias("delta"))


@query(f"""WITH {VERSIONS_SQL}, t AS (SELECT * FROM versions v WHERE release_rank = (SELECT max(release_rank) FROM versions w WHERE w.series_id = v.series_id AND w.period = v.period))
SELECT series_id, period, CASE WHEN count(DISTINCT (value, flag)) = 1 THEN 'measured' ELSE 'ambiguous' END AS state, CASE WHEN count(DISTINCT (value, flag)) = 1 THEN max(value) END AS value FROM t GROUP BY ALL""")
def effective_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the newest release; several different ones at once are ambiguous and give none."""
    r = versions(spark, sf_dir).groupBy("series_id", "period", "release_rank").agg(F.min(F.struct("value", "flag")).alias("low"), F.max(F.struct("value", "flag")).alias("high"))
    t = r.groupBy("series_id", "period").agg(F.max(F.struct("release_rank", "low", "high")).alias("r"))
    one = F.col("r.low") == F.col("r.high")
    return t.select("series_id", "period", F.when(one, "measured").otherwise("ambiguous").alias("state"), F.when(one, F.col("r.low.value")).alias("value"))


@query(f"""WITH {VERSIONS_SQL}, l AS (SELECT *, lag(value) OVER (PARTITION BY series_id, period ORDER BY {_ORDER_SQL}) AS before FROM versions), c AS (SELECT period, CASE WHEN abs(value - before) > 0.5 * abs(before) THEN 'major' WHEN value <> before THEN 'minor' ELSE 'confirmation' END AS severity, series_id FROM l WHERE before IS NOT NULL)
SELECT period, severity, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(series_id))), 1, 5), ',') AS samples FROM c GROUP BY ALL""")
def revision_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions by severity with five sample series, the smallest ones by a bounded aggregate."""
    w = Window.partitionBy("series_id", "period").orderBy(*ORDER)
    l = versions(spark, sf_dir).withColumn("before", F.lag("value").over(w)).where("before is not null")  # noqa: E741
    rule = first_match([("major", F.abs(F.col("value") - F.col("before")) > 0.5 * F.abs("before")), ("minor", F.col("value") != F.col("before"))], "confirmation")
    c = l.select("period", rule.alias("severity"), "series_id")
    counts = c.groupBy("period", "severity").agg(F.count("*").alias("n"))
    few = c.distinct().withColumn("r", F.row_number().over(Window.partitionBy("period", "severity").orderBy("series_id"))).where("r <= 5")
    samples = few.groupBy("period", "severity").agg(F.array_join(F.array_sort(F.collect_list("series_id")).cast("array<string>"), ",").alias("samples"))
    return counts.join(samples, ["period", "severity"])


@query(f"""WITH {VERSIONS_SQL}, s AS (SELECT series_id, source % 2 AS side, round(avg(value / quantity), 4) AS v FROM versions GROUP BY ALL)
SELECT a.series_id, a.v AS left_value, b.v AS right_value, CASE WHEN abs(a.v - b.v) <= 0.1 OR abs(a.v - b.v) <= 0.05 * greatest(abs(a.v), abs(b.v)) THEN 'agree' ELSE 'differ' END AS verdict FROM s a JOIN s b ON a.series_id = b.series_id AND a.side = 0 AND b.side = 1""")
def cross_source_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of sources on the same series: both sides in one aggregate instead of a self-join."""
    unit = F.col("value") / F.col("quantity")
    side = lambda k: F.round(F.avg(F.when(F.col("source") % 2 == k, unit)), 4)
    s = versions(spark, sf_dir).groupBy("series_id").agg(side(0).alias("left_value"), side(1).alias("right_value")).where("left_value is not null and right_value is not null")
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    near = (gap <= 0.1) | (gap <= F.lit(0.05) * F.greatest(F.abs("left_value"), F.abs("right_value")))
    return s.select("*", F.when(near, "agree").otherwise("differ").alias("verdict"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, c_nationkey, r_name AS origin_region, p_brand FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'""")
def provenance_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a version back to the region it came from; the filter reaches the scan and small sides are chosen at run time."""
    l = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")  # noqa: E741
    t = lambda name: load(spark, sf_dir, name)
    joined = l.join(t("orders"), l.l_orderkey == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "c_nationkey", F.col("r_name").alias("origin_region"), "p_brand")


@query("""WITH RECURSIVE e AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS child, 'r' || CAST(n_regionkey AS VARCHAR) AS parent FROM nation UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'root' FROM region),
 t AS (SELECT child AS node, parent AS ancestor, CAST(1 AS BIGINT) AS depth FROM e UNION ALL SELECT t.node, e.parent, t.depth + 1 FROM t JOIN e ON e.child = t.ancestor WHERE t.depth < 8 AND e.parent <> t.node) SELECT node, ancestor, min(depth) AS depth FROM t GROUP BY ALL""")
def upstream_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All upstream nodes of each source with their distance."""
    n, c, r = (load(spark, sf_dir, x) for x in ("nation", "customer", "region"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = n.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")).unionAll(c.select(name("c", "c_custkey"), name("n", "c_nationkey"))).unionAll(r.select(name("r", "r_regionkey"), F.lit("root")))
    return graph.ancestors(edges)


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey - 1 END AS resolved_to FROM part), c AS (SELECT id, coalesce(resolved_to, id) AS survivor, resolved_to IS NULL AS done FROM m UNION ALL SELECT c.id, coalesce(m.resolved_to, m.id), m.resolved_to IS NULL FROM c JOIN m ON m.id = c.survivor WHERE NOT c.done)
SELECT id, survivor FROM c WHERE done AND id % 11 <> 0""")
def merge_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each merge chain ends, by doubling."""
    p = load(spark, sf_dir, "part").where("p_partkey % 11 <> 0")
    return graph.survivors(p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("resolved_to")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS u, b.l_suppkey AS v FROM lineitem a JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) b USING (l_partkey) UNION SELECT b.l_suppkey, a.l_suppkey FROM lineitem a JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) b USING (l_partkey)),
 r AS (SELECT u AS node, u AS root FROM (SELECT DISTINCT u FROM e WHERE u <> v) UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def independence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share an order's part with one another form one evidence group."""
    rows = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    first = rows.groupBy("l_partkey").agg(F.min("l_suppkey").alias("v"))
    return graph.independence_groups(rows.join(first, "l_partkey").select(F.col("l_suppkey").alias("u"), "v"))


@query("""SELECT o_orderkey, 'Y' || CAST(year(o_orderdate) AS VARCHAR) AS year_key, 'Q' || CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter_key, strftime(o_orderdate, 'M%Y-%m') AS month_key,
 CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(strftime(o_orderdate, '%Y%m%d%H%M%S') AS BIGINT) AS release_rank FROM orders""")
def period_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period keys and bounds of a day, and its release rank."""
    p = load(spark, sf_dir, "orders").select("o_orderkey", period_bounds(F.to_date("o_orderdate")).alias("p"), F.date_format("o_orderdate", "yyyyMMddHHmmss").cast("long").alias("release_rank"))
    return p.select("o_orderkey", F.col("p.year.key").alias("year_key"), F.col("p.quarter.key").alias("quarter_key"), F.col("p.month.key").alias("month_key"), F.col("p.quarter.start").alias("quarter_start"), F.col("p.quarter.end").alias("quarter_end"), F.col("p.month.end").alias("month_end"), "release_rank")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, concat_ws(',', CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_quantity >= 50 THEN 'quantity' END, CASE WHEN l_shipdate > TIMESTAMP '2001-10-01 00:00:00' THEN 'future' END) AS broken FROM lineitem) SELECT * FROM v WHERE broken <> ''""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a rule, with the names of all rules they break."""
    rules = [("discount", F.col("l_discount") > 0.09), ("quantity", F.col("l_quantity") >= 50), ("future", F.col("l_shipdate") > F.lit("2001-10-01 00:00:00").cast("timestamp_ntz"))]
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array_join(all_matches(rules), ",").alias("broken"))
    return rows.where("broken <> ''")


@query(f"""WITH {VERSIONS_SQL}, r AS (SELECT series_id, release_rank, max(value) AS value FROM versions GROUP BY ALL)
SELECT o_orderkey, o.o_custkey, r.release_rank, r.value FROM orders o ASOF LEFT JOIN r ON r.series_id = o.o_custkey AND r.release_rank <= CAST(strftime(o.o_orderdate, '%Y%m%d') AS BIGINT)""")
def as_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest release at or before each order's day: a union sorted once by key and rank, no range join."""
    r = versions(spark, sf_dir).groupBy("series_id", "release_rank").agg(F.max("value").alias("value"))
    releases = r.select(F.col("series_id").alias("key"), F.col("release_rank").alias("rank"), F.lit(None).cast("long").alias("o_orderkey"), F.struct("release_rank", "value").alias("release"))
    asked = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("rank"), "o_orderkey", F.lit(None).cast(releases.schema["release"].dataType).alias("release"))
    so_far = Window.partitionBy("key").orderBy("rank", F.col("o_orderkey").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = releases.unionByName(asked).withColumn("known", F.last("release", ignorenulls=True).over(so_far))
    return both.where("o_orderkey is not null").select("o_orderkey", F.col("key").alias("o_custkey"), F.col("known.release_rank").alias("release_rank"), F.col("known.value").alias("value"))


@query("""WITH n AS (SELECT DISTINCT n_nationkey AS a FROM nation), g AS (SELECT DISTINCT c_mktsegment AS b FROM customer), cells AS (SELECT a, b FROM n CROSS JOIN g), v AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*) AS n FROM customer GROUP BY ALL)
SELECT a AS nation, b AS segment, n AS value, CASE WHEN n IS NULL THEN 'missing' ELSE 'measured' END AS state FROM cells LEFT JOIN v USING (a, b)""")
def cube_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse cube in its published form (sizes, category lists, positions) decoded to one row a cell."""
    c = load(spark, sf_dir, "customer")
    rank = lambda d, name: d.distinct().withColumn(f"{name}_place", F.row_number().over(Window.orderBy(name)) - 1)  # noqa: E731  a dimension of a cube is short
    a, b = rank(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")), "nation"), rank(c.select(F.col("c_mktsegment").alias("segment")), "segment")
    width = b.agg(F.count("*").alias("width"))
    # what is published: sizes, categories by place, and one row a filled position
    values = c.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("value")).join(a, "nation").join(b, "segment")
    values = values.select((F.col("nation_place") * F.lit(width.scalar()) + F.col("segment_place")).alias("position"), "value")
    # decoding: every position there is, its coordinates by stride, and its value where one was published
    cells = a.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") * F.lit(width.scalar()) - 1)).alias("position"))
    cells = cells.select("position", F.floor(F.col("position") / F.lit(width.scalar())).alias("nation_place"), (F.col("position") % F.lit(width.scalar())).alias("segment_place"))
    return cells.join(values, "position", "left").join(a, "nation_place").join(b, "segment_place").select("nation", "segment", "value", F.when(F.col("value").isNull(), "missing").otherwise("measured").alias("state"))
