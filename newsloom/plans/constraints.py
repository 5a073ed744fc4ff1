"""Rows that break the rules of the statistical model, over observations written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import constraints as C
from ..sources.tables import load
from .registry import query


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'state' WHEN 1 THEN 'not_finite' WHEN 2 THEN 'number_without_presence' WHEN 3 THEN 'presence_without_value' WHEN 4 THEN 'interval' WHEN 5 THEN 'bounds' WHEN 6 THEN 'interval,bounds' ELSE 'text_length' END AS broken FROM events WHERE event_id % 9 < 8""")
def value_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are no values: unknown states, numbers of what is missing, intervals without a kind, bounds in the wrong order."""
    k = F.col("event_id") % 9
    rows = load(spark, sf_dir, "events").select(
        "event_id",
        F.when(k == 0, "LOST").when(k == 2, "MISSING").otherwise("PRESENT").alias("value_state"),
        F.when(k == 1, F.lit(float("inf"))).when(k.isin(0, 3), None).otherwise(1.5).alias("numeric_value"),
        F.when(k == 7, F.repeat(F.lit("x"), 201)).alias("text_value"),
        F.when(k.isin(4, 8), 1.0).when(k.isin(5, 6), 3.0).alias("lower_bound"),
        F.when(k.isin(4, 5, 6, 8), 2.0).alias("upper_bound"),
        F.when(k.isin(5, 8), "CI95").alias("interval_type"),
        F.lit(None).cast("string").alias("status_flag"),
    )
    return C.violations(rows, C.VALUE_RULES).select("event_id", "broken")


@query("""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 4 THEN 'key' WHEN 5 THEN 'contradiction' WHEN 6 THEN 'range_key' WHEN 7 THEN 'no_bounds' WHEN 8 THEN 'order,contradiction' ELSE 'granularity,key' END AS broken FROM orders WHERE o_orderkey % 10 > 3""")
def period_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods whose key, kind and bounds don't agree; years, quarters, months and days that do are left alone."""
    k, day = F.col("o_orderkey") % 10, F.to_date("o_orderdate")
    year, month = F.year(day).cast("string"), F.date_format(day, "yyyy-MM")
    text = lambda c: c.cast("string")
    kind = F.when(k.isin(0, 4, 7), "YEAR").when(k == 1, "QUARTER").when(k.isin(2, 5), "MONTH").when(k.isin(3, 8), "DAY").when(k == 6, "DATE_RANGE").otherwise("WEEK")
    key = F.when(k.isin(0, 7), F.concat(F.lit("Y"), year)).when(k == 1, F.concat(F.lit("Q"), year, F.lit("-"), text(F.quarter(day)))).when(k.isin(2, 5), F.concat(F.lit("M"), month)).when(k.isin(3, 8), F.concat(F.lit("D"), text(day))).when(k == 6, F.concat(F.lit("R:"), text(day), F.lit("/never"))).otherwise(year)
    start = F.when(k.isin(0, 4), F.trunc(day, "year")).when(k == 1, F.trunc(day, "quarter")).when(k.isin(2, 5), F.trunc(day, "month")).when(k == 7, None).otherwise(day)
    end = F.when(k.isin(0, 4), F.date_sub(F.add_months(F.trunc(day, "year"), 12), 1)).when(k == 1, F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1)).when(k == 2, F.last_day(day)).when(k == 5, F.date_add(F.last_day(day), 1)).when(k == 8, F.date_sub(day, 1)).when(k == 7, None).otherwise(day)
    rows = load(spark, sf_dir, "orders").select("o_orderkey", key.alias("period_key"), kind.alias("granularity"), start.alias("period_start"), end.alias("period_end"), F.lit("s").alias("source_key"))
    return C.violations(rows, C.PERIOD_RULES).select("o_orderkey", "broken")


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'locator' WHEN 1 THEN 'artifact' WHEN 2 THEN 'pdf_method' WHEN 3 THEN 'file_method' WHEN 4 THEN 'api_method' ELSE 'retrieved_at' END AS broken FROM part WHERE p_partkey % 7 < 6""")
def provenance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that can't be traced: no place, no artifact where one is needed, a way of reading that the kind doesn't allow."""
    k = F.col("p_partkey") % 7
    rows = load(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k.isin(0, 4, 5), "API").when(k == 2, "PDF").otherwise("FILE").alias("kind"),
        F.when(k.isin(3, 4), "PDF_TABLE_PARSE").when(k == 2, "MANUAL_ENTRY").otherwise("SPREADSHEET_CELL").alias("method"),
        F.when(k != 0, F.col("p_name")).otherwise("").alias("locator"),
        F.when(k != 1, F.lit("art_1")).alias("artifact_id"),
        F.when(k != 5, F.lit("2024-01-01T00:00:00Z")).alias("retrieved_at"),
    )
    return C.violations(rows, C.PROVENANCE_RULES).select("p_partkey", "broken")


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY ALL HAVING count(*) > 1")
def batch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a batch brings more than once."""
    return C.repeated(load(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day")), ["user_id", "event_type", "day"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def foreign_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch that belong to no release of its run."""
    owner = load(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.orphans(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), owner, ["l_orderkey"])


@query("SELECT l_orderkey AS relation, count(DISTINCT l_suppkey) AS members FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) NOT BETWEEN 2 AND 4")
def relation_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with too few or too many members."""
    return C.bad_relations(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relation"), "l_suppkey"), "relation", "l_suppkey")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE concat('10.1000/s', p_partkey) END AS doi, CASE p_partkey % 6 WHEN 4 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', p_partkey, '/') WHEN 5 THEN NULL ELSE concat('https://doi.org/10.1000/s', p_partkey) END AS link,
 CASE p_partkey % 3 WHEN 0 THEN concat('10.1038/s41586-024-', p_partkey + 10000, '-x') WHEN 1 THEN concat('10.1000/u', p_partkey) END AS url_doi FROM part""")
def original_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study that a press page reports on, by metadata, label or link, and the DOI of the page's own address."""
    i, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    html = (
        F.when(k == 0, join("<meta content='x' name='author'><meta name='citation_doi' content='doi:10.1000/S", i, "'><p>DOI: 10.9/other</p>"))
        .when(k == 1, join('<meta content="10.1000/s', i, '" property="DC.Identifier">'))
        .when(k == 2, join("<p><b>Journal reference</b> <i>A. Journal, 10.1000/s", i, ".</i></p><a href='https://doi.org/10.9999/z'>z</a>"))
        .when(k == 3, join('<a href="http://dx.doi.org/10.1000/s', i, '">study</a>'))
        .when(k == 4, join('<a href="https://pubmed.ncbi.nlm.nih.gov/', i, '/">study</a>'))
        .otherwise("<p>No study.</p>")
    )
    j = F.col("p_partkey") % 3
    url = F.when(j == 0, join("https://www.nature.com/articles/s41586-024-", (F.col("p_partkey") + 10_000).cast("string"), "-X?x=1")).when(j == 1, join("https://x.org/doi/10.1000%2FU", i)).otherwise(join("https://nature.com/articles/", i))
    return load(spark, sf_dir, "part").select("p_partkey", T.original_study(html).alias("s"), T.article_doi(url).alias("url_doi")).select("p_partkey", "s.doi", "s.link", "url_doi")
