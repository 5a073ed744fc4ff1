"""Rules that rows must keep, as operators that return the rows which break them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import code_table

#: What an observed value may be. Columns: value_state, numeric_value, text_value, lower_bound, upper_bound, interval_type, status_flag.
VALUE_RULES = (
    ("state", "value_state IS NULL OR value_state NOT IN ('PRESENT', 'MISSING', 'NOT_AVAILABLE', 'NOT_APPLICABLE', 'SUPPRESSED', 'UNKNOWN')"),
    ("not_finite", "exists(array(numeric_value, lower_bound, upper_bound), x -> isnan(x) OR abs(x) > 9007199254740992)"),
    ("number_without_presence", "numeric_value IS NOT NULL AND value_state <> 'PRESENT'"),
    ("presence_without_value", "value_state = 'PRESENT' AND numeric_value IS NULL AND text_value IS NULL"),
    ("interval", "coalesce(lower_bound, upper_bound) IS NOT NULL AND (value_state <> 'PRESENT' OR interval_type IS NULL)"),
    ("bounds", "lower_bound > upper_bound"),
    ("text_length", "length(text_value) > 200 OR length(status_flag) > 60"),
)
_FIRST = "CASE left(period_key, 1) WHEN 'Y' THEN concat(substr(period_key, 2, 4), '-01-01') WHEN 'Q' THEN concat(substr(period_key, 2, 4), '-', lpad(CAST(3 * try_cast(right(period_key, 1) AS INT) - 2 AS STRING), 2, '0'), '-01') WHEN 'M' THEN concat(substr(period_key, 2, 7), '-01') WHEN 'D' THEN substr(period_key, 2) END"
_MONTHS = "CASE left(period_key, 1) WHEN 'Y' THEN 12 WHEN 'Q' THEN 3 WHEN 'M' THEN 1 END"
_LAST = f"CASE WHEN left(period_key, 1) = 'D' THEN try_to_date({_FIRST}) ELSE date_sub(add_months(try_to_date({_FIRST}), {_MONTHS}), 1) END"
#: What a period may be. Columns: period_key, granularity, period_start, period_end, source_key.
PERIOD_RULES = (
    ("granularity", "granularity IS NULL OR granularity NOT IN ('YEAR', 'QUARTER', 'MONTH', 'DAY', 'DATE_RANGE', 'OTHER_SOURCE_PERIOD')"),
    ("key", "NOT coalesce(period_key RLIKE CASE granularity WHEN 'YEAR' THEN '^Y[0-9]{4}$' WHEN 'QUARTER' THEN '^Q[0-9]{4}-[1-4]$' WHEN 'MONTH' THEN '^M[0-9]{4}-(0[1-9]|1[0-2])$' WHEN 'DAY' THEN '^D[0-9]{4}-[0-9]{2}-[0-9]{2}$' WHEN 'DATE_RANGE' THEN '^R:' ELSE '^X:' END AND length(period_key) BETWEEN 3 AND 80, false)"),
    ("source_key", "source_key IS NULL OR length(source_key) NOT BETWEEN 1 AND 120"),
    ("no_bounds", "granularity <> 'OTHER_SOURCE_PERIOD' AND (period_start IS NULL OR period_end IS NULL)"),
    ("order", "period_end < period_start"),
    ("contradiction", f"granularity IN ('YEAR', 'QUARTER', 'MONTH', 'DAY') AND (period_start <> try_to_date({_FIRST}) OR period_end <> {_LAST})"),
    ("range_key", "granularity = 'DATE_RANGE' AND period_key <> concat('R:', period_start, '/', period_end)"),
)
#: Where a value may come from. Columns: kind, method, locator, artifact_id, retrieved_at.
PROVENANCE_RULES = (
    ("locator", "locator IS NULL OR length(locator) NOT BETWEEN 1 AND 500"),
    ("retrieved_at", "retrieved_at IS NULL"),
    ("artifact", "kind <> 'API' AND coalesce(artifact_id, '') = ''"),
    ("pdf_method", "kind = 'PDF' AND method <> 'PDF_TABLE_PARSE'"),
    ("file_method", "kind = 'FILE' AND method NOT IN ('SPREADSHEET_CELL', 'NATIVE_STRUCTURED')"),
    ("api_method", "kind = 'API' AND method = 'PDF_TABLE_PARSE'"),
)


def violations(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """The rows that break a rule, with the names of all that they break in ``broken``: one pass, no shuffle."""
    return df.withColumn("broken", code_table(rules)).where("broken <> ''")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows) of keys that more than one row has; a null key equals a null one."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def orphans(df: DataFrame, owner: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys no row of the owner has: releases of another run, cells of an unknown artifact. Null keys are orphans."""
    return df.join(owner.select(*keys).distinct(), list(keys), "left_anti")


def bad_relations(members: DataFrame, relation: str, member: str, *, least: int = 2, most: int = 4) -> DataFrame:
    """(relation, members) of relations that don't have ``least`` to ``most`` different members."""
    n = members.groupBy(relation).agg(F.count_distinct(member).alias("members"))
    return n.where(~F.col("members").between(least, most))
