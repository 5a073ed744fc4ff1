"""The effective registry of sources, over three layers that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registries import effective, tier_counts, violations
from ..sources.tables import load
from .registry import query

#: Layers from the tables: what each states of a source, null where it states nothing.
_LAYERS = {
    "base": ("o_orderkey % 3 = 0", {"fetch_enabled": "CASE WHEN o_totalprice > 200000 THEN 'yes' END", "primary_url": "CASE WHEN o_orderpriority LIKE '1%' THEN concat('https://base.org/', o_orderkey) END", "title": "o_orderpriority", "source_tier": "CASE WHEN o_totalprice > 100000 THEN 'T1' END"}),
    "overlay": ("o_orderkey % 2 = 0", {"fetch_enabled": "CASE WHEN o_orderstatus <> 'F' THEN 'no' END", "primary_url": "concat('https://over.org/', o_orderkey)", "title": "CASE WHEN o_orderstatus = 'O' THEN upper(o_orderpriority) END", "source_tier": "CASE WHEN o_orderstatus = 'F' THEN 'T2' ELSE 'T3' END"}),
    "burs": ("o_orderkey % 5 = 0", {"fetch_enabled": "'later'", "primary_url": "CAST(NULL AS STRING)", "title": "concat('call ', o_orderstatus)", "source_tier": "'T4'"}),
}
FIELDS = ("fetch_enabled", "primary_url", "title", "source_tier")
_ID = "CASE WHEN '{0}' = 'burs' AND o_orderkey % 10 = 0 THEN concat('burs_', o_orderkey) ELSE concat('s', o_orderkey) END"
_ROWS = "rows_ AS (" + " UNION ALL ".join(f"SELECT {_ID.format(n)} AS source_id, '{n}' AS layer, {', '.join(f'{e} AS {f}' for f, e in fields.items())} FROM orders WHERE {cond}" for n, (cond, fields) in _LAYERS.items()).replace("AS STRING", "AS VARCHAR") + ")"
_EFFECTIVE = f"""{_ROWS}, b AS (SELECT * FROM rows_ WHERE layer = 'base'), o AS (SELECT * FROM rows_ WHERE layer = 'overlay'), u AS (SELECT * FROM rows_ WHERE layer = 'burs'), ids AS (SELECT DISTINCT source_id FROM rows_),
effective AS (SELECT ids.source_id, coalesce(b.fetch_enabled, o.fetch_enabled, u.fetch_enabled) AS fetch_enabled, coalesce(b.primary_url, o.primary_url, u.primary_url) AS primary_url, coalesce(o.title, b.title, u.title) AS title, coalesce(o.source_tier, b.source_tier, u.source_tier) AS source_tier,
 concat_ws(',', b.layer, o.layer, u.layer) AS layers FROM ids LEFT JOIN b USING (source_id) LEFT JOIN o USING (source_id) LEFT JOIN u USING (source_id))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, out = load(spark, sf_dir, "orders"), None
    for name, (condition, fields) in _LAYERS.items():
        own = orders.where(condition).selectExpr(f"{_ID.format(name)} AS source_id", f"'{name}' AS layer", *(f"{e} AS {f}" for f, e in fields.items()))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {_EFFECTIVE} SELECT * FROM effective")
def effective_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with each field from the layer that may state it, and the layers that name it."""
    return effective(_rows(spark, sf_dir)).withColumn("layers", F.array_join("layers", ","))


@query(f"WITH {_ROWS}, c AS (SELECT source_id, count(*) AS n FROM rows_ GROUP BY 1) SELECT source_id AS source, layer, 'collision' AS code FROM rows_ JOIN c USING (source_id) WHERE layer = 'burs' AND n > 1 UNION ALL SELECT source_id, layer, 'prefix' FROM rows_ WHERE layer = 'burs' AND source_id NOT LIKE 'burs\\_%' ESCAPE '\\'")
def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a layer may not name."""
    return violations(_rows(spark, sf_dir))


@query(f"WITH {_EFFECTIVE} SELECT source_tier, count(*) AS sources FROM effective GROUP BY 1")
def registry_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_counts(effective(_rows(spark, sf_dir)))
