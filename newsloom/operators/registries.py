"""Registries of sources laid over each other, field by field.

Layers are ranked. Of two that may name the same source, each field comes from the first layer in that field's order that states it: some
fields are the base's to state, all others the overlay's. Further layers only add sources, under the prefix that each may demand. What breaks this is found as rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fields that the base registry states, where it does, whatever the overlay says.
BASE_FIELDS = (
    "fetch_plan", "fetch_enabled", "scheduled_fetch_enabled", "candidate_emission_enabled", "publication_eligible", "pipeline_wiring_enabled", "runtime_activation", "include_keywords", "exclude_keywords",
    "audience_segments", "default_route_on_accept", "source_url", "primary_url", "scope_url_in_gate", "scope_url_keywords", "parser_profile",
)
#: The layers in the order in which they are merged; the first two may name the same source, and two demand a prefix.
LAYERS = ("base", "overlay", "abroad", "batch2", "batch3", "burs", "egitim")
SHARED = ("base", "overlay")
PREFIXES = {"burs": "burs_", "egitim": "egitim_"}


def effective(rows: DataFrame, *, key: str = "source_id", layer: str = "layer", base_fields: Sequence[str] = BASE_FIELDS, layers: Sequence[str] = LAYERS) -> DataFrame:
    """One row for each source with every field resolved, and the layers that name it; a null field is one that a layer doesn't state.

    Base fields come from the first layer in order that states them; other fields from the overlay, then the base, then the rest. One aggregate, whatever the number of fields.
    """
    order = {name: i for i, name in enumerate(layers)}
    rank = lambda first: F.coalesce(*(F.when(F.col(layer) == name, F.lit(-1 if name == first else i)) for name, i in order.items()), F.lit(len(order)))
    fields = [c for c in rows.columns if c not in (key, layer)]
    ranked = rows.withColumns({"__own": rank(layers[0]), "__over": rank(layers[1])}) if fields else rows.withColumn("__own", rank(layers[0]))
    best = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("__own" if f in base_fields else "__over"))).alias(f) for f in fields]
    named = F.transform(F.array_sort(F.collect_set(F.struct("__own", layer))), lambda x: x[layer]).alias("layers")
    return ranked.groupBy(key).agg(*best, named)


def violations(rows: DataFrame, *, key: str = "source_id", layer: str = "layer", shared: Sequence[str] = SHARED, prefixes: Mapping[str, str] = PREFIXES) -> DataFrame:
    """(source, layer, code): ``duplicate`` in one layer, ``collision`` of a layer that may only add sources with another, ``prefix``, ``no_id``."""
    counted = rows.groupBy(F.col(key).alias("source"), F.col(layer).alias("layer")).agg(F.count("*").alias("n"))
    by_id = counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.collect_set("layer").alias("all"))
    own = counted.join(by_id, "source", "left")
    adds = ~F.col("layer").isin(*shared)
    wants = F.coalesce(*(F.when(F.col("layer") == name, ~F.col("source").startswith(p)) for name, p in prefixes.items()), F.lit(False)) if prefixes else F.lit(False)
    codes = F.array_compact(F.array(
        F.when(F.col("source").isNull(), "no_id"), F.when(F.col("source").isNotNull() & (F.col("n") > 1), "duplicate"), F.when(adds & (F.size("all") > 1), "collision"), F.when(F.col("source").isNotNull() & wants, "prefix"),
    ))
    return own.select("source", "layer", F.explode(codes).alias("code"))


def tier_counts(sources: DataFrame, tier: str = "source_tier") -> DataFrame:
    return sources.groupBy(tier).agg(F.count("*").alias("sources"))
