"""Statistical cubes in their published, position-coded forms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode(cubes: DataFrame) -> DataFrame:
    """(position, coordinates, value, state) of every cell of rows (size, categories, value map by position).

    Positions count the last dimension fastest, so a coordinate is position divided by the product of
    the later sizes, modulo the own size. Absent cells are kept as ``missing``, never as zero.
    """
    total = F.aggregate("size", F.lit(1).cast("long"), lambda a, x: a * x)
    cells = cubes.select("size", "categories", "value", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("position"))
    stride = lambda i: F.aggregate(F.slice("size", i + 2, F.size("size")), F.lit(1).cast("long"), lambda a, x: a * x)
    coordinate = F.transform("categories", lambda names, i: F.get(names, (F.floor(F.col("position") / stride(i)) % F.get("size", i)).cast("int")))
    value = F.try_element_at("value", F.col("position"))
    return cells.select("position", coordinate.alias("coordinates"), value.alias("value"), F.when(value.isNull(), "missing").otherwise("measured").alias("state"))


def decode_keys(series: DataFrame) -> DataFrame:
    """(coordinates, value) of rows (key, categories, value) whose key names positions as ``i:j:k``."""
    at = F.split("key", ":").cast("array<int>")
    return series.select(F.transform(F.arrays_zip("categories", at.alias("at")), lambda z: F.get(z["categories"], z["at"])).alias("coordinates"), "value")


class CubeRefused(ValueError):
    """A cube that does not say what it should."""


def checked(cubes: DataFrame, most: int = 10_000) -> DataFrame:
    """The rows (size, categories, value), refused as a whole if one has other category counts than sizes, too many cells, or values outside them.

    A published cube is one document, so ``most`` cells are a contract with its source; larger ones are refused, never cut.
    """
    total = F.aggregate("size", F.lit(1).cast("long"), lambda a, x: a * x)
    wrong = F.when(~F.forall(F.arrays_zip(F.transform("categories", lambda c: F.size(c)).alias("n"), F.col("size").alias("s")), lambda z: z["n"] == z["s"]), "sizes").when(total > most, "cells").when(F.exists(F.map_keys("value"), lambda p: (p < 0) | (p >= total)), "position")
    found = cubes.select(wrong.alias("w")).where("w is not null").limit(1).collect()
    if found:
        raise CubeRefused(found[0]["w"])
    return cubes


def slice_of(cubes: DataFrame, fixed: dict[int, str]) -> DataFrame:
    """Cells (coordinate, value, state) of the one dimension that ``fixed`` (dimension to category) leaves free; other numbers of free dimensions are refused."""
    sizes = cubes.select(F.size("size").alias("n")).distinct().collect()
    if any(r["n"] != len(fixed) + 1 for r in sizes):
        raise CubeRefused("a slice leaves one dimension free")
    rows = decode(cubes)
    for i, name in fixed.items():
        rows = rows.where(F.get("coordinates", F.lit(i)) == name)
    free = F.filter("coordinates", lambda _, i: ~i.isin(*fixed))
    return rows.select(F.get(free, F.lit(0)).alias("coordinate"), "value", "state")


@dataclass(frozen=True)
class Contract:
    """What a requested cube must say: dimensions in order, the categories that each may and must have, the form of its periods, its size."""

    dimensions: tuple[str, ...]
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    required: dict[str, tuple[str, ...]] = field(default_factory=dict)
    period: str | None = None
    period_form: str = "^[0-9]{4}$"
    labelled: tuple[str, ...] = ()
    most: int = 10_000
    flag_size: int = 60


def _by_position(text: Column, kind: str) -> Column:
    """A JSON object or array of values by position as a map of positions; null where it is neither."""
    listed = F.from_json(text, f"array<{kind}>")
    named = F.from_json(text, f"map<string,{kind}>")
    as_map = F.map_from_entries(F.transform(F.filter(F.transform(listed, lambda v, i: F.struct(i.cast("long").alias("p"), v.alias("v"))), lambda e: e["v"].isNotNull()), lambda e: e))
    keyed = F.map_from_entries(F.transform(F.filter(F.map_entries(named), lambda e: e["value"].isNotNull()), lambda e: F.struct(F.coalesce(e["key"].try_cast("long"), F.lit(-1).cast("long")).alias("p"), e["value"].alias("v"))))
    return F.when(F.ltrim(text).startswith("["), as_map).otherwise(keyed)


def published(cubes: DataFrame, *, id_col: str = "cube_id", text_col: str = "body") -> DataFrame:
    """(cube_id, class, version, updated, ids, size, categories, labels, values, flags) of cubes published as JSON text, one row each.

    Categories stand in the order of their index, which may be a list of codes or an object of positions; a place without a category is null. Values and flags are by position,
    each a list or an object; a key that is no number becomes position -1. A text that is no JSON object has nulls throughout.
    """
    schema = "class string, version string, updated string, id array<string>, size array<long>, dimension map<string,struct<category:struct<index:string,label:map<string,string>>>>, value string, status string"
    j = cubes.select(F.col(id_col).alias("cube_id"), F.from_json(text_col, schema).alias("j")).select("cube_id", "j.*")
    category = lambda d: F.try_element_at("dimension", d)["category"]

    def ordered(d: Column, size: Column) -> Column:
        index = category(d)["index"]
        places = F.from_json(index, "map<string,long>")
        at = lambda i: F.get(F.map_keys(F.map_filter(places, lambda _, v: v == i)), F.lit(0))
        places_wide = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.least(size, F.lit(1_000_000)), F.size(places).cast("long"), F.lit(1).cast("long")) - 1), at)
        return F.when(F.ltrim(index).startswith("["), F.from_json(index, "array<string>")).otherwise(F.when(places.isNotNull(), places_wide))

    return j.select(
        "cube_id", "class", "version", "updated", F.col("id").alias("ids"), "size",
        F.transform("id", lambda d, i: ordered(d, F.coalesce(F.get("size", i), F.lit(0).cast("long")))).alias("categories"), F.transform("id", lambda d: category(d)["label"]).alias("labels"),
        F.coalesce(_by_position(F.col("value"), "double"), F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<double>"))).alias("values"), F.coalesce(_by_position(F.col("status"), "string"), F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<string>"))).alias("flags"),
    )


def _cells(size: Column | str) -> Column:
    """The number of cells; a product that would not fit is as good as infinite."""
    return F.aggregate(size, F.lit(1.0), lambda a, x: a * x)


def violations(cubes: DataFrame, contract: Contract) -> DataFrame:
    """(cube_id, code, detail): everything in which published cubes break a contract, as rows; no job is run and nothing is raised."""
    found = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    one = lambda wrong, code, detail: F.when(wrong, F.array(found(code, detail))).otherwise(F.array())
    each = lambda values, code: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: found(code, v))
    place = {d: i for i, d in enumerate(contract.dimensions)}
    own = lambda d: F.get("categories", F.lit(place[d]))
    cube = (F.col("class") == "dataset") & F.coalesce(F.col("version").startswith("2."), F.lit(False))
    order = F.coalesce(F.col("ids") == F.array(*map(F.lit, contract.dimensions)), F.lit(False))
    sound = F.coalesce(F.size("ids") == F.size("size"), F.lit(False)) & F.coalesce(F.forall(F.arrays_zip(F.col("categories").alias("c"), F.col("size").alias("s")), lambda z: F.coalesce(F.size(z["c"]) == z["s"], F.lit(False)) & ~F.exists(z["c"], lambda x: x.isNull()) & (F.size(F.array_distinct(z["c"])) == z["s"])), F.lit(False))
    total = _cells("size")
    checks = [
        one(~F.coalesce(cube, F.lit(False)), "drift", F.concat_ws(" ", F.coalesce("class", F.lit("?")), F.coalesce("version", F.lit("?")))),
        one(F.coalesce(cube, F.lit(False)) & ~order, "dimensions", F.array_join("ids", ",")),
        one(~F.coalesce(F.col("updated").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d"), F.lit(False)), "updated", F.coalesce("updated", F.lit(""))),
    ]
    inside = [one(~sound, "sizes", F.array_join(F.col("size").cast("array<string>"), ",")), one(total > contract.most, "cells", total.cast("long"))]
    for d, values in contract.allowed.items():
        inside.append(each(F.array_compact(F.array_except(own(d), F.array(*map(F.lit, values)))), f"unexpected_{d}"))
    for d, values in contract.required.items():
        inside.append(each(F.array_except(F.array(*map(F.lit, values)), own(d)), f"missing_{d}"))
    if contract.period:
        inside.append(each(F.filter(own(contract.period), lambda t: ~t.rlike(contract.period_form)), "period"))
    for d in contract.labelled:
        labels = F.get("labels", F.lit(place[d]))
        inside.append(each(F.filter(own(d), lambda c: F.coalesce(F.trim(F.try_element_at(labels, c)), F.lit("")) == ""), f"unlabelled_{d}"))
    numbers = F.map_values("values")
    inside += [
        each(F.transform(F.filter(F.map_keys("values"), lambda p: (p < 0) | (p >= total)), lambda p: p.cast("string")), "position"),
        one(F.exists(numbers, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "value", F.lit("not a finite number")),
        each(F.filter(F.map_values("flags"), lambda f: F.length(f) > contract.flag_size), "flag"),
        one(F.size("values") == 0, "empty", F.lit("no value")),
    ]
    nothing = F.array().cast("array<struct<code:string,detail:string>>")
    every = F.concat(*(c.cast("array<struct<code:string,detail:string>>") for c in checks), F.when(order, F.concat(*(c.cast("array<struct<code:string,detail:string>>") for c in inside))).otherwise(nothing))
    return cubes.select("cube_id", F.inline(every))


def cells(cubes: DataFrame) -> DataFrame:
    """(cube_id, position, coordinates, value, state, flag) of published cubes, one row a cell, for any number of dimensions.

    A position is a number in mixed radix whose digits are places in the dimensions, the last one changing fastest. coordinates maps a dimension to its category. Absent cells are ``missing``, never zero; they
    may have a flag. A cube whose arrays do not fit together has no cells.
    """
    fits = (F.size("ids") == F.size("size")) & (F.size("ids") == F.size("categories")) & (_cells("size") >= 1) & (_cells("size") < 2**31)
    total = F.aggregate("size", F.lit(1).cast("long"), lambda a, x: a * x)
    stride = lambda i: F.aggregate(F.slice("size", i + 2, F.size("size")), F.lit(1).cast("long"), lambda a, x: a * x)
    rows = cubes.where(F.coalesce(fits, F.lit(False))).select("*", F.transform("size", lambda _, i: stride(i)).alias("strides"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("position"))
    names = F.transform("categories", lambda c, i: F.get(c, F.pmod(F.floor(F.col("position") / F.get("strides", i)), F.get("size", i)).cast("int")))
    value = F.try_element_at("values", F.col("position"))
    return rows.select("cube_id", "position", F.map_from_arrays("ids", names).alias("coordinates"), value.alias("value"), F.when(value.isNull(), "missing").otherwise("measured").alias("state"), F.coalesce(F.try_element_at("flags", F.col("position")), F.lit("")).alias("flag"))


def accepted(cubes: DataFrame, contract: Contract) -> DataFrame:
    """The cubes without a violation."""
    return cubes.join(violations(cubes, contract).select("cube_id").distinct(), "cube_id", "left_anti")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(coordinates..., change, old_value, value) of cells that two releases have: first, same, changed, flag, appeared, disappeared.

    old, new: (key, value, flag), one row a cell, key naming its coordinates.
    """
    both = old.select("key", F.col("value").alias("old_value"), F.col("flag").alias("old_flag"), F.lit(True).alias("was")).join(new.select("key", "value", "flag", F.lit(True).alias("is")), "key", "full")
    change = (
        F.when(F.col("was").isNull(), "first").when(F.col("is").isNull(), "gone").when(F.col("old_value").isNull() & F.col("value").isNotNull(), "appeared").when(F.col("old_value").isNotNull() & F.col("value").isNull(), "disappeared")
        .when(~F.col("old_value").eqNullSafe(F.col("value")), "changed").when(~F.col("old_flag").eqNullSafe(F.col("flag")), "flag").otherwise("same")
    )
    return both.select("key", change.alias("change"), "old_value", "value")
