"""Published cubes of six dimensions and their mutated variants."""

import copy
import itertools
import json

import pytest

from newsloom.sources import cubes as C

DIMS = {"freq": ["A"], "unit": ["YR"], "sex": ["T", "M", "F"], "age": ["Y_LT1", "Y65"], "geo": ["EU", "DE", "TR"], "time": ["2022", "2023", "2024"]}
CONTRACT = C.Contract(tuple(DIMS), {"freq": ("A",), "sex": ("T", "M", "F"), "geo": ("EU", "DE", "TR")}, {"geo": ("EU", "DE", "TR"), "sex": ("T", "M", "F")}, "time", labelled=("geo",))


def base():
    j = {"class": "dataset", "version": "2.0", "updated": "2026-09-25T23:00:00+0200", "id": list(DIMS), "size": [len(v) for v in DIMS.values()]}
    j["dimension"] = {d: {"category": {"index": {c: i for i, c in enumerate(v)}, "label": {c: f"label {c}" for c in v}}} for d, v in DIMS.items()}
    n = len(list(itertools.product(*DIMS.values())))
    j["value"] = {str(i): 70 + i / 10 for i in range(n) if i % 7}
    j["status"] = {"0": "b", "5": "e"}
    return j


def mutated(change):
    j = copy.deepcopy(base())
    change(j)
    return j


def drop_geo(j):
    j["dimension"]["geo"]["category"]["index"] = {"EU": 0, "DE": 1}
    j["size"][4] = 2


VARIANTS = {
    "sound": (base(), set()),
    "lists": (mutated(lambda j: (j["dimension"]["geo"]["category"].update(index=["EU", "DE", "TR"]), j.update(value=[None if i % 7 == 0 else 70 + i / 10 for i in range(54)], status=["b"]))), set()),
    "order": (mutated(lambda j: j.update(id=["unit", "freq", "sex", "age", "geo", "time"])), {("dimensions", "unit,freq,sex,age,geo,time")}),
    "geo": (mutated(lambda j: j["dimension"]["geo"]["category"].update(index={"EU": 0, "DE": 1, "FR": 2}, label={"EU": "a", "DE": "b", "FR": ""})), {("unexpected_geo", "FR"), ("missing_geo", "TR"), ("unlabelled_geo", "FR")}),
    "coverage": (mutated(drop_geo), {("missing_geo", "TR"), *(("position", str(i)) for i in range(36, 54) if i % 7)}),
    "sizes": (mutated(lambda j: j["dimension"]["sex"]["category"].update(index={"T": 0, "M": 2, "F": 2})), {("sizes", "1,1,3,2,3,3"), ("missing_sex", "F")}),
    "cells": (mutated(lambda j: j["size"].__setitem__(5, 3000)), {("sizes", "1,1,3,2,3,3000"), ("cells", "54000")}),
    "position": (mutated(lambda j: j["value"].update({"99": 1.0, "x": 2.0})), {("position", "99"), ("position", "-1")}),
    "period": (mutated(lambda j: j["dimension"]["time"]["category"].update(index={"2022": 0, "2023": 1, "2024-Q1": 2})), {("period", "2024-Q1")}),
    "updated": (mutated(lambda j: j.update(updated="yesterday")), {("updated", "yesterday")}),
    "flag": (mutated(lambda j: j["status"].update({"3": "f" * 61})), {("flag", "f" * 61)}),
    "empty": (mutated(lambda j: j.update(value={})), {("empty", "no value")}),
    "bundle": ({"class": "bundle", "version": "1.0"}, {("drift", "bundle 1.0"), ("updated", "")}),
    "text": ("not json", {("drift", "? ?"), ("updated", "")}),
}


@pytest.fixture(scope="module")
def cubes(spark):
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, (v, _) in VARIANTS.items()] + [("none", None)]
    return C.published(spark.createDataFrame(rows, "cube_id string, body string")).cache()


def test_violations_are_rows(cubes):
    got = {}
    for r in C.violations(cubes, CONTRACT).collect():
        got.setdefault(r["cube_id"], set()).add((r["code"], r["detail"]))
    assert got.pop("none") == {("drift", "? ?"), ("updated", "")}
    assert got == {k: v for k, (_, v) in VARIANTS.items() if v}
    assert {r["cube_id"] for r in C.accepted(cubes, CONTRACT).select("cube_id").collect()} == {"sound", "lists"}


@pytest.mark.parametrize("name", ["sound", "lists"])
def test_cells_in_mixed_radix(cubes, name):
    got = {tuple(r["coordinates"][d] for d in DIMS): (r["position"], r["value"], r["state"], r["flag"]) for r in C.cells(cubes.where(f"cube_id = '{name}'")).collect()}
    expected = {}
    for i, at in enumerate(itertools.product(*DIMS.values())):
        flag = {0: "b", 5: "e"}.get(i, "") if name == "sound" else "b" if i == 0 else ""
        expected[at] = (i, 70 + i / 10 if i % 7 else None, "measured" if i % 7 else "missing", flag)
    assert got == expected


def test_cells_of_other_shapes(spark):
    """One dimension, nine dimensions, and arrays that do not fit."""
    def cube(sizes):
        ids = [f"d{i}" for i in range(len(sizes))]
        return {"class": "dataset", "version": "2.0", "id": ids, "size": sizes, "dimension": {d: {"category": {"index": {f"{d}{x}": x for x in range(s)}}} for d, s in zip(ids, sizes)}, "value": {"1": 5}}

    wrong = cube([2, 2]) | {"size": [2]}
    df = spark.createDataFrame([(n, json.dumps(c)) for n, c in (("one", cube([3])), ("nine", cube([1, 2, 1, 2, 3, 1, 1, 2, 2])), ("wrong", wrong))], "cube_id string, body string")
    rows = C.cells(C.published(df)).collect()
    assert sum(r["cube_id"] == "one" for r in rows) == 3 and sum(r["cube_id"] == "nine" for r in rows) == 48 and not any(r["cube_id"] == "wrong" for r in rows)
    assert [r["coordinates"]["d0"] for r in rows if r["cube_id"] == "one" and r["value"] == 5] == ["d01"]


def test_revisions(spark):
    old = spark.createDataFrame([("a", 1.0, ""), ("b", None, ""), ("c", 2.0, ""), ("d", 3.0, ""), ("e", 4.0, ""), ("g", None, "")], "key string, value double, flag string")
    new = spark.createDataFrame([("a", 1.0, ""), ("b", 2.0, ""), ("c", None, ""), ("d", 3.0, "e"), ("e", 5.0, "x"), ("f", 1.0, ""), ("g", None, "")], "key string, value double, flag string")
    assert {r["key"]: r["change"] for r in C.revisions(old, new).collect()} == {"a": "same", "b": "appeared", "c": "disappeared", "d": "flag", "e": "changed", "f": "first", "g": "same"}
