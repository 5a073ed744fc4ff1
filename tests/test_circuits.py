"""The stream of circuits against the same circuits from the whole log."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsloom.streaming import circuits as C

SCHEMA = "source string, run long, at timestamp, status string, failure string"
START = datetime.datetime(2024, 1, 1)


def hour(h):
    return START + datetime.timedelta(hours=h)


def streamed(spark, folder, batches, policy, late="0 seconds"):
    """All changes, with a stream that is stopped and started again after each batch."""
    C.with_timers(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = C.circuit_stream(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), policy, late)
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return spark.read.parquet(f"{folder}/out")


def test_circuits_by_hand(spark):
    t, p = C.TRANSIENT, C.PLATFORM
    rows = [("ok", 1, hour(0), "COMPLETED", None), ("two", 1, hour(0), "FAILED", t), ("two", 2, hour(1), "FAILED", t), ("three", 1, hour(0), "COMPLETED", None), *(("three", i, hour(i), "FAILED", t) for i in (2, 3, 4)),
            *(("cold", i, hour(i), "FAILED", t) for i in (1, 2, 9)), ("perm", 1, hour(0), "FAILED", "AUTH_FAILURE"), ("perm", 2, hour(1), "FAILED", t), ("plat", 1, hour(0), "FAILED", p), ("none", 1, hour(0), "FAILED", None),
            ("healed", 1, hour(0), "FAILED", "AUTH_FAILURE"), ("healed", 2, hour(1), "COMPLETED", None), ("run", 1, hour(2), "RUNNING", None)]
    got = {r["source"]: (r["state"], r["failures"], r["probe_after"]) for r in C.circuits(spark.createDataFrame(rows + rows[:3], SCHEMA), hour(11)).collect()}
    assert got == {"ok": ("CLOSED", 0, None), "two": ("CLOSED", 2, None), "three": ("HALF_OPEN", 3, hour(10)), "cold": ("OPEN", 3, hour(15)), "perm": ("OPEN", 2, None), "plat": ("CLOSED", 1, None), "none": ("OPEN", 1, None), "healed": ("CLOSED", 0, None), "run": ("CLOSED", 0, None)}


def test_timer_opens_the_probe(spark, tmp_path):
    """The cooldown passes without a run of the source; replays change nothing; idle state goes."""
    policy = C.Policy(forget_ms=100 * 3_600_000)
    a = [("a", i, hour(i), "FAILED", C.TRANSIENT) for i in (1, 2, 3)]
    other = lambda n, h: [("b", n, hour(h), "COMPLETED", None)]
    out = streamed(spark, tmp_path, [a, a[1:] + other(1, 5), other(2, 10), other(3, 12), other(4, 150), other(5, 151)], policy)
    got = [(r["at"], r["state"], r["failures"]) for r in out.where("source = 'a'").orderBy("at").collect()]
    assert got == [(hour(1), "CLOSED", 1), (hour(2), "CLOSED", 2), (hour(3), "OPEN", 3), (hour(9), "HALF_OPEN", 3), (hour(103), "FORGOTTEN", 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_log(spark, tmp_path, seed):
    rng, runs, clock = random.Random(seed), [], 0.0
    count = dict.fromkeys("abcdef", 0)
    for _ in range(150):
        clock += rng.random() * 1.5
        s = rng.choice("abcdef")
        count[s] += 1
        status = rng.choice(["COMPLETED", "FAILED", "FAILED", "FAILED", "RUNNING"])
        runs.append((s, count[s], hour(clock), status, rng.choice([C.TRANSIENT] * 8 + [C.PLATFORM, "UNKNOWN"]) if status == "FAILED" else None))
    end = hour(clock + 1)
    cuts = sorted(rng.sample(range(1, len(runs)), 3))
    parts = [runs[a:b] for a, b in zip([0, *cuts], [*cuts, len(runs)])]
    parts[2] = parts[2] + parts[1][:10]  # a replay
    last = [("clock", 1, end, "COMPLETED", None)], [("clock", 2, end + datetime.timedelta(seconds=1), "COMPLETED", None)]
    out = streamed(spark, tmp_path, [*parts, *last], C.Policy())
    newest = {r["source"]: tuple(r["c"]) for r in out.where("source <> 'clock'").groupBy("source").agg(F.max_by(F.struct("state", "failures"), "at").alias("c")).collect()}
    expected = {r["source"]: (r["state"], r["failures"]) for r in C.circuits(spark.createDataFrame(runs, SCHEMA), end).collect()}
    assert expected == newest and len(set(expected.values())) > 2
