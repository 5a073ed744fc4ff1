"""Circuits of sources as stream state with timers, and the same circuits from a whole log.

A failed run counts on from the last completed one. A permanent failure opens the circuit at once, and only a completed run closes it; transient
failures open it from ``open_after`` on, until ``cooldown`` after the last failure, when one probe may run (HALF_OPEN). Platform failures
count, but are no reason to open at once. Runs are known by their number: one at or before the last one seen is a replay.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Classes of failures that pass by themselves, or say nothing of the source.
TRANSIENT, PLATFORM = "TRANSIENT_SOURCE_FAILURE", "PLATFORM_FAILURE"
OUT = "source string, at timestamp, state string, failures int, probe_after timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    open_after: int = 3
    cooldown_ms: int = 6 * 3_600_000
    forget_ms: int = 90 * 86_400_000  # a source without runs for so long has no state


def _ms(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


def _time(ms: int | None) -> pd.Timestamp | None:
    return None if ms is None else pd.Timestamp(ms, unit="ms")


class Circuit(StatefulProcessor):
    """One source's circuit; emits a row for its first run and whenever its state or its failures in a row change."""

    def __init__(self, policy: Policy):
        self.p = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("circuit", "run long, failures int, permanent boolean, failed_at long, seen_at long, state string")

    def _load(self) -> list:
        return list(self.own.get()) if self.own.exists() else [-1, 0, False, 0, 0, "CLOSED"]

    def _emit(self, source: str, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(source, _time(at), state, n, _time(probe)) for at, state, n, probe in rows], columns=["source", "at", "state", "failures", "probe_after"])

    def _half_open(self, s: list, now: int) -> list[tuple]:
        probe = s[3] + self.p.cooldown_ms
        if s[5] == "OPEN" and not s[2] and probe <= now:
            s[5] = "HALF_OPEN"
            return [(probe, "HALF_OPEN", s[1], probe)]
        return []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        new = pd.concat(list(rows)).sort_values("run")
        for run, at, status, failure in zip(new["run"], new["at"], new["status"], new["failure"], strict=True):
            if run <= s[0]:
                continue
            now = _ms(at)
            out += self._half_open(s, now)
            before = s[0], s[1], s[5]
            if status == "COMPLETED":
                s = [int(run), 0, False, 0, now, "CLOSED"]
            elif status == "FAILED":
                permanent = bool(s[2]) or failure not in (TRANSIENT, PLATFORM)
                n = s[1] + 1
                s = [int(run), n, permanent, now, now, "OPEN" if permanent or n >= self.p.open_after else "CLOSED"]
            else:
                s = [int(run), *s[1:4], now, s[5]]
            if before[0] < 0 or (s[1], s[5]) != before[1:]:
                out.append((now, s[5], s[1], s[3] + self.p.cooldown_ms if s[5] == "OPEN" and not s[2] else None))
        self._timers(s)
        self.own.update(tuple(s))
        yield from self._emit(key[0], out)

    def _timers(self, s: list) -> None:
        """One timer for the probe of an open circuit, one for forgetting; older ones go."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s[5] == "OPEN" and not s[2]:
            self.handle.registerTimer(s[3] + self.p.cooldown_ms)
        self.handle.registerTimer(s[4] + self.p.forget_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        out = self._half_open(s, now)
        if now >= s[4] + self.p.forget_ms:
            self.own.clear()
            out.append((now, "FORGOTTEN", s[1], None))
        else:
            self.own.update(tuple(s))
        yield from self._emit(key[0], out)

    def close(self) -> None:
        pass


def circuit_stream(runs: DataFrame, policy: Policy | None = None, late: str = "0 seconds") -> DataFrame:
    """Changes of circuits (source, at, state, failures, probe_after) for a stream of runs (source, run, at, status, failure).

    Time is the runs' own: the probe opens, and idle state goes, when the watermark passes, without a run. The stream needs the store with timers: ``with_timers``.
    """
    timed = runs.withWatermark("at", late)
    return timed.groupBy("source").transformWithStateInPandas(Circuit(policy or Policy()), OUT, "Append", "EventTime")


def with_timers(spark: SparkSession) -> None:
    """Streams started from now on keep their state in the store that has timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def circuits(runs: DataFrame, now: datetime.datetime | str, policy: Policy | None = None) -> DataFrame:
    """(source, state, failures, probe_after) of each source at a moment, from its whole log: aggregates only.

    The streak is what failed after the last completed run. Runs at or before one seen are those of an equal number here, so they count once.
    """
    p = policy or Policy()
    past = runs.where(F.col("at") <= F.lit(now).cast("timestamp")).dropDuplicates(["source", "run"])
    last = past.groupBy("source").agg(F.max(F.when(F.col("status") == "COMPLETED", F.col("run"))).alias("good"))
    after = past.join(last, "source").where((F.col("status") == "FAILED") & (F.col("good").isNull() | (F.col("run") > F.col("good"))))
    own = after.groupBy("source").agg(F.count("*").cast("int").alias("failures"), F.max_by("at", "run").alias("failed_at"), F.bool_or(~F.coalesce(F.col("failure"), F.lit("UNKNOWN")).isin(TRANSIENT, PLATFORM)).alias("permanent"))
    probe = F.when(~F.col("permanent") & (F.col("failures") >= p.open_after), F.timestamp_millis(F.unix_millis("failed_at") + p.cooldown_ms))
    state = F.when(F.col("permanent"), "OPEN").when(probe.isNull(), "CLOSED").when(probe <= F.lit(now).cast("timestamp"), "HALF_OPEN").otherwise("OPEN")
    joined = last.select("source").join(own, "source", "left")
    return joined.select("source", F.when(F.col("failures").isNull(), "CLOSED").otherwise(state).alias("state"), F.coalesce("failures", F.lit(0)).alias("failures"), probe.alias("probe_after"))
