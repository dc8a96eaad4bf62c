"""Streaming twins of the event operators: sequence and run counters, run states and sessions by keyed state, tumbling
counts by watermark. Events that come again are dropped in the JVM before keyed state sees them; a key's state is read and
written once a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodegraph.operators.events import PHASES

SEEN = "24 hours"
STATE = "seq long, total double"
RUN_VALUE = "phase string, finished boolean, error string, findings long, accepted long, rejected long, last_seq long"
RUN_STATE = "run_id string, phase string, finished boolean, error string, findings long, accepted long, rejected long, touched array<string>, verified array<string>, last_seq long"
OUT = "run_id long, seq long, event_id long, type string, total double"


class RunFold(StatefulProcessor):
    """Gives each event of a run its sequence number and the run's running total, in order of (ts, event_id) inside a
    batch; the state of a run is one row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(rows).sort_values(["ts", "event_id"])
        seq, total = self.state.get() or (0, 0.0)
        sums = total + pdf["value"].cumsum().to_numpy()
        self.state.update((int(seq + len(pdf)), float(sums[-1])))
        yield pd.DataFrame({"run_id": key[0], "seq": range(seq + 1, seq + 1 + len(pdf)), "event_id": pdf["event_id"].to_numpy(), "type": pdf["type"].to_numpy(), "total": sums})

    def close(self) -> None:
        pass


class RunState(StatefulProcessor):
    """The state of each run after each batch, as operators.events.fold gives it for the whole log: events at or before
    the last sequence number are repeats and change nothing. A run's counters are one row, its targets an entry each, of
    which a batch writes only those that are new. With ttl_ms, a run that has been still for so long is forgotten."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", RUN_VALUE, ttlDurationMs=self.ttl_ms)
        self.targets = handle.getMapState("targets", "target string", "touched boolean, verified boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(rows).drop_duplicates("seq").sort_values("seq").astype(object)
        pdf = pdf.where(pdf.notna(), None)
        phase, finished, error, findings, accepted, rejected, last_seq = self.state.get() or (None, False, None, 0, 0, 0, 0)
        held = {k[0]: (v[0], v[1]) for k, v in self.targets.iterator()}
        marks = dict(held)
        for e in pdf[pdf["seq"] > last_seq].to_dict("records"):
            kind, boss, target = e["type"], e["agent"] == "supervisor", e["target"]
            if boss and kind in ("done", "error") and e["terminal"]:
                finished, phase = True, kind
            elif kind == "phase" and e["phase"] in PHASES:
                phase = e["phase"]
            if boss and kind == "error" and error is None:
                error = e["message"]
            hit = kind == "verdict" and e["verdict"] == "accepted"
            findings, accepted, rejected = findings + (kind == "finding"), accepted + hit, rejected + (kind == "verdict" and not hit)
            if target is not None and (hit or kind in ("tool_call", "finding")):
                touched, verified = marks.get(target, (False, False))
                marks[target] = (touched or kind in ("tool_call", "finding"), verified or hit)
            last_seq = int(e["seq"])
        for target, mark in marks.items():
            if held.get(target) != mark:
                self.targets.updateValue((target,), mark)
        now = (phase, finished, error, int(findings), int(accepted), int(rejected), last_seq)
        self.state.update(now)
        row = dict(zip(("phase", "finished", "error", "findings", "accepted", "rejected", "last_seq"), now, strict=True))
        row |= {"touched": sorted(t for t, m in marks.items() if m[0]), "verified": sorted(t for t, m in marks.items() if m[1])}
        yield pd.DataFrame([{"run_id": key[0], **row}])[[c.split()[0] for c in RUN_STATE.split(", ")]]

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """A key's sessions, each given out once the watermark has passed its end, and forgotten then. State is one value a key,
    the first and last times (in microseconds) and numbers of events of its open sessions, read and written once a call; a
    timer stands at the end of the earliest of them alone."""

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _held(self) -> np.ndarray:
        """Three rows, first, last and n, in order of time."""
        held = self.open.get()
        return np.frombuffer(held[0], np.int64).reshape(3, -1) if held else np.zeros((3, 0), np.int64)

    def _keep(self, sessions: np.ndarray, timer: bool) -> None:
        self.open.update((sessions.tobytes(),))
        if timer:
            self.handle.registerTimer(-(-(int(sessions[1, 0]) + self.gap_us) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = np.concatenate([pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy() for pdf in rows])
        held = self._held()
        first, last, n = np.concatenate([held, [times, times, np.ones_like(times)]], axis=1)
        order = np.argsort(first, kind="stable")
        first, reach, n = first[order], np.maximum.accumulate(last[order]), n[order]
        begins = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1] + self.gap_us)))
        now = np.stack([first[begins], reach[np.append(begins[1:], len(first)) - 1], np.add.reduceat(n, begins)])
        self._keep(now, not held.size or held[1, 0] != now[1, 0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, passed = self._held(), timerValues.getCurrentWatermarkInMs() * 1000
        done = int(np.searchsorted(held[1], passed - self.gap_us, "right"))  # ends go up with begins
        if done:
            if done < held.shape[1]:
                self._keep(held[:, done:], True)
            else:
                self.open.clear()
            yield pd.DataFrame({"key": key[0], "first_us": held[0, :done], "end_us": held[1, :done] + self.gap_us, "n": held[2, :done]})

    def close(self) -> None:
        pass


def run_states(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of run states; the row with the greatest last_seq is a run's present one. events: run_id (string), seq,
    agent, type, phase, target, verdict, terminal, message. Needs the RocksDB state provider."""
    return events.groupBy("run_id").transformWithStateInPandas(statefulProcessor=RunState(ttl_ms), outputStructType=RUN_STATE, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def run_fold(events: DataFrame, seen: str = SEEN) -> DataFrame:
    """events: run_id, event_id, ts, type, value; a stream. An event that comes again within `seen` of the newest time is
    dropped, one that is older than that too. Needs the RocksDB state provider."""
    once = events.withWatermark("ts", seen).dropDuplicatesWithinWatermark(["run_id", "event_id"])
    return once.groupBy("run_id").transformWithStateInPandas(statefulProcessor=RunFold(), outputStructType=OUT, outputMode="Append", timeMode="None")


def closed_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """A stream of the sessions of each key (a long) that the watermark has passed: key, session_start, session_end, n, as
    operators.events.sessions gives them for the whole log. Events older than the watermark that the batch before left are dropped; sessions still
    open when the stream ends are not given. Needs the RocksDB state provider."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    out = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Sessions(gap_seconds * 1_000_000), outputStructType="key long, first_us long, end_us long, n long", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("first_us").alias("session_start"), F.timestamp_micros("end_us").alias("session_end"), "n")


def tumbling(events: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of a stream by window and type; events later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "type", "n")


def live(log: DataFrame, ts: str, run: str = "run_id", late: str = "1 hour") -> DataFrame:
    """A stream of the event log without repeats: backfill and live rows may overlap by up to the watermark, beyond which
    keys are forgotten, so that state is bounded."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark([run, "seq"])
