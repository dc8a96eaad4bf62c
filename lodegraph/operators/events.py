"""Event logs: sequence, replay, and the fold of a run's events to its state (batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("cloning", "parsing", "summarizing", "communities", "planning", "exploring", "synthesis", "critique", "writing")
ROLES = ("planner", "explorer", "synthesizer", "critic", "librarian", "supervisor")


def sequenced(events: DataFrame, run: str, *order: str) -> DataFrame:
    """events with seq: 1, 2, ... within a run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long"))


def replay(events: DataFrame, run: str, after: int = 0, until: int | None = None) -> DataFrame:
    rows = events.where(F.col("seq") > after)
    return (rows if until is None else rows.where(F.col("seq") <= until)).orderBy(run, "seq")


def deduplicated(events: DataFrame, run: str) -> DataFrame:
    return events.dropDuplicates([run, "seq"])


def carried_forward(events: DataFrame, run: str, value: str, name: str) -> DataFrame:
    """The last value that was not null, at each event."""
    return events.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(run).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def fold(events: DataFrame) -> DataFrame:
    """State of each run: run_id, phase, finished, error, findings, accepted, rejected, touched, verified, last_seq.

    events: run_id, seq, agent, type, label, phase, target, verdict, terminal, message. Counters and sets are plain
    aggregates; last values are those of the greatest seq. Unknown phases are ignored. A supervisor's terminal done or
    error finishes a run; its first error that is not terminal is kept.
    """
    t, boss = F.col("type"), F.col("agent") == "supervisor"
    end = boss & t.isin("done", "error") & F.coalesce("terminal", F.lit(False))
    phase = F.when(end & (t == "error"), F.lit("error")).when(end, F.lit("done")).when((t == "phase") & F.col("phase").isin(*PHASES), F.col("phase"))
    hit = (t == "verdict") & (F.col("verdict") == "accepted")
    first_error = F.min(F.when(boss & (t == "error"), F.struct("seq", "message")))
    return events.groupBy("run_id").agg(
        F.max_by(phase, F.when(phase.isNotNull(), F.col("seq"))).alias("phase"), F.coalesce(F.bool_or(end), F.lit(False)).alias("finished"), first_error["message"].alias("error"),
        F.count_if(t == "finding").alias("findings"), F.count_if(hit).alias("accepted"), F.count_if((t == "verdict") & ~hit).alias("rejected"),
        F.array_sort(F.collect_set(F.when(t.isin("tool_call", "finding"), F.col("target")))).alias("touched"), F.array_sort(F.collect_set(F.when(hit, F.col("target")))).alias("verified"),
        F.max("seq").alias("last_seq"),
    )


def cards(events: DataFrame) -> DataFrame:
    """run_id, card, role, state, tool_calls, findings: one row an agent (an explorer's label); ordered by role then card.
    Cards still working when their run finishes are done."""
    card = F.when((F.col("agent") == "explorer") & F.col("label").isNotNull(), F.col("label")).otherwise(F.col("agent"))
    state = F.when(F.col("type") == "spawn", "working").when(F.col("type") == "done", "done").when(F.col("type") == "error", "failed")
    ends = events.groupBy("run_id").agg(F.coalesce(F.bool_or((F.col("agent") == "supervisor") & F.col("type").isin("done", "error") & F.coalesce("terminal", F.lit(False))), F.lit(False)).alias("finished"))
    rows = events.where("agent <> 'supervisor'").groupBy("run_id", card.alias("card")).agg(
        F.min("agent").alias("role"), F.max_by(state, F.when(state.isNotNull(), F.col("seq"))).alias("state"), F.count_if(F.col("type") == "tool_call").alias("tool_calls"), F.count_if(F.col("type") == "finding").alias("findings")
    )
    rank = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(ROLES)], F.lit(len(ROLES)))
    out = rows.join(ends, "run_id").withColumn("state", F.when(F.col("finished") & (F.col("state") == "working"), "done").otherwise(F.col("state")))
    return out.withColumn("role_rank", rank).select("run_id", "card", "role", "role_rank", "state", "tool_calls", "findings")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "1 hour") -> DataFrame:
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
