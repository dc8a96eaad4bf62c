"""Event-log queries, batch and streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import events as E
from lodegraph.plans.registry import query
from lodegraph.session import STATE_PROVIDER, shared_folder
from lodegraph.sources.tables import table
from lodegraph.streaming.fold import closed_sessions, run_fold

SEQ = "s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
#: The events read as a run's log: agents and payloads follow from type and id.
LOG = f"""{SEQ}, g AS (SELECT user_id AS run_id, seq, CASE WHEN event_type = 'purchase' AND event_id % 50 = 0 THEN 'supervisor' WHEN event_id % 3 = 0 THEN 'explorer' ELSE 'critic' END AS agent,
 CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'signup' THEN 'spawn' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'finding' ELSE 'verdict' END WHEN 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN 'done' ELSE 'phase' END ELSE 'error' END AS type,
 'explorer:' || (event_id % 4) AS label, ['planning', 'exploring', 'nonsense', 'critique'][event_id % 4 + 1] AS phase, 'n' || (event_id % 7) AS target, CASE WHEN event_id % 5 < 3 THEN 'accepted' ELSE 'rejected' END AS verdict, event_id % 100 = 0 AS terminal, 'm' || event_id AS message FROM s)"""


def _seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sequenced(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    boss = (t == "purchase") & (i % 50 == 0)
    kind = F.when(t == "view", "tool_call").when(t == "signup", "spawn").when(t == "click", F.when(i % 2 == 0, "finding").otherwise("verdict")).when(t == "purchase", F.when(i % 50 == 0, "done").otherwise("phase")).otherwise("error")
    n = lambda prefix, m: F.concat(F.lit(prefix), (i % m).cast("string"))
    return _seq(spark, sf_dir).select(
        F.col("user_id").alias("run_id"), "seq", F.when(boss, "supervisor").when(i % 3 == 0, "explorer").otherwise("critic").alias("agent"), kind.alias("type"), n("explorer:", 4).alias("label"),
        F.element_at(F.array(*[F.lit(p) for p in ("planning", "exploring", "nonsense", "critique")]), (i % 4 + 1).cast("int")).alias("phase"), n("n", 7).alias("target"),
        F.when(i % 5 < 3, "accepted").otherwise("rejected").alias("verdict"), (i % 100 == 0).alias("terminal"), F.concat(F.lit("m"), i.cast("string")).alias("message"),
    )


@query(f"WITH {SEQ} SELECT user_id, event_id, seq FROM s")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seq(spark, sf_dir).select("user_id", "event_id", "seq")


@query(f"WITH {SEQ} SELECT user_id, event_id, seq FROM s WHERE seq > 40")
def event_replay_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replay(_seq(spark, sf_dir), "user_id", 40).select("user_id", "event_id", "seq")


@query(f"WITH {SEQ} SELECT user_id, event_id, seq FROM s WHERE seq <= 25")
def replay_cursor_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replay(_seq(spark, sf_dir), "user_id", 0, 25).select("user_id", "event_id", "seq")


@query(f"WITH {SEQ} SELECT user_id, seq, event_id FROM s")
def event_dedup_by_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill and live rows overlap; each event comes out once."""
    s = _seq(spark, sf_dir).select("user_id", "seq", "event_id")
    return E.deduplicated(s.unionByName(s.where("seq > 20")), "user_id")


ENDS = "en AS (SELECT run_id, coalesce(bool_or(agent = 'supervisor' AND type IN ('done', 'error') AND terminal), false) AS finished FROM g GROUP BY run_id)"


@query(f"WITH {LOG} SELECT run_id, count(*) FILTER (type = 'finding') AS findings, count(*) FILTER (type = 'verdict' AND verdict = 'accepted') AS accepted, count(*) FILTER (type = 'verdict' AND verdict <> 'accepted') AS rejected, max(seq) AS last_seq FROM g GROUP BY run_id")
def run_totals_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fold(_log(spark, sf_dir)).select("run_id", "findings", "accepted", "rejected", "last_seq")


@query(f"WITH {LOG}, {ENDS} SELECT g.run_id, arg_max(CASE WHEN agent = 'supervisor' AND type = 'done' AND terminal THEN 'done' WHEN agent = 'supervisor' AND type = 'error' AND terminal THEN 'error' ELSE phase END, seq) FILTER ((agent = 'supervisor' AND type IN ('done', 'error') AND terminal) OR (type = 'phase' AND phase <> 'nonsense')) AS phase, any_value(finished) AS finished, arg_min(message, seq) FILTER (agent = 'supervisor' AND type = 'error') AS error FROM g JOIN en USING (run_id) GROUP BY g.run_id")
def run_terminal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fold(_log(spark, sf_dir)).select("run_id", "phase", "finished", "error")


@query(f"WITH {LOG} SELECT run_id, coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (type IN ('tool_call', 'finding')), '') AS touched, coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (type = 'verdict' AND verdict = 'accepted'), '') AS verified FROM g GROUP BY run_id")
def touched_and_verified_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fold(_log(spark, sf_dir)).select("run_id", F.array_join("touched", ",").alias("touched"), F.array_join("verified", ",").alias("verified"))


@query(f"WITH {LOG} SELECT run_id, seq, last_value(CASE WHEN type = 'phase' THEN phase END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS current FROM g")
def run_phase_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).withColumn("shown", F.when(F.col("type") == "phase", F.col("phase")))
    return E.carried_forward(rows, "run_id", "shown", "current").select("run_id", "seq", "current")


@query(f"""WITH {LOG}, {ENDS}, c AS (SELECT run_id, CASE WHEN agent = 'explorer' THEN label ELSE agent END AS card, min(agent) AS role, arg_max(CASE type WHEN 'spawn' THEN 'working' WHEN 'done' THEN 'done' ELSE 'failed' END, seq) FILTER (type IN ('spawn', 'done', 'error')) AS state, count(*) FILTER (type = 'tool_call') AS tool_calls, count(*) FILTER (type = 'finding') AS findings FROM g WHERE agent <> 'supervisor' GROUP BY 1, 2)
SELECT run_id, card, role, CASE role WHEN 'explorer' THEN 1 ELSE 3 END AS role_rank, CASE WHEN finished AND state = 'working' THEN 'done' ELSE state END AS state, tool_calls, findings FROM c JOIN en USING (run_id)""")
def agent_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cards(_log(spark, sf_dir)).orderBy("run_id", "role_rank", "card")


@query(f"WITH {LOG} SELECT run_id, seq, target, verdict FROM g WHERE type = 'verdict'")
def verdict_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("type = 'verdict'").orderBy("run_id", F.col("seq").desc()).select("run_id", "seq", "target", "verdict")


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM i GROUP BY user_id, k""")
def session_windows_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH p AS (SELECT event_type, value, CAST(regexp_extract(props, '"k":\\s*([0-9]+)', 1) AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS calls, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS output_tokens, round(sum(CASE WHEN event_type <> 'error' THEN value END), 6) AS usd FROM p GROUP BY event_type""".replace("\\\\", "\\"))
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodegraph.operators.evals import ledger

    k = F.get_json_object("props", "$.k").cast("long")
    calls = table(spark, sf_dir, "events").select("event_type", k.alias("input_tokens"), (k * 2).alias("output_tokens"), F.when(F.col("event_type") != "error", F.col("value")).alias("usd"))
    return ledger(calls, "event_type")


@query("SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type AS type, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def stream_run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream, through keyed state, into a Parquet sink; the sink is what is read."""
    plan = lambda log: run_fold(log.select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), "value"))
    return _streamed(spark, sf_dir, plan, "stream-run-fold").withColumn("total", F.round("total", 4))


def _streamed(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What plan makes of the events as a stream, out of its Parquet sink."""
    schema = table(spark, sf_dir, "events").schema
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
        plan(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(out)


@query("""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o),
s AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM i GROUP BY user_id, k)
SELECT * FROM s WHERE session_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that event-time timers have closed by the end of the stream."""
    rows = _streamed(spark, sf_dir, lambda log: closed_sessions(log, "user_id", "ts"), "stream-sessions")
    return rows.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
