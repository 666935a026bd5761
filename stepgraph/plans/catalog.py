"""The registered queries over the star schema, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import guards as G
from ..functions import reducers as R
from ..functions.schemas import Schema, row_violations
from ..operators import admission as A
from ..operators import metrics as M
from ..operators import reach, store
from ..sources.snapshots import fresh_folder
from ..sources.tables import DAY, EVENTS, NOW, RUN_EVENTS, RUNS, VERSIONS, events_log, graph_versions, micros, run_events, runs, table
from ..streaming import fold
from ..streaming.shell import RunShell
from . import flows
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MAX_ATTEMPTS = 5
CUTOFF = 946_684_800_000_000  # 2000-01-01


def query(sql: str | None = None, *ctes: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


# Admission

_PAGES = f"""ready AS (SELECT id, 'ready' AS class, wake_at AS eligible_at, scope_key, tenant_admitted_at FROM runs
  WHERE status = 'running' AND poisoned_at IS NULL AND wake_at <= {NOW}),
expired AS (SELECT id, 'expired' AS class, claimed_at AS eligible_at FROM runs
  WHERE status = 'running' AND poisoned_at IS NULL AND claimed_at < {NOW - DAY})"""


def _legacy_sql(n: int, preference: str = "ready") -> str:
    head = "class_rank > 1" if n >= 2 else f"class <> '{preference}'"
    return f"""{_PAGES},
pages AS ((SELECT id, class, eligible_at FROM ready ORDER BY eligible_at, id LIMIT {n})
  UNION ALL (SELECT id, class, eligible_at FROM expired ORDER BY eligible_at, id LIMIT {n})),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY class ORDER BY eligible_at, id) AS INTEGER) AS class_rank FROM pages),
chosen AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY CAST({head} AS INTEGER), eligible_at, id) AS INTEGER) AS position
  FROM ranked) WHERE position <= {n})"""


_SCOPED = f"""{_PAGES},
scopes AS (SELECT scope_key FROM (SELECT DISTINCT scope_key FROM ready) ORDER BY md5(scope_key || '|0'), scope_key LIMIT 10),
inside AS (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY CASE WHEN tenant_admitted_at IS NULL THEN 1 ELSE 0 END, eligible_at, id) AS scope_rank
  FROM ready WHERE scope_key IN (SELECT scope_key FROM scopes)),
pages AS ((SELECT id, class, eligible_at, scope_rank FROM inside WHERE scope_rank <= 10 ORDER BY scope_rank, eligible_at, id LIMIT 10)
  UNION ALL (SELECT id, class, eligible_at, 1 AS scope_rank FROM expired ORDER BY eligible_at, id LIMIT 10)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY scope_rank, eligible_at, id) AS class_rank FROM pages),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY CAST(class_rank > 1 AS INTEGER), class_rank, eligible_at, id) AS position
  FROM ranked) WHERE position <= 10)"""
_CHOSEN = "SELECT id, class, eligible_at, class_rank, position FROM chosen"


@query(_CHOSEN, RUNS, _legacy_sql(50))
def claim_legacy(spark, d):
    return A.legacy(runs(spark, d), NOW, 50, DAY)


@query(_CHOSEN, RUNS, _legacy_sql(1))
def claim_legacy_prefer_ready(spark, d):
    return A.legacy(runs(spark, d), NOW, 1, DAY, "ready")


@query(_CHOSEN, RUNS, _legacy_sql(1, "expired"))
def claim_legacy_prefer_expired(spark, d):
    return A.legacy(runs(spark, d), NOW, 1, DAY, "expired")


@query("SELECT id, class, eligible_at, CAST(scope_rank AS INTEGER) AS scope_rank, CAST(class_rank AS INTEGER) AS class_rank, CAST(position AS INTEGER) AS position FROM chosen", RUNS, _SCOPED)
def claim_windowed(spark, d):
    return A.windowed(runs(spark, d), NOW, 10, DAY)


def _outcomes_sql(admit: str) -> str:
    return f"""SELECT id, run_id, class, CAST(position AS INTEGER) AS position,
  CASE WHEN claim_attempts < {MAX_ATTEMPTS} THEN 'leased' ELSE 'poisoned' END AS outcome,
  CASE WHEN claim_attempts < {MAX_ATTEMPTS} THEN sha256(run_id || '|' || checkpoint_seq || '|' || claim_attempts || '|b1') END AS claim_token,
  CASE WHEN claim_attempts < {MAX_ATTEMPTS} THEN {NOW} END AS claimed_at,
  CAST(CASE WHEN claim_attempts < {MAX_ATTEMPTS} THEN claim_attempts + 1 ELSE claim_attempts END AS INTEGER) AS claim_attempts,
  CASE WHEN claim_attempts >= {MAX_ATTEMPTS} THEN {NOW} END AS poisoned_at,
  CASE WHEN claim_attempts >= {MAX_ATTEMPTS} THEN '{A.POISON}' END AS poison_reason,
  {admit} AS tenant_admitted_at FROM runs JOIN (SELECT id, class, position FROM chosen) c USING (id)"""


@query(_outcomes_sql("tenant_admitted_at"), RUNS, _legacy_sql(50))
def claim_outcomes(spark, d):
    rows = runs(spark, d)
    return A.outcomes(rows, A.legacy(rows, NOW, 50, DAY), NOW, MAX_ATTEMPTS, "b1")


@query(_outcomes_sql(f"CASE WHEN claim_attempts < {MAX_ATTEMPTS} THEN coalesce(tenant_admitted_at, {NOW}) END"), RUNS, _SCOPED)
def claim_outcomes_windowed(spark, d):
    rows = runs(spark, d)
    return A.outcomes(rows, A.windowed(rows, NOW, 10, DAY), NOW, MAX_ATTEMPTS, "b1", admit=True)


@query(
    f"""SELECT class, candidates, coalesce(selected, 0) AS selected, CASE WHEN class = 'expired' THEN coalesce(selected, 0) ELSE 0 END AS steals, oldest_age FROM
  (SELECT class, count(*) AS candidates, {NOW} - min(eligible_at) AS oldest_age
   FROM (SELECT class, eligible_at FROM ready UNION ALL SELECT class, eligible_at FROM expired) GROUP BY class)
  LEFT JOIN (SELECT class, count(*) AS selected FROM chosen GROUP BY class) USING (class)""",
    RUNS,
    _legacy_sql(50),
)
def claim_stats(spark, d):
    rows = runs(spark, d)
    return A.stats(rows, NOW, DAY, A.legacy(rows, NOW, 50, DAY))


@query(f"SELECT id, greatest(claimed_at, {NOW}) AS claimed_at FROM runs WHERE claimed_at IS NOT NULL", RUNS)
def refresh_monotonic(spark, d):
    return A.refreshed(runs(spark, d).filter("claimed_at is not null"), NOW).select("id", "claimed_at")


@query(f"SELECT id, CAST(NULL AS VARCHAR) AS claim_token, CAST(NULL AS BIGINT) AS claimed_at, {NOW + 1} AS wake_at FROM runs WHERE claimed_at IS NOT NULL", RUNS)
def release(spark, d):
    return A.released(runs(spark, d).filter("claimed_at is not null"), NOW + 1).select("id", "claim_token", "claimed_at", "wake_at")


_ABANDON = f"""SELECT id, CASE WHEN claim_abandons + 1 >= 3 THEN 'poisoned' ELSE 'rescheduled' END AS outcome,
  CAST(claim_abandons + 1 AS INTEGER) AS claim_abandons, CAST(greatest(claim_attempts - 1, 0) AS INTEGER) AS claim_attempts,
  CASE WHEN claim_abandons + 1 < 3 THEN {NOW} + CAST(least(1000000 * pow(2, least(claim_abandons, 30)), 3000000) AS BIGINT) END AS wake_at,
  CASE WHEN claim_abandons + 1 >= 3 THEN 'max_claim_abandons_exceeded' END AS poison_reason FROM runs WHERE claimed_at IS NOT NULL"""


@query(_ABANDON, RUNS)
def abandon(spark, d):
    return A.abandoned(runs(spark, d).filter("claimed_at is not null"), NOW, 3, 1_000_000, 3_000_000)


@query(f"SELECT id, {NOW} AS wake_at, 0 AS claim_attempts, 0 AS claim_abandons FROM runs WHERE poisoned_at IS NOT NULL", RUNS)
def recover_poison(spark, d):
    return A.recovered(runs(spark, d), NOW)


_VIEW = f"""CASE WHEN poisoned_at IS NOT NULL THEN 'poisoned' WHEN claimed_at < {NOW - DAY} THEN 'recoverable'
  WHEN claimed_at IS NOT NULL THEN 'claimed' WHEN wake_at <= {NOW} THEN 'ready' WHEN wake_at IS NOT NULL THEN 'scheduled' ELSE status END"""


@query(f"SELECT {_VIEW} AS view, count(*) AS runs FROM runs GROUP BY 1", RUNS)
def queue_views(spark, d):
    return runs(spark, d).groupBy(A.queue_view(NOW, DAY).alias("view")).agg(F.count(F.lit(1)).alias("runs"))


@query("SELECT count(*) FILTER (WHERE wake_at IS NOT NULL) AS backlog, count(*) FILTER (WHERE claimed_at IS NOT NULL) AS in_flight, count(*) FILTER (WHERE status = 'done') AS done FROM runs", RUNS)
def backlog_sample(spark, d):
    return runs(spark, d).agg(
        F.count_if(F.col("wake_at").isNotNull()).alias("backlog"), F.count_if(F.col("claimed_at").isNotNull()).alias("in_flight"), F.count_if(F.col("status") == "done").alias("done")
    )


_RULES = ["durable_status", "terminal_finished", "claim_pair", "poison_pair", "idle", "poisoned", "scheduled", "counters"]
_RULES_SQL = {
    "durable_status": "status NOT IN ('running', 'waiting', 'done', 'failed', 'cancelled')",
    "terminal_finished": "(status IN ('done', 'failed', 'cancelled')) <> (finished_at IS NOT NULL)",
    "claim_pair": "(claimed_at IS NULL) <> (claim_token IS NULL)",
    "poison_pair": "(poisoned_at IS NULL) <> (poison_reason IS NULL)",
    "idle": "status IN ('done', 'failed', 'cancelled', 'waiting') AND (claimed_at IS NOT NULL OR wake_at IS NOT NULL)",
    "poisoned": "poisoned_at IS NOT NULL AND (status <> 'running' OR claimed_at IS NOT NULL OR wake_at IS NOT NULL)",
    "scheduled": "status = 'running' AND poisoned_at IS NULL AND (wake_at IS NULL) = (claimed_at IS NULL)",
    "counters": "claim_attempts < 0 OR claim_abandons < 0",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {v}) AS violations FROM runs" for k, v in _RULES_SQL.items()), RUNS)
def invariant_report(spark, d):
    return store.invariants(runs(spark, d))


# Listings and pages

_COLUMNS = ", ".join(store.SUMMARY)
_CALLERS = "runs AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id FROM customer)"


@query(f"SELECT {_COLUMNS} FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 101", RUNS)
def list_runs_page1(spark, d):
    return store.list_runs(runs(spark, d))


@query(f"SELECT {_COLUMNS} FROM runs WHERE started_at < {NOW} OR (started_at = {NOW} AND run_id < 'run-000007000') ORDER BY started_at DESC, run_id DESC LIMIT 51", RUNS)
def list_runs_cursor(spark, d):
    return store.list_runs(runs(spark, d), 50, before=(NOW, "run-000007000"))


@query(f"SELECT {_COLUMNS} FROM runs WHERE tenant_id = 'tenant-07' AND status IN ('running', 'waiting') AND graph_id = '5-LOW' ORDER BY started_at DESC, run_id DESC LIMIT 101", RUNS)
def list_runs_filtered(spark, d):
    return store.list_runs(runs(spark, d), statuses=("running", "waiting"), graph_id="5-LOW", scope=store.in_scope("tenant-07"))


@query("SELECT scope_key, max_by(run_id, {'a': started_at, 'b': run_id}) AS run_id FROM runs GROUP BY scope_key", RUNS)
def latest_run(spark, d):
    return runs(spark, d).groupBy("scope_key").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


@query("SELECT * FROM events_log WHERE run_id = '7' AND seq > 10 ORDER BY seq LIMIT 20", EVENTS)
def event_page(spark, d):
    return store.event_page(events_log(spark, d), "7", 10, 20)


@query("SELECT runs.run_id, first_seq, latest_seq FROM (SELECT run_id FROM runs) runs LEFT JOIN (SELECT run_id, min(seq) AS first_seq, max(seq) AS latest_seq FROM events_log GROUP BY run_id) b USING (run_id)", _CALLERS, EVENTS)
def event_page_bounds(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("run_id"))
    return store.event_bounds(events_log(spark, d), names)


@query("SELECT run_id, max(seq) AS seq, max_by(type, seq) AS type, max_by(value, seq) AS value, max_by(occurred_at, seq) AS occurred_at FROM events_log GROUP BY run_id", EVENTS)
def latest_event(spark, d):
    return store.latest_event(events_log(spark, d))


@query("SELECT runs.run_id, e.seq, e.type FROM runs LEFT JOIN events_log e ON e.run_id = runs.run_id AND e.seq = 70", _CALLERS, EVENTS)
def point_event_left_join(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("run_id"))
    return store.point_event(names, events_log(spark, d), 70)


@query("SELECT * FROM graph_versions WHERE scope_key = 'tenant-03' AND graph_id = '2-HIGH' ORDER BY inserted_at DESC, graph_hash DESC LIMIT 20", RUNS, VERSIONS)
def graph_versions_page(spark, d):
    return store.version_page(graph_versions(runs(spark, d)), "tenant-03", "2-HIGH", 20)


@query("SELECT scope_key, graph_id, max_by(graph_hash, {'a': inserted_at, 'b': graph_hash}) AS graph_hash FROM graph_versions GROUP BY ALL", RUNS, VERSIONS)
def latest_graph_ref(spark, d):
    return store.latest_version(graph_versions(runs(spark, d)))


@query("SELECT scope_key, count(DISTINCT graph_hash) AS versions FROM runs GROUP BY scope_key", RUNS)
def graph_publish_dedupe(spark, d):
    return graph_versions(runs(spark, d)).groupBy("scope_key").agg(F.countDistinct("graph_hash").alias("versions"))


# Retention, counters and commits


@query("SELECT * FROM events_log WHERE occurred_at < 1705000000000000 ORDER BY occurred_at, run_id, seq LIMIT 500", EVENTS)
def retention_events(spark, d):
    return store.prune_events(events_log(spark, d), 1_705_000_000_000_000, 500)


@query(f"SELECT status, count(DISTINCT run_id) AS runs, count(seq) AS events FROM (SELECT * FROM runs WHERE finished_at < {CUTOFF} ORDER BY finished_at, id LIMIT 1000) LEFT JOIN run_events USING (run_id) GROUP BY status", RUNS, RUN_EVENTS)
def retention_runs_cascade(spark, d):
    """The oldest finished runs, and how many events go with them."""
    gone = store.prune_runs(runs(spark, d), CUTOFF, 1000)
    with_events = gone.select("run_id", "status").join(run_events(spark, d).select("run_id", "seq"), "run_id", "left")
    return with_events.groupBy("status").agg(F.count_distinct("run_id").alias("runs"), F.count("seq").alias("events"))


@query(f"""SELECT scope_key, graph_id, graph_hash, inserted_at, CAST(revision AS INTEGER) AS revision FROM
  (SELECT *, row_number() OVER (PARTITION BY scope_key, graph_id ORDER BY inserted_at DESC, graph_hash DESC) AS revision FROM graph_versions) v
  WHERE revision > 10 AND NOT EXISTS (SELECT 1 FROM runs r WHERE NOT (finished_at IS NOT NULL AND updated_at < {CUTOFF})
    AND r.scope_key = v.scope_key AND r.graph_id = v.graph_id AND r.graph_hash = v.graph_hash)""", RUNS, VERSIONS)
def retention_graphs(spark, d):
    rows = runs(spark, d)
    left = rows.filter(~(F.col("finished_at").isNotNull() & (F.col("updated_at") < CUTOFF)))
    return store.prune_versions(graph_versions(rows), left)


@query("SELECT scope_key, count(*) AS unfinished FROM runs WHERE finished_at IS NULL GROUP BY scope_key", RUNS)
def unfinished_by_scope(spark, d):
    return store.unfinished(runs(spark, d))


@query("""SELECT scope_key, CAST(sum(CAST(new NOT IN ('done', 'failed', 'cancelled') AS INTEGER) - CAST(coalesce(old NOT IN ('done', 'failed', 'cancelled'), false) AS INTEGER)) AS BIGINT) AS delta
  FROM (SELECT scope_key, CASE WHEN id % 2 = 0 THEN 'running' END AS old, status AS new FROM runs) GROUP BY scope_key""", RUNS)
def schedule_delta(spark, d):
    moves = runs(spark, d).select("scope_key", F.when(F.col("id") % 2 == 0, "running").alias("old"), F.col("status").alias("new"))
    return store.schedule_delta(moves)


def _proposals(rows: DataFrame) -> DataFrame:
    two = rows.select("id", "run_id", "checkpoint_seq", "claim_token", F.explode(F.array(F.lit(0), F.lit(1))).alias("w"))
    return two.select(
        (F.col("id") * 2 + F.col("w")).alias("proposal_id"),
        F.when(F.col("id") % 11 == 0, F.concat(F.lit("no-"), "run_id")).otherwise(F.col("run_id")).alias("run_id"),
        (F.col("checkpoint_seq") + (F.col("id") % 7 == 0).cast("int")).alias("expected_seq"),
        F.col("claim_token").alias("token"),
    )


@query("""SELECT proposal_id, run_id, CASE WHEN st IS NULL THEN 'not_found' WHEN ok AND r = 1 THEN 'committed' WHEN st <> 'running' THEN 'invalid' ELSE 'stale' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, ok ORDER BY proposal_id) AS r FROM
    (SELECT p.proposal_id, p.run_id, runs.status AS st, coalesce(p.expected_seq = runs.checkpoint_seq AND p.token IS NOT DISTINCT FROM runs.claim_token AND runs.status = 'running', false) AS ok
     FROM proposals p LEFT JOIN runs ON runs.run_id = p.run_id))""", RUNS,
    """proposals AS (SELECT id * 2 + w AS proposal_id, CASE WHEN id % 11 = 0 THEN 'no-' || run_id ELSE run_id END AS run_id,
  checkpoint_seq + CAST(id % 7 = 0 AS INTEGER) AS expected_seq, claim_token AS token FROM runs, (VALUES (0), (1)) v(w))""")
def commit_fence_winner(spark, d):
    rows = runs(spark, d)
    return store.fenced(_proposals(rows), rows)


@query("""SELECT run_id, CASE WHEN id % 3 = 0 THEN 'lost' WHEN status IN ('running', 'waiting') THEN 'cancelled' ELSE 'unchanged' END AS outcome,
  CASE WHEN id % 3 <> 0 AND status IN ('running', 'waiting') THEN 'cancelled' ELSE status END AS status,
  checkpoint_seq + CAST(id % 3 <> 0 AND status IN ('running', 'waiting') AS INTEGER) AS checkpoint_seq FROM runs""", RUNS)
def cas_signal(spark, d):
    rows = runs(spark, d)
    signals = rows.select("run_id", (F.col("checkpoint_seq") - (F.col("id") % 3 == 0).cast("int")).alias("expected_seq"))
    return store.cancel_unclaimed(signals, rows)


_EFFECTS = ["retain", "immediate", "at", "external", "terminal"]


@query(f"""SELECT id, effect, CASE WHEN effect = 'retain' THEN claim_token END AS claim_token, CASE WHEN effect = 'retain' THEN {NOW} END AS claimed_at,
  CASE effect WHEN 'immediate' THEN {NOW} WHEN 'at' THEN {NOW + DAY} END AS wake_at, CASE WHEN effect IN ('retain', 'immediate') THEN tenant_admitted_at END AS tenant_admitted_at,
  0 AS claim_attempts, 0 AS claim_abandons FROM (SELECT *, ['retain', 'immediate', 'at', 'external', 'terminal'][id % 5 + 1] AS effect FROM runs WHERE claim_token IS NOT NULL)""", RUNS)
def schedule_effects(spark, d):
    rows = runs(spark, d).filter("claim_token is not null")
    rows = rows.withColumn("effect", F.element_at(F.array(*map(F.lit, _EFFECTS)), (F.col("id") % 5 + 1).cast("int"))).withColumn("until", F.lit(NOW + DAY))
    return store.rescheduled(rows, NOW).select("id", "effect", "claim_token", "claimed_at", "wake_at", "tenant_admitted_at", "claim_attempts", "claim_abandons")


@query("""SELECT proposal_id, CASE WHEN runs.run_id IS NULL THEN 'not_found' WHEN p.graph_id <> runs.graph_id THEN 'invalid_commit'
  WHEN p.expected_seq = runs.checkpoint_seq AND p.token = runs.claim_token THEN NULL ELSE 'stale_fence' END AS miss FROM proposals p LEFT JOIN runs ON runs.run_id = p.run_id""", RUNS,
    """proposals AS (SELECT id AS proposal_id, CASE WHEN id % 11 = 0 THEN 'no-' || run_id ELSE run_id END AS run_id, CASE WHEN id % 13 = 0 THEN 'other' ELSE graph_id END AS graph_id,
  checkpoint_seq + CAST(id % 7 = 0 AS INTEGER) AS expected_seq, claim_token AS token FROM runs)""")
def commit_miss_class(spark, d):
    rows, key = runs(spark, d), F.col("id")
    proposals = rows.select(
        key.alias("proposal_id"),
        F.when(key % 11 == 0, F.concat(F.lit("no-"), "run_id")).otherwise(F.col("run_id")).alias("run_id"),
        F.when(key % 13 == 0, "other").otherwise(F.col("graph_id")).alias("graph_id"),
        "graph_hash",
        "started_at",
        (F.col("checkpoint_seq") + (key % 7 == 0).cast("int")).alias("expected_seq"),
        F.col("claim_token").alias("token"),
    )
    return store.misses(proposals, rows).select("proposal_id", "miss")


@query("""SELECT outcome, count(*) AS events FROM (SELECT CASE WHEN o.run_id IS NULL THEN 'inserted' WHEN o.type = n.type THEN 'duplicate' ELSE 'conflict' END AS outcome
  FROM (SELECT run_id, seq + seq % 3 AS seq, type FROM events_log) n LEFT JOIN (SELECT run_id, seq, type FROM events_log WHERE seq <= 50) o
  ON o.run_id = n.run_id AND o.seq = n.seq) GROUP BY outcome""", EVENTS)
def event_append_idempotent(spark, d):
    log = events_log(spark, d)
    new = log.select("run_id", (F.col("seq") + F.col("seq") % 3).alias("seq"), "type")
    return store.append_events(log.filter("seq <= 50").select("run_id", "seq", "type"), new).groupBy("outcome").agg(F.count(F.lit(1)).alias("events"))


# Reducers

_LINES = ["l_linenumber", "l_partkey", "l_suppkey"]
_BY_LINE = "{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}"


@query(f"SELECT l_orderkey, max_by(l_suppkey, {_BY_LINE}) AS value FROM lineitem GROUP BY l_orderkey")
def reduce_last(spark, d):
    return R.last_value(table(spark, d, "lineitem"), ["l_orderkey"], _LINES, "l_suppkey")


@query(f"SELECT l_orderkey, min_by(l_suppkey, {_BY_LINE}) AS value FROM lineitem GROUP BY l_orderkey")
def reduce_first(spark, d):
    return R.first_value(table(spark, d, "lineitem"), ["l_orderkey"], _LINES, "l_suppkey")


@query("SELECT l_orderkey, sum(l_quantity) AS value FROM lineitem GROUP BY l_orderkey")
def reduce_sum(spark, d):
    return R.total(table(spark, d, "lineitem"), ["l_orderkey"], _LINES, "l_quantity")


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.array_join("value", ","))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def reduce_append(spark, d):
    return _text(R.append(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role"))


@query("SELECT run_id, string_agg(type, ',' ORDER BY seq) AS value FROM (SELECT run_id, type, min(seq) AS seq FROM events_log GROUP BY ALL) GROUP BY run_id", EVENTS)
def reduce_append_unique(spark, d):
    return _text(R.append(events_log(spark, d), ["run_id"], ["seq"], "type", unique=True))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 GROUP BY conv_id")
def reduce_append_window(spark, d):
    return _text(R.append(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role", max_length=3))


@query(f"SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY o) AS value FROM (SELECT l_orderkey, l_returnflag, min({_BY_LINE}) AS o FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def reduce_union(spark, d):
    return _text(R.union(table(spark, d, "lineitem"), ["l_orderkey"], _LINES, "l_returnflag"))


@query("SELECT run_id, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS value FROM (SELECT run_id, type, min(seq) AS seq FROM events_log GROUP BY ALL) GROUP BY run_id", EVENTS)
def reduce_union_by(spark, d):
    return _text(R.union(events_log(spark, d), ["run_id"], ["seq"], "seq", by=F.col("type")))


@query("SELECT run_id, string_agg(type || '=' || k, ',' ORDER BY type) AS value FROM (SELECT run_id, type, max_by(json_extract_string(props, '$.k'), seq) AS k FROM events_log GROUP BY ALL) GROUP BY run_id", EVENTS)
def reduce_merge(spark, d):
    rows = events_log(spark, d).withColumn("k", F.get_json_object("props", "$.k"))
    out = R.merge(rows, ["run_id"], ["seq"], "type", "k")
    return out.withColumn("value", F.array_join(F.transform(F.map_entries("value"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query()
def reduce_merge_deep(spark, d):
    rows = events_log(spark, d).withColumn("w", F.concat(F.lit('{"'), "type", F.lit('": '), "props", F.lit("}")))
    return R.merge_deep(rows, ["run_id"], ["seq"], "w")


# Guards and schemas


def _view() -> dict[str, G.Channel]:
    kind = T.StructType([T.StructField("k", T.LongType())])
    return {
        "props": G.Channel(F.from_json("props", kind), F.lit(1), kind),
        "value": G.Channel(F.col("value"), F.when(F.col("type") == "view", 0).otherwise(1).cast("int"), T.DoubleType()),
        "type": G.Channel(F.col("type"), F.col("seq").cast("int"), T.StringType()),
    }


def _guarded(spark, d, guard: G.Guard) -> DataFrame:
    rows = events_log(spark, d)
    test = G.to_column(guard, _view(), {"type": F.col("type") == "click"})
    return rows.filter(test).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


_COUNT = "SELECT run_id, count(*) AS n FROM events_log WHERE {} GROUP BY run_id"


@query(_COUNT.format("type <> 'view'"), EVENTS)
def guard_exists(spark, d):
    return _guarded(spark, d, G.exists("value"))


@query(_COUNT.format("CAST(json_extract_string(props, '$.k') AS BIGINT) = 42"), EVENTS)
def guard_equals_path(spark, d):
    return _guarded(spark, d, G.equals(G.path("props", ["k"]), 42))


@query(_COUNT.format("seq >= 40"), EVENTS)
def guard_version(spark, d):
    return _guarded(spark, d, G.version_at_least("type", 40))


@query(_COUNT.format("type = 'click'"), EVENTS)
def guard_changed(spark, d):
    return _guarded(spark, d, G.changed("type"))


@query(_COUNT.format("(type = 'click' OR seq >= 60) AND NOT (CAST(json_extract_string(props, '$.k') AS BIGINT) = 42)"), EVENTS)
def guard_bool(spark, d):
    return _guarded(spark, d, G.all_of(G.any_of(G.changed("type"), G.version_at_least("type", 60)), G.not_(G.equals(G.path("props", ["k"]), 42))))


_PART = {
    "p_name": Schema("string", required=True, max_length=11),
    "p_size": Schema("integer", min=5, max=45),
    "p_type": Schema("enum", values=("ECONOMY", "STANDARD", "PROMO")),
    "p_brand": Schema("string", pattern="#[1-9]$"),
}
_REASONS = """list_filter([
  CASE WHEN NOT regexp_matches(p_brand, '#[1-9]$') THEN 'p_brand must match #[1-9]$' END,
  CASE WHEN p_name IS NULL THEN 'p_name is required' END, CASE WHEN length(p_name) > 11 THEN 'p_name must have at most 11 characters' END,
  CASE WHEN p_size < 5 THEN 'p_size must be at least 5' END, CASE WHEN p_size > 45 THEN 'p_size must be at most 45' END,
  CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'p_type must be one of ECONOMY, STANDARD, PROMO' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT p_partkey, array_to_string({_REASONS}, '; ') AS reasons FROM part WHERE len({_REASONS}) > 0")
def validate_reasons(spark, d):
    bad = row_violations(_PART)
    return table(spark, d, "part").select("p_partkey", bad.alias("r")).filter(F.size("r") > 0).select("p_partkey", F.array_join("r", "; ").alias("reasons"))


@query(f"SELECT len({_REASONS}) = 0 AS valid, count(*) AS rows FROM part GROUP BY 1")
def validate_rows(spark, d):
    return table(spark, d, "part").groupBy((F.size(row_violations(_PART)) == 0).alias("valid")).agg(F.count(F.lit(1)).alias("rows"))


# Graph analytics over a corpus of small graphs: every order is one, its lines are the edges.

_EDGES = """edges AS (SELECT DISTINCT l_orderkey AS graph, l_suppkey % 8 || '-' || l_linenumber AS edge,
  l_suppkey % 8 AS source, l_partkey % 8 AS target FROM lineitem),
starts AS (SELECT graph, min(source) AS node FROM edges GROUP BY graph), ends AS (SELECT graph, max(target) AS node FROM edges GROUP BY graph)"""


def edges(spark, d) -> DataFrame:
    """Rows may be repeated."""
    source, target = F.col("l_suppkey") % 8, F.col("l_partkey") % 8
    edge = F.concat_ws("-", source.cast("string"), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), edge.alias("edge"), source.alias("source"), target.alias("target"))


def _starts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("graph").agg(F.min("source").alias("node"))


@query("SELECT graph, node FROM r", "RECURSIVE " + _EDGES, "r AS (SELECT graph, node FROM starts UNION SELECT e.graph, e.target FROM r JOIN edges e ON e.graph = r.graph AND e.source = r.node)")
def graph_reachability(spark, d):
    rows = edges(spark, d)
    return reach.reachable(rows, _starts(rows))


@query()
def graph_and_reachability(spark, d):
    """Fan-in edges: the sources of one target in one graph must all be reached."""
    rows = edges(spark, d).withColumn("edge", F.concat_ws("-", F.col("target").cast("string"), (F.col("source") % 3).cast("string")))
    return reach.reachable(rows, _starts(rows), barriers=True)


_CLOSURE = "c AS (SELECT DISTINCT graph, source AS a, target AS b FROM edges UNION SELECT c.graph, c.a, e.target FROM c JOIN edges e ON e.graph = c.graph AND e.source = c.b)"


@query("SELECT graph, a AS node FROM c WHERE a = b", "RECURSIVE " + _EDGES, _CLOSURE)
def graph_cycles(spark, d):
    return reach.cyclic(edges(spark, d))


@query("SELECT graph, node FROM (SELECT graph, source AS node FROM edges UNION SELECT graph, target FROM edges) n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.graph = n.graph AND r.node = n.node)", "RECURSIVE " + _EDGES,
    "r AS (SELECT graph, node FROM ends UNION SELECT e.graph, e.source FROM r JOIN edges e ON e.graph = r.graph AND e.target = r.node)")
def graph_dead_ends(spark, d):
    rows = edges(spark, d)
    return reach.dead_ends(rows, rows.groupBy("graph").agg(F.max("target").alias("node")))


@query("SELECT graph, range AS node FROM (SELECT DISTINCT graph FROM edges) g, range(0, 8) WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = g.graph AND (e.source = range OR e.target = range))", _EDGES)
def graph_orphans(spark, d):
    used = edges(spark, d).groupBy("graph").agg(F.array_union(F.collect_set("source"), F.collect_set("target")).alias("used"))
    return used.select("graph", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(7)).cast("array<long>"), "used")).alias("node"))


# Streams: the tables read as file streams, every batch one commit


def _stream(spark, d, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS version, max(epoch_us(ts)) AS seq, min_by(event_type, ts) AS first_type, max_by(event_type, ts) AS last_type,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, string_agg(event_type, ',' ORDER BY ts) FILTER (WHERE r <= 3) AS recent
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) GROUP BY user_id""")
def stream_run_state(spark, d):
    rows = _stream(spark, d, "events").select(
        F.col("user_id").cast("string").alias("run_id"), micros("ts").alias("seq"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("long").alias("amount")
    )
    base = fresh_folder(spark, "stream-run-state")
    fold.sink(fold.folded(rows), f"{base}/out", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return fold.latest(spark.read.parquet(f"{base}/out"))


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'done' WHEN o_orderkey % 11 = 0 THEN 'cancelled' ELSE 'waiting' END AS status,
  CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 1 END AS step, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS decision, CASE WHEN o_orderkey % 3 <> 0 THEN 'did ' || o_orderpriority END AS applied FROM orders""")
def stream_shell(spark, d):
    """Orders start as runs that wait for a decision; two thirds are answered, some of the rest cancelled."""
    key, prio, none = F.col("o_orderkey"), F.col("o_orderpriority"), F.lit(None).cast("string")
    signal = lambda kind, node, value: F.struct(F.lit(kind).alias("kind"), node.alias("node"), value.alias("value"))
    kinds = F.array(signal("start", none, none), F.when(key % 3 != 0, signal("resolve", F.lit("gate"), prio)), F.when(key % 11 == 0, signal("cancel", none, none)))
    signals = _stream(spark, d, "orders").select(key.alias("run_id"), key.alias("key"), prio.alias("prio"), F.explode(F.array_compact(kinds)).alias("s")).select("run_id", "key", "prio", "s.*")
    base = fresh_folder(spark, "stream-shell")
    runner = RunShell(spark, Engine(flows.review()), f"{base}/store")
    runner.writer(signals, f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return runner.outputs()


# Scorecard


@query("""SELECT l_returnflag, count(*) AS n, min(w) AS least, max(w) AS most, max(w) FILTER (WHERE r = (n_ * 50 + 99) // 100) AS p50,
  max(w) FILTER (WHERE r = (n_ * 95 + 99) // 100) AS p95, max(w) FILTER (WHERE r = (n_ * 99 + 99) // 100) AS p99
  FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY w) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n_ FROM
    (SELECT l_returnflag, CAST(floor((epoch_us(l_shipdate) - greatest(l_partkey * 1000000, l_suppkey * 1000000)) / 1000) AS BIGINT) AS w FROM lineitem)) GROUP BY l_returnflag""")
def wait_percentiles(spark, d):
    wait = M.wait_ms(micros("l_shipdate"), F.col("l_partkey") * 1_000_000, F.col("l_suppkey") * 1_000_000)
    return M.nearest_rank(table(spark, d, "lineitem").select("l_returnflag", wait.alias("w")), ["l_returnflag"], "w")


@query("SELECT round(sum(n) * sum(n) / (count(*) * CAST(sum(n * n) AS DOUBLE)), 9) AS jain FROM (SELECT scope_key, CAST(count(*) AS DOUBLE) AS n FROM runs GROUP BY scope_key)", RUNS)
def jain_fairness(spark, d):
    return M.jain(runs(spark, d).groupBy("scope_key").agg(F.count(F.lit(1)).cast("double").alias("n")), "n")


@query("""SELECT scope_key, CAST(max(o) AS BIGINT) AS peak FROM (SELECT scope_key, sum(d) OVER (PARTITION BY scope_key ORDER BY t) AS o FROM
  (SELECT scope_key, t, sum(d) AS d FROM (SELECT scope_key, started_at AS t, 1 AS d FROM runs UNION ALL SELECT scope_key, updated_at, -1 FROM runs) GROUP BY ALL)) GROUP BY scope_key""", RUNS)
def peak_wip(spark, d):
    return M.peak(runs(spark, d), ["scope_key"], "started_at", "updated_at")


@query("""SELECT run_id, min(seq) FILTER (WHERE m <= 60 AND c = 3) AS recovered_at FROM (SELECT run_id, seq, max(value) OVER w AS m, count(*) OVER w AS c FROM events_log
  WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) GROUP BY run_id""", EVENTS)
def surge_recovery(spark, d):
    return M.recovery(events_log(spark, d), ["run_id"], "seq", "value", 60)


for _name, (_run, _sql) in flows.queries().items():
    QUERIES[_name] = _run
    if _sql is not None:
        SQL[_name] = _sql

from . import catalog_store  # noqa: E402, F401  registers its queries
