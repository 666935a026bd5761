"""Registered queries over what commits, claims and retention leave in the store, and the rest of the scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..operators import admission as A
from ..operators import commits, store
from ..operators import metrics as M
from ..sources.snapshots import SnapshotStore, fresh_folder
from ..sources.tables import DAY, EVENTS, NOW, RUN_EVENTS, RUNS, VERSIONS, events_log, graph_versions, run_events, runs, table
from .catalog import _COUNT, CUTOFF, MAX_ATTEMPTS, _guarded, _legacy_sql, _outcomes_sql, query

# Commits


def _moments(rows: DataFrame) -> DataFrame:
    """Two rival proposals for each claimed run, some of them stale, unbound, unknown or not valid."""
    key, held = F.col("id"), rows.filter("claim_token is not null")
    two = held.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("w"))
    status = F.element_at(F.array(*map(F.lit, ["running", "running", "waiting", "done"])), (key % 4 + 1).cast("int"))
    effect = F.element_at(F.array(*map(F.lit, ["retain", "at", "external", "terminal"])), (key % 4 + 1).cast("int"))
    return two.select(
        (key * 2 + F.col("w")).alias("proposal_id"),
        F.when(key % 11 == 0, F.concat(F.lit("no-"), "run_id")).otherwise(F.col("run_id")).alias("run_id"),
        "scope_key",
        F.when(key % 13 == 0, "other").otherwise(F.col("graph_id")).alias("graph_id"),
        "graph_hash",
        "started_at",
        (F.col("checkpoint_seq") + (key % 7 == 0).cast("int")).alias("expected_seq"),
        (F.col("checkpoint_seq") + (key % 7 == 0).cast("int") + F.when(key % 17 == 0, 2).otherwise(1)).alias("checkpoint_seq"),
        F.col("claim_token").alias("token"),
        status.alias("status"),
        (F.col("step") + 1).alias("step"),
        F.when(key % 19 == 0, "retain").otherwise(effect).alias("effect"),
        F.lit(NOW + DAY).alias("until"),
        F.lit(NOW).alias("updated_at"),
        F.when(status == "done", F.lit(NOW)).alias("finished_at"),
        F.array(F.lit("node_completed"), F.lit("checkpoint_committed")).alias("events"),
    )


_MOMENTS = f"""moments AS (SELECT *, CASE k WHEN 0 THEN 'retain' WHEN 1 THEN 'at' WHEN 2 THEN 'external' ELSE 'terminal' END AS fit,
  CASE k WHEN 2 THEN 'waiting' WHEN 3 THEN 'done' ELSE 'running' END AS new_status FROM (SELECT *, id % 4 AS k FROM runs WHERE claim_token IS NOT NULL)),
judged AS (SELECT id, k, fit, new_status, w, CASE WHEN id % 17 = 0 OR (id % 19 = 0 AND fit <> 'retain' AND new_status <> 'running') THEN 'invalid_transition' WHEN id % 11 = 0 THEN 'not_found'
  WHEN id % 13 = 0 THEN 'invalid_commit' WHEN id % 7 = 0 OR w = 1 THEN 'stale_fence' ELSE 'committed' END AS outcome FROM moments, (VALUES (0), (1)) v(w)),
won AS (SELECT id AS wid, CASE WHEN id % 19 = 0 THEN 'retain' ELSE fit END AS effect, new_status FROM judged WHERE outcome = 'committed')"""


@query("SELECT id * 2 + w AS proposal_id, outcome FROM judged", RUNS, _MOMENTS)
def commit_outcomes(spark, d):
    rows = runs(spark, d)
    return commits.judged(_moments(rows), rows).select("proposal_id", "outcome")


def _after(spark, d) -> SnapshotStore:
    """A store of runs and events in which the proposals were committed."""
    held = SnapshotStore(spark, fresh_folder(spark, "commits"))
    at = held.commit({"runs": runs(spark, d), "events": run_events(spark, d)}, 0)
    moments = commits.judged(_moments(held.read("runs")), held.read("runs"))
    held.commit({"runs": commits.committed(moments, held.read("runs"), NOW), "events": commits.new_events(moments, held.appended("events"))}, at)
    return held


@query(f"""SELECT id, CASE WHEN effect IS NULL THEN status ELSE new_status END AS status, CAST(CASE WHEN effect IS NULL THEN step ELSE step + 1 END AS INTEGER) AS step,
  CASE WHEN effect IS NULL THEN checkpoint_seq ELSE checkpoint_seq + 1 END AS checkpoint_seq, CASE WHEN effect IS NULL OR effect = 'retain' THEN claim_token END AS claim_token,
  CASE WHEN effect IS NULL THEN claimed_at WHEN effect = 'retain' THEN {NOW} END AS claimed_at, CASE WHEN effect IS NULL THEN wake_at WHEN effect = 'at' THEN {NOW + DAY} END AS wake_at,
  CASE WHEN effect IS NULL OR effect = 'retain' THEN tenant_admitted_at END AS tenant_admitted_at, CAST(CASE WHEN effect IS NULL THEN claim_attempts ELSE 0 END AS INTEGER) AS claim_attempts,
  CASE WHEN effect IS NULL THEN finished_at WHEN new_status = 'done' THEN {NOW} END AS finished_at FROM runs LEFT JOIN won ON wid = id""", RUNS, _MOMENTS)
def commit_applied(spark, d):
    return _after(spark, d).read("runs").select("id", "status", "step", "checkpoint_seq", "claim_token", "claimed_at", "wake_at", "tenant_admitted_at", "claim_attempts", "finished_at")


@query("""SELECT run_id, count(*) AS events, max(seq) AS latest FROM (SELECT run_id, seq FROM run_events UNION ALL
  SELECT r.run_id, coalesce(m, 0) + i FROM won JOIN runs r ON r.id = wid LEFT JOIN (SELECT run_id, max(seq) AS m FROM run_events GROUP BY run_id) l USING (run_id), (VALUES (1), (2)) v(i)) GROUP BY run_id""",
    RUNS, _MOMENTS, RUN_EVENTS)
def commit_events_appended(spark, d):
    return _after(spark, d).appended("events").groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("latest"))


_NEW_CLAIMS = "claims AS (" + _outcomes_sql("tenant_admitted_at") + ")"


@query("""SELECT r.id, CASE WHEN c.id IS NULL THEN r.claim_token ELSE c.claim_token END AS claim_token, CASE WHEN c.id IS NULL THEN r.claimed_at ELSE c.claimed_at END AS claimed_at,
  CASE WHEN c.id IS NULL THEN r.wake_at END AS wake_at, CAST(coalesce(c.claim_attempts, r.claim_attempts) AS INTEGER) AS claim_attempts, coalesce(c.poisoned_at, r.poisoned_at) AS poisoned_at
  FROM runs r LEFT JOIN claims c ON c.id = r.id""", RUNS, _legacy_sql(50), _NEW_CLAIMS)
def claim_applied(spark, d):
    """The table of runs after a batch of claims."""
    rows = runs(spark, d)
    batch = A.outcomes(rows, A.legacy(rows, NOW, 50, DAY), NOW, MAX_ATTEMPTS, "b1")
    return commits.claimed(rows, batch).select("id", "claim_token", "claimed_at", "wake_at", "claim_attempts", "poisoned_at")


@query(f"SELECT id, CASE WHEN poisoned_at IS NOT NULL AND id % 2 = 0 THEN {NOW} ELSE wake_at END AS wake_at, CASE WHEN id % 2 <> 0 THEN poisoned_at END AS poisoned_at FROM runs", RUNS)
def retry_poisoned(spark, d):
    return commits.retried(runs(spark, d), F.col("id") % 2 == 0, NOW).select("id", "wake_at", "poisoned_at")


@query(f"""SELECT id, CASE WHEN claim_token IS NULL THEN claim_abandons ELSE claim_abandons + 1 END AS claim_abandons,
  CASE WHEN claim_token IS NULL THEN wake_at ELSE {NOW} + CAST(least(1000000 * pow(2, least(claim_abandons, 30)), 3000000) AS BIGINT) END AS wake_at, poisoned_at FROM runs""", RUNS)
def abandon_without_poison(spark, d):
    rows = runs(spark, d)
    gone = commits.abandoned(rows, rows.filter("claim_token is not null"), NOW, 1_000_000, 3_000_000)
    return gone.select("id", "claim_abandons", "wake_at", "poisoned_at")


# Retention

_SHIPPED = 852_076_800_000_000  # 1997-01-01
_PASS = f"""old AS (SELECT run_id, seq FROM run_events WHERE occurred_at < {_SHIPPED} ORDER BY occurred_at, run_id, seq LIMIT 5000),
kept AS (SELECT * FROM run_events e WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.run_id = e.run_id AND o.seq = e.seq)),
over AS (SELECT id, run_id FROM runs WHERE status IN ('done', 'failed', 'cancelled') AND updated_at < {CUTOFF} ORDER BY updated_at, id LIMIT 5000),
unused AS (SELECT scope_key, graph_id, graph_hash FROM (SELECT *, row_number() OVER (PARTITION BY scope_key, graph_id ORDER BY inserted_at DESC, graph_hash DESC) AS r FROM graph_versions) v
  WHERE r > 10 AND NOT EXISTS (SELECT 1 FROM runs u WHERE u.id NOT IN (SELECT id FROM over) AND u.scope_key = v.scope_key AND u.graph_id = v.graph_id AND u.graph_hash = v.graph_hash)
  ORDER BY inserted_at, graph_hash, scope_key, graph_id LIMIT 5000)"""


def _retention(spark, d) -> dict[str, DataFrame]:
    rows = runs(spark, d)
    return commits.retention(rows, run_events(spark, d), graph_versions(rows), _SHIPPED, CUTOFF, 5000)


@query("""SELECT (SELECT count(*) FROM old) AS events_deleted, (SELECT count(*) FROM over) AS runs_deleted,
  (SELECT count(*) FROM kept WHERE run_id IN (SELECT run_id FROM over)) AS cascade_events_deleted, (SELECT count(*) FROM unused) AS graphs_deleted""", RUNS, VERSIONS, RUN_EVENTS, _PASS)
def retention_pass(spark, d):
    return _retention(spark, d)["counts"]


@query("""SELECT 'runs' AS name, count(*) AS rows, CAST(sum(id) AS BIGINT) AS total FROM runs WHERE id NOT IN (SELECT id FROM over)
  UNION ALL SELECT 'events', count(*), CAST(sum(seq) AS BIGINT) FROM kept WHERE run_id NOT IN (SELECT run_id FROM over)
  UNION ALL SELECT 'versions', count(*), CAST(sum(inserted_at // 1000000) AS BIGINT) FROM graph_versions v WHERE NOT EXISTS (SELECT 1 FROM unused u WHERE u.scope_key = v.scope_key AND u.graph_id = v.graph_id AND u.graph_hash = v.graph_hash)""",
    RUNS, VERSIONS, RUN_EVENTS, _PASS)
def retention_left(spark, d):
    """The store read after a pass was committed."""
    held = SnapshotStore(spark, fresh_folder(spark, "retention"))
    left = _retention(spark, d)
    held.commit({k: left[k] for k in ("runs", "events", "versions")}, 0)
    amounts = {"runs": F.col("id"), "events": F.col("seq"), "versions": F.floor(F.col("inserted_at") / 1_000_000)}
    parts = [held.read(k).agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(x).cast("long").alias("total")) for k, x in amounts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Reads


@query("SELECT run_id, tenant_id, status, wake_at, claimed_at, poisoned_at, claim_token IS NOT NULL AS claimed FROM runs WHERE status = 'running'", RUNS)
def operational_runs(spark, d):
    return store.operational(runs(spark, d)).filter("status = 'running'").select("run_id", "tenant_id", "status", "wake_at", "claimed_at", "poisoned_at", "claimed")


@query("""SELECT '7' AS run_id, (SELECT string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FROM page) AS seqs, min(seq) AS first_seq, max(seq) AS latest_seq, (SELECT max(seq) FROM page) AS next_cursor,
  max(seq) > (SELECT max(seq) FROM page) AS has_more FROM events_log WHERE run_id = '7'""", EVENTS, "page AS (SELECT seq FROM events_log WHERE run_id = '7' AND seq > 2 ORDER BY seq LIMIT 5)")
def event_page_whole(spark, d):
    page = store.event_page_whole(events_log(spark, d), "7", 2, 5)
    return page.select("run_id", F.array_join(F.transform("events", lambda e: e["seq"].cast("string")), ",").alias("seqs"), "first_seq", "latest_seq", "next_cursor", "has_more")


@query(_COUNT.format("type = 'click'"), EVENTS)
def guard_equals_unlike(spark, d):
    """A text against a number and a number against a text are unequal, whatever they hold, and raise nothing."""
    return _guarded(spark, d, G.all_of(G.equals("type", "click"), G.not_(G.equals("type", 5)), G.not_(G.equals("value", "abc")), G.not_(G.equals(G.path("props", ["k"]), "42"))))


# Scorecard


@query("SELECT run_id, seq, count(*) AS n FROM (SELECT run_id, seq + seq % 2 AS seq FROM events_log) GROUP BY ALL HAVING count(*) > 1", EVENTS)
def duplicate_events(spark, d):
    return commits.duplicated(events_log(spark, d).select("run_id", (F.col("seq") + F.col("seq") % 2).alias("seq")), ["run_id", "seq"])


_CHECKS = {"all_done": ("status = 'done'", 5), "no_active_claims": ("claim_token IS NOT NULL", 0), "no_stranded": ("status NOT IN ('done', 'failed', 'cancelled')", 0), "durable": ("status IS NULL", 0)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE {rule}) AS actual, CAST({n} AS BIGINT) AS expected, count(*) FILTER (WHERE {rule}) = {n} AS pass FROM runs" for k, (rule, n) in _CHECKS.items()), RUNS)
def expected_counts(spark, d):
    return M.expected(runs(spark, d), {k: (F.expr(rule), n) for k, (rule, n) in _CHECKS.items()})


@query("SELECT 'runs' AS of, coalesce(max(checkpoint_seq), 0) AS last FROM runs UNION ALL SELECT 'none', 0", RUNS)
def last_sequence(spark, d):
    rows = runs(spark, d)
    one = lambda df, name: M.last_seq(df, "checkpoint_seq").withColumn("of", F.lit(name))
    return one(rows, "runs").unionByName(one(rows.filter("id < 0"), "none"))


@query("""SELECT status, CAST(sum(strlen('{"run_id":"' || run_id || '","status":"' || status || '","step":' || step || '}')) AS BIGINT) AS bytes FROM runs GROUP BY status""", RUNS)
def logical_bytes(spark, d):
    rows = runs(spark, d).select("run_id", "status", "step")
    return rows.groupBy("status").agg(F.sum(M.logical_bytes(rows)).alias("bytes"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(CAST(median(l_quantity) AS DOUBLE), 6) AS median, round(CASE WHEN count(*) < 2 OR avg(l_quantity) = 0 THEN 0 ELSE stddev_samp(l_quantity) / avg(l_quantity) END, 6) AS cv
  FROM lineitem GROUP BY l_returnflag""")
def spread_of_values(spark, d):
    out = M.spread(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), ["l_returnflag"], "q")
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "cv")])


@query(f"""SELECT scope_key, round(100 * least(1.0, n / 400.0)) AS throughput, round(100 * least(greatest(done / running / 4.0, 0), 1)) AS efficiency,
  round(100 * least(greatest((8.0 - slow / greatest(fast, 1)) / 6.5, 0), 1)) AS slowdown, round(100 * least(1.0, CAST(done AS DOUBLE) / waiting)) AS recovery,
  round(100 * least(greatest(1 - fast / slow, 0), 1)) AS fairness, round(100 * least(greatest((n - waiting) / CAST(n - 2 AS DOUBLE), 0), 1)) AS stickiness FROM
  (SELECT scope_key, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE status = 'done') AS DOUBLE) AS done, CAST(count(*) FILTER (WHERE status = 'running') AS DOUBLE) AS running,
   CAST(count(*) FILTER (WHERE status = 'waiting') AS DOUBLE) AS waiting, CAST(sum(step) AS DOUBLE) AS slow, CAST(sum(claim_attempts) AS DOUBLE) AS fast FROM runs GROUP BY scope_key)
  WHERE running > 0 AND waiting > 0 AND slow > 0""", RUNS)
def scorecard(spark, d):
    """Each score by tenant, from counts that stand in for rates and latencies."""
    c, of = F.col, lambda s: F.count_if(F.col("status") == s).cast("double").alias(s)
    rows = runs(spark, d).groupBy("scope_key").agg(
        F.count(F.lit(1)).cast("double").alias("n"), of("done"), of("running"), of("waiting"), F.sum("step").cast("double").alias("slow"), F.sum("claim_attempts").cast("double").alias("fast")
    )
    return rows.filter("running > 0 and waiting > 0 and slow > 0").select(
        "scope_key",
        M.throughput_score(c("n"), 400.0).alias("throughput"),
        M.efficiency_score(c("running"), c("done"), 2, 8).alias("efficiency"),
        M.slowdown_score(c("fast"), c("slow")).alias("slowdown"),
        M.recovery_score(c("done"), c("waiting")).alias("recovery"),
        M.fairness_score(c("fast"), c("slow")).alias("fairness"),
        M.stickiness_score(c("n"), c("waiting"), 2).alias("stickiness"),
    )
