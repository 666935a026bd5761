"""The store's tables as views of the star schema.  Times are microseconds since 1970 in UTC, as longs.

Each view comes twice: as a DataFrame and as the text of a SQL common table expression for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400_000_000
NOW = 883_612_800_000_000  # 1998-01-01
TERMINAL = ("done", "failed", "cancelled")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order; the customer's nation is its tenant."""
    nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    key, at = F.col("o_orderkey"), F.col("at")
    tenant = F.when(F.col("c_nationkey") != 0, F.concat(F.lit("tenant-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")))
    status = (
        F.when(F.col("o_orderstatus") == "O", "running")
        .when(F.col("o_orderstatus") == "P", "waiting")
        .when(key % 10 == 0, "failed")
        .when(key % 10 == 1, "cancelled")
        .otherwise("done")
    )
    month = F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.month("o_orderdate").cast("string"))
    base = orders.select("*", micros("o_orderdate").alias("at"), status.alias("status"))
    running, sick = F.col("status") == "running", key % 97 == 0
    healthy, held = running & ~sick, key % 3 == 0
    updated = at + (key % 30) * DAY
    return base.select(
        key.alias("id"),
        F.concat(F.lit("run-"), F.lpad(key.cast("string"), 9, "0")).alias("run_id"),
        tenant.alias("tenant_id"),
        F.coalesce(tenant, F.lit("")).alias("scope_key"),
        F.col("o_orderpriority").alias("graph_id"),
        F.sha2(F.concat("o_orderpriority", F.lit("|"), month), 256).alias("graph_hash"),
        "status",
        (key % 12).cast("int").alias("step"),
        (1 + key % 20).alias("checkpoint_seq"),
        F.when(running & sick, at).alias("poisoned_at"),
        F.when(running & sick, F.lit("max_claim_attempts_exceeded")).alias("poison_reason"),
        F.when(healthy & held, at).alias("claimed_at"),
        F.when(healthy & held, F.concat(F.lit("tok-"), key.cast("string"))).alias("claim_token"),
        F.when(healthy & ~held, at).alias("wake_at"),
        F.when(healthy & (key % 5 == 0), at).alias("tenant_admitted_at"),
        F.when(running, (key % 7).cast("int")).otherwise(0).alias("claim_attempts"),
        F.when(running, (key % 4).cast("int")).otherwise(0).alias("claim_abandons"),
        at.alias("started_at"),
        updated.alias("updated_at"),
        F.when(F.col("status").isin(*TERMINAL), updated).alias("finished_at"),
    )


RUNS = f"""base AS (
  SELECT o_orderkey AS k, epoch_us(o_orderdate) AS t, c_nationkey AS n, o_orderpriority AS p, o_orderdate AS d,
    CASE WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderstatus = 'P' THEN 'waiting'
      WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 10 = 1 THEN 'cancelled' ELSE 'done' END AS s
  FROM orders JOIN customer ON o_custkey = c_custkey),
runs AS (
  SELECT k AS id, 'run-' || lpad(CAST(k AS VARCHAR), 9, '0') AS run_id,
    CASE WHEN n <> 0 THEN 'tenant-' || lpad(CAST(n AS VARCHAR), 2, '0') END AS tenant_id,
    CASE WHEN n <> 0 THEN 'tenant-' || lpad(CAST(n AS VARCHAR), 2, '0') ELSE '' END AS scope_key,
    p AS graph_id, sha256(p || '|' || year(d) || '-' || month(d)) AS graph_hash, s AS status,
    CAST(k % 12 AS INTEGER) AS step, 1 + k % 20 AS checkpoint_seq,
    CASE WHEN s = 'running' AND k % 97 = 0 THEN t END AS poisoned_at,
    CASE WHEN s = 'running' AND k % 97 = 0 THEN 'max_claim_attempts_exceeded' END AS poison_reason,
    CASE WHEN s = 'running' AND k % 97 <> 0 AND k % 3 = 0 THEN t END AS claimed_at,
    CASE WHEN s = 'running' AND k % 97 <> 0 AND k % 3 = 0 THEN 'tok-' || k END AS claim_token,
    CASE WHEN s = 'running' AND k % 97 <> 0 AND k % 3 <> 0 THEN t END AS wake_at,
    CASE WHEN s = 'running' AND k % 97 <> 0 AND k % 5 = 0 THEN t END AS tenant_admitted_at,
    CAST(CASE WHEN s = 'running' THEN k % 7 ELSE 0 END AS INTEGER) AS claim_attempts,
    CAST(CASE WHEN s = 'running' THEN k % 4 ELSE 0 END AS INTEGER) AS claim_abandons,
    t AS started_at, t + (k % 30) * {DAY} AS updated_at,
    CASE WHEN s IN ('done', 'failed', 'cancelled') THEN t + (k % 30) * {DAY} END AS finished_at
  FROM base)"""


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log: (run_id, seq) from a user's events in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("event_type").alias("type"),
        "value",
        "props",
        micros("ts").alias("occurred_at"),
    )


EVENTS = """events_log AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    event_type AS type, value, props, epoch_us(ts) AS occurred_at FROM events)"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the runs that orders are: one for each of an order's lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run-"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("run_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("l_returnflag").alias("type"),
        micros("l_shipdate").alias("occurred_at"),
    )


RUN_EVENTS = """run_events AS (
  SELECT 'run-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq,
    l_returnflag AS type, epoch_us(l_shipdate) AS occurred_at FROM lineitem)"""


def graph_versions(of: DataFrame) -> DataFrame:
    return of.groupBy("scope_key", "graph_id", "graph_hash").agg(F.min("started_at").alias("inserted_at"))


VERSIONS = """graph_versions AS (
  SELECT scope_key, graph_id, graph_hash, min(started_at) AS inserted_at FROM runs GROUP BY ALL)"""
