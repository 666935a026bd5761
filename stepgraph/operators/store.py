"""Reads of the store: listings, keyset pages, latest rows, retention, commits and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUMMARY = ["run_id", "tenant_id", "graph_id", "graph_hash", "status", "step", "checkpoint_seq", "started_at", "updated_at", "finished_at"]

#: What an operator sees of a run: all but the token that a claim is held by.
OPERATIONAL = ["run_id", "tenant_id", "graph_id", "graph_hash", "status", "step", "checkpoint_seq", "wake_at", "claimed_at", "claim_attempts", "claim_abandons", "poisoned_at", "poison_reason", "started_at", "updated_at", "finished_at"]


def operational(runs: DataFrame) -> DataFrame:
    return runs.select(*OPERATIONAL, F.col("claim_token").isNotNull().alias("claimed"))


def limit_of(limit: int, most: int = 1000) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def in_scope(tenant: str | None = None, system: bool = False) -> Column:
    """System sees all runs, no tenant those without one, a tenant its own."""
    if system:
        return F.lit(True)
    return F.col("tenant_id").isNull() if tenant is None else F.col("tenant_id") == tenant


def list_runs(runs: DataFrame, limit: int = 100, before: tuple[int, str] | None = None, statuses=(), graph_id=None, graph_hash=None, scope: Column | None = None) -> DataFrame:
    """Newest first, with one row more than the page so that the caller sees whether there is another page."""
    rows = runs.filter(scope if scope is not None else F.lit(True))
    if statuses:
        rows = rows.filter(F.col("status").isin(*statuses))
    if graph_id is not None:
        rows = rows.filter(F.col("graph_id") == graph_id)
    if graph_hash is not None:
        rows = rows.filter(F.col("graph_hash") == graph_hash)
    if before is not None:
        at, run = before
        rows = rows.filter((F.col("started_at") < at) | ((F.col("started_at") == at) & (F.col("run_id") < run)))
    return rows.select(*SUMMARY).orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit_of(limit) + 1)


def event_page(events: DataFrame, run_id: str, after: int = 0, limit: int = 250) -> DataFrame:
    rows = events.filter((F.col("run_id") == run_id) & (F.col("seq") > after))
    return rows.orderBy("seq").limit(limit_of(limit))


def event_page_whole(events: DataFrame, run_id: str, after: int = 0, limit: int = 250) -> DataFrame:
    """One row: the page as an array, the bounds of the run's events, the cursor to go on from and whether there is more.

    A run without events has null bounds, an empty page and keeps its cursor.
    """
    mine = events.filter(F.col("run_id") == run_id)
    page = event_page(mine, run_id, after, limit)  # at most limit rows
    fields = [c for c in events.columns if c != "run_id"]
    fields = ["seq", *[c for c in fields if c != "seq"]]
    rows = page.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("events"), F.coalesce(F.max("seq"), F.lit(after)).alias("next_cursor"))
    bounds = mine.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("latest_seq"))
    more = F.coalesce(F.col("latest_seq") > F.col("next_cursor"), F.lit(False))
    return rows.join(bounds).select(F.lit(run_id).alias("run_id"), "events", "first_seq", "latest_seq", "next_cursor", more.alias("has_more"))


def event_bounds(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, first_seq, latest_seq) of every run, with nulls for a run without events."""
    bounds = events.groupBy("run_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("latest_seq"))
    return runs.select("run_id").join(bounds, "run_id", "left")


def latest_event(events: DataFrame) -> DataFrame:
    fields = ["seq", "type", "value", "occurred_at"]
    return events.groupBy("run_id").agg(F.max(F.struct(*fields)).alias("e")).select("run_id", "e.*")


def point_event(runs: DataFrame, events: DataFrame, seq: int) -> DataFrame:
    """Keeps runs without the event, so that a missing run differs from a missing event."""
    one = events.filter(F.col("seq") == seq).select("run_id", "seq", "type")
    return runs.select("run_id").join(one, "run_id", "left")


def latest_version(versions: DataFrame) -> DataFrame:
    newest = F.max_by("graph_hash", F.struct("inserted_at", "graph_hash")).alias("graph_hash")
    return versions.groupBy("scope_key", "graph_id").agg(newest)


def version_page(versions: DataFrame, scope_key: str, graph_id: str, limit: int) -> DataFrame:
    rows = versions.filter((F.col("scope_key") == scope_key) & (F.col("graph_id") == graph_id))
    return rows.orderBy(F.desc("inserted_at"), F.desc("graph_hash")).limit(limit_of(limit))


def unfinished(runs: DataFrame) -> DataFrame:
    return runs.filter("finished_at is null").groupBy("scope_key").agg(F.count(F.lit(1)).alias("unfinished"))


def schedule_delta(transitions: DataFrame) -> DataFrame:
    """Change of unfinished runs by scope from (scope_key, old, new) status transitions."""
    live = lambda c: (~F.col(c).isin("done", "failed", "cancelled") & F.col(c).isNotNull()).cast("long")
    move = F.coalesce(live("new"), F.lit(0)) - F.coalesce(live("old"), F.lit(0))
    return transitions.groupBy("scope_key").agg(F.sum(move).alias("delta"))


def retention_policy(event_age: int, run_age: int) -> tuple[int, int]:
    """Ages in microseconds after which events and runs go; a run's events may not outlive it."""
    if min(event_age, run_age) <= 0 or event_age > run_age:
        raise ValueError("ages are positive, and events are kept no longer than runs")
    return event_age, run_age


def prune_events(events: DataFrame, cutoff: int, batch: int) -> DataFrame:
    """The oldest events before the cutoff, at most batch of them."""
    return events.filter(F.col("occurred_at") < cutoff).orderBy("occurred_at", "run_id", "seq").limit(batch)


def prune_runs(runs: DataFrame, cutoff: int, batch: int) -> DataFrame:
    return runs.filter(F.col("finished_at") < cutoff).orderBy("finished_at", "id").limit(batch)


def prune_versions(versions: DataFrame, runs: DataFrame, keep: int = 10) -> DataFrame:
    """Versions past the newest keep of their graph that no run refers to."""
    names = ["scope_key", "graph_id", "graph_hash"]
    newest = Window.partitionBy("scope_key", "graph_id").orderBy(F.desc("inserted_at"), F.desc("graph_hash"))
    old = versions.withColumn("revision", F.row_number().over(newest)).filter(F.col("revision") > keep)
    return old.join(runs.select(*names).distinct(), names, "left_anti")


def fenced(proposals: DataFrame, runs: DataFrame) -> DataFrame:
    """Proposals with their outcome: committed for the first that matches the fence of its run, else why not."""
    now = runs.select("run_id", F.col("checkpoint_seq").alias("_seq"), F.col("claim_token").alias("_token"), F.col("status").alias("_status"))
    rows = proposals.join(now, "run_id", "left")
    matches = (F.col("expected_seq") == F.col("_seq")) & F.col("token").eqNullSafe(F.col("_token")) & (F.col("_status") == "running")
    rows = rows.withColumn("_ok", F.coalesce(matches, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("run_id", "_ok").orderBy("proposal_id"))
    outcome = (
        F.when(F.col("_status").isNull(), "not_found")
        .when(F.col("_ok") & (first == 1), "committed")
        .when(F.col("_status") != "running", "invalid")
        .otherwise("stale")
    )
    return rows.withColumn("outcome", outcome).select("proposal_id", "run_id", "outcome")


def misses(proposals: DataFrame, runs: DataFrame) -> DataFrame:
    """Why a claimed commit finds no row: the run is unknown, bound to another graph or start, or its fence moved; null if it does."""
    bound = ["graph_id", "graph_hash", "started_at"]
    now = runs.select("run_id", F.struct(*bound).alias("_bound"), F.col("checkpoint_seq").alias("_seq"), F.col("claim_token").alias("_token"))
    held = (F.col("expected_seq") == F.col("_seq")) & (F.col("token") == F.col("_token"))
    miss = (
        F.when(F.col("_seq").isNull(), "not_found")
        .when(~F.struct(*bound).eqNullSafe(F.col("_bound")), "invalid_commit")
        .when(~F.coalesce(held, F.lit(False)), "stale_fence")
    )
    return proposals.join(now, "run_id", "left").withColumn("miss", miss).drop("_bound", "_seq", "_token")


def rescheduled(claimed: DataFrame, now: int) -> DataFrame:
    """Claimed runs after a commit with an effect: retain, immediate, at (until), external or terminal."""
    effect = F.col("effect")
    return claimed.withColumns(
        {
            "claim_token": F.when(effect == "retain", F.col("claim_token")),
            "claimed_at": F.when(effect == "retain", F.lit(now)),
            "wake_at": F.when(effect == "immediate", F.lit(now)).when(effect == "at", F.col("until")),
            "tenant_admitted_at": F.when(effect.isin("retain", "immediate"), F.col("tenant_admitted_at")),
            "claim_attempts": F.lit(0),
            "claim_abandons": F.lit(0),
        }
    )


def cancel_unclaimed(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """Cancels by compare-and-set: lost if the run has moved on since it was read (expected_seq), unchanged if it is over."""
    rows = signals.select("run_id", "expected_seq").join(runs.select("run_id", "status", "checkpoint_seq"), "run_id")
    live = F.col("status").isin("running", "waiting")
    outcome = F.when(F.col("expected_seq") != F.col("checkpoint_seq"), "lost").when(live, "cancelled").otherwise("unchanged")
    rows = rows.withColumn("outcome", outcome)
    won = F.col("outcome") == "cancelled"
    return rows.select("run_id", "outcome", F.when(won, "cancelled").otherwise(F.col("status")).alias("status"), (F.col("checkpoint_seq") + won.cast("int")).alias("checkpoint_seq"))


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of each new event: inserted, the same as one stored, or in conflict with it."""
    keys = ["run_id", "seq"]
    rest = [c for c in new.columns if c not in keys]
    stored = log.select(*keys, F.struct(*rest).alias("_old"), F.lit(True).alias("_there"))
    same = F.struct(*rest).eqNullSafe(F.col("_old"))
    outcome = F.when(F.col("_there").isNull(), "inserted").when(same, "duplicate").otherwise("conflict")
    return new.join(stored, keys, "left").select(*keys, outcome.alias("outcome"))


def invariants(runs: DataFrame) -> DataFrame:
    """Violations of the rules every stored run obeys, by rule."""
    c = F.col
    terminal = c("status").isin("done", "failed", "cancelled")
    idle = c("claimed_at").isNull() & c("wake_at").isNull()
    rules = {
        "durable_status": ~c("status").isin("running", "waiting", "done", "failed", "cancelled"),
        "terminal_finished": terminal != c("finished_at").isNotNull(),
        "claim_pair": c("claimed_at").isNull() != c("claim_token").isNull(),
        "poison_pair": c("poisoned_at").isNull() != c("poison_reason").isNull(),
        "idle": (terminal | (c("status") == "waiting")) & ~idle,
        "poisoned": c("poisoned_at").isNotNull() & ((c("status") != "running") | ~idle),
        "scheduled": (c("status") == "running") & c("poisoned_at").isNull() & (c("wake_at").isNull() == c("claimed_at").isNull()),
        "counters": (c("claim_attempts") < 0) | (c("claim_abandons") < 0),
    }
    one = runs.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")
