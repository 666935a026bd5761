"""Commits that act on the store's tables: fenced moments, claims, retention.

Each takes the tables as they are and gives the tables as they become, for the caller to write in one commit of a
SnapshotStore.  What changes is joined to the tables by key; the rest of a row passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TERMINAL = ("done", "failed", "cancelled")
STATUSES = ("running", "waiting", *TERMINAL)
#: What a run is bound to from its start to its end.
BOUND = ("scope_key", "graph_id", "graph_hash", "started_at")
#: Fields of a proposal that a commit writes to its run.
WRITTEN = ("status", "step", "checkpoint_seq", "updated_at", "finished_at")


def schedule_fits(effect: Column, status: Column, until: Column, claimed: bool = True) -> Column:
    """Whether a schedule effect is one that a run of that status may have."""
    held = effect.isin("retain", "immediate") if claimed else effect == "immediate"
    running = held | ((effect == "at") & until.isNotNull())
    return F.coalesce(
        F.when(status == "running", running).when(status == "waiting", effect == "external").when(status.isin(*TERMINAL), effect == "terminal"), F.lit(False)
    )


def durable_problem(status: Column, step: Column, seq: Column, started: Column, updated: Column, finished: Column) -> Column:
    """Why a run may not be stored; null if it may."""
    return (
        F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "invalid_status")
        .when(~F.coalesce((step >= 0) & (seq >= 0), F.lit(False)), "invalid_counters")
        .when(started.isNull() | updated.isNull(), "invalid_times")
        .when(status.isin(*TERMINAL) != finished.isNotNull(), "invalid_finish")
    )


def proposal_problem(claimed: bool = True) -> Column:
    """Why a proposal cannot be tried: the sequence does not follow, there is no token, the schedule does not fit or the run is not durable."""
    c = F.col
    token = F.when(F.coalesce(F.length("token") == 0, F.lit(True)), "invalid_token") if claimed else F.lit(None).cast("string")
    return F.coalesce(
        token,
        F.when(~F.coalesce(c("checkpoint_seq") == c("expected_seq") + 1, F.lit(False)), "invalid_sequence"),
        F.when(~schedule_fits(c("effect"), c("status"), c("until"), claimed), "invalid_schedule"),
        durable_problem(c("status"), c("step"), c("checkpoint_seq"), c("started_at"), c("updated_at"), c("finished_at")),
    )


def judged(proposals: DataFrame, runs: DataFrame) -> DataFrame:
    """proposals with their outcome: invalid ones, unknown runs, other bindings, moved fences, and committed for the first that holds."""
    now = runs.select("run_id", F.struct(*BOUND).alias("_bound"), F.col("checkpoint_seq").alias("_seq"), F.col("claim_token").alias("_token"))
    rows = proposals.withColumn("problem", proposal_problem()).join(now, "run_id", "left")
    held = F.coalesce((F.col("expected_seq") == F.col("_seq")) & (F.col("token") == F.col("_token")), F.lit(False))
    miss = (
        F.when(F.col("problem").isNotNull(), "invalid_transition")
        .when(F.col("_seq").isNull(), "not_found")
        .when(~F.struct(*BOUND).eqNullSafe(F.col("_bound")), "invalid_commit")
        .when(~held, "stale_fence")
    )
    rows = rows.withColumn("_miss", miss)
    first = F.row_number().over(Window.partitionBy("run_id", "_miss").orderBy("proposal_id"))
    return rows.withColumn("outcome", F.coalesce("_miss", F.when(first == 1, "committed").otherwise("stale_fence"))).drop("_bound", "_seq", "_token", "_miss")


def committed(proposals: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """runs after the proposals (from judged) that commit: their fields and what their schedule effect does to the claim."""
    effect = F.col("_p.effect")
    keep = lambda name, held: F.when(held, F.col(name))
    claim = {
        "claim_token": keep("claim_token", effect == "retain"),
        "claimed_at": F.when(effect == "retain", F.lit(now)),
        "wake_at": F.when(effect == "immediate", F.lit(now)).when(effect == "at", F.col("_p.until")),
        "tenant_admitted_at": keep("tenant_admitted_at", effect.isin("retain", "immediate")),
        "claim_attempts": F.lit(0),
        "claim_abandons": F.lit(0),
    }
    won = proposals.filter("outcome = 'committed'").select("run_id", F.struct(*WRITTEN, "effect", "until").alias("_p"))
    there = F.col("_p").isNotNull()
    changes = {name: F.when(there, F.col(f"_p.{name}")).otherwise(F.col(name)) for name in WRITTEN}
    changes |= {name: F.when(there, of).otherwise(F.col(name)) for name, of in claim.items()}
    kinds = {f.name: f.dataType for f in runs.schema.fields}
    return runs.join(won, "run_id", "left").withColumns({k: c.cast(kinds[k]) for k, c in changes.items()}).select(*runs.columns)


def new_events(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, seq, type, occurred_at) of the proposals that commit, numbered on from the last event of their run; events holds an array of types."""
    last = events.groupBy("run_id").agg(F.max("seq").alias("_last"))
    won = proposals.filter("outcome = 'committed'").select("run_id", "updated_at", F.posexplode("events").alias("_at", "type")).join(last, "run_id", "left")
    return won.select("run_id", (F.coalesce("_last", F.lit(0)) + F.col("_at") + 1).cast("long").alias("seq"), "type", F.col("updated_at").alias("occurred_at"))


def claimed(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """runs after a batch of admission.outcomes: leases and poison take a run's wake."""
    names = ["claim_token", "claimed_at", "claim_attempts", "poisoned_at", "poison_reason", "tenant_admitted_at"]
    new = outcomes.select("id", F.struct(*names).alias("_new"))  # at most the limit of a batch
    there = F.col("_new").isNotNull()
    kinds = {f.name: f.dataType for f in runs.schema.fields}
    changes = {n: F.when(there, F.col(f"_new.{n}")).otherwise(F.col(n)).cast(kinds[n]) for n in names}
    changes["wake_at"] = F.when(~there, F.col("wake_at"))
    return runs.join(F.broadcast(new), "id", "left").withColumns(changes).select(*runs.columns)


def retried(runs: DataFrame, which: Column, now: int) -> DataFrame:
    """runs with the poisoned ones among which back in the queue, their counters clean."""
    again = F.col("poisoned_at").isNotNull() & F.coalesce(which, F.lit(False))
    kinds = {f.name: f.dataType for f in runs.schema.fields}
    new = {"wake_at": F.lit(now), "poisoned_at": F.lit(None), "poison_reason": F.lit(None), "claim_attempts": F.lit(0), "claim_abandons": F.lit(0)}
    return runs.withColumns({k: F.when(again, v).otherwise(F.col(k)).cast(kinds[k]) for k, v in new.items()})


def abandoned(runs: DataFrame, tokens: DataFrame, now: int, base: int, cap: int, max_abandons: int | None = None) -> DataFrame:
    """runs whose claims (claim_token of tokens) are handed back, to wake after a backoff; poison at max_abandons, never if that is None.

    Runs without a claim are not joined: their null tokens match nothing and would all go to one task.
    """
    mine = tokens.dropna(subset=["claim_token"]).select("claim_token", F.lit(True).alias("_mine")).distinct()
    there = F.coalesce("_mine", F.lit(False))
    n = F.col("claim_abandons") + 1
    out = there & (n >= max_abandons) if max_abandons is not None else F.lit(False)
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("claim_abandons"), F.lit(30))), F.lit(float(cap))).cast("long")
    kinds = {f.name: f.dataType for f in runs.schema.fields}
    new = {
        "claim_token": F.when(~there, F.col("claim_token")),
        "claimed_at": F.when(~there, F.col("claimed_at")),
        "wake_at": F.when(there & ~out, F.lit(now) + wait).when(~there, F.col("wake_at")),
        "claim_abandons": F.when(there, n).otherwise(F.col("claim_abandons")),
        "claim_attempts": F.when(there, F.greatest(F.col("claim_attempts") - 1, F.lit(0))).otherwise(F.col("claim_attempts")),
        "poisoned_at": F.when(out, F.lit(now)).otherwise(F.col("poisoned_at")),
        "poison_reason": F.when(out, F.lit("max_claim_abandons_exceeded")).otherwise(F.col("poison_reason")),
    }
    held = runs.filter("claim_token is not null").join(mine, "claim_token", "left")
    held = held.withColumns({k: v.cast(kinds[k]) for k, v in new.items()}).select(*runs.columns)
    return held.unionByName(runs.filter("claim_token is null"))


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that more than one row has; null keys are no duplicates."""
    there = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return there.filter("n > 1")


def retention(runs: DataFrame, events: DataFrame, versions: DataFrame, event_cutoff: int, run_cutoff: int, batch: int, keep: int = 10) -> dict[str, DataFrame]:
    """One pass: the oldest events before their cutoff, then the oldest terminal runs before theirs with all their events left, then
    graph versions past the newest keep that no run left refers to; at most batch of each but of a run's events.

    Gives the tables that remain (runs, events, versions) and counts (events_deleted, runs_deleted,
    cascade_events_deleted, graphs_deleted).  A time equal to a cutoff stays.
    """
    old = events.filter(F.col("occurred_at") < event_cutoff).orderBy("occurred_at", "run_id", "seq").limit(batch).select("run_id", "seq")
    kept = events.join(old, ["run_id", "seq"], "left_anti")
    over = runs.filter(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < run_cutoff)).orderBy("updated_at", "id").limit(batch).select("id", "run_id")
    cascade = kept.join(over.select("run_id"), "run_id", "left_semi")
    left = runs.join(over.select("id"), "id", "left_anti")
    names = ["scope_key", "graph_id", "graph_hash"]
    newest = Window.partitionBy("scope_key", "graph_id").orderBy(F.desc("inserted_at"), F.desc("graph_hash"))
    unused = versions.withColumn("_revision", F.row_number().over(newest)).filter(F.col("_revision") > keep).join(left.select(*names).distinct(), names, "left_anti")
    unused = unused.orderBy("inserted_at", "graph_hash", "scope_key", "graph_id").limit(batch).select(*names)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(old, "events_deleted")
    for df, name in ((over, "runs_deleted"), (cascade, "cascade_events_deleted"), (unused, "graphs_deleted")):
        counts = counts.join(one(df, name))  # of one row each
    return {
        "runs": left,
        "events": kept.join(over.select("run_id"), "run_id", "left_anti"),
        "versions": versions.join(unused, names, "left_anti"),
        "counts": counts,
    }
