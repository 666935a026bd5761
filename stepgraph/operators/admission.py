"""Batch admission: which due runs to claim now, and what becomes of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POISON = "max_claim_attempts_exceeded"


def _ready(runs: DataFrame, now: int) -> DataFrame:
    return runs.filter((F.col("status") == "running") & F.col("poisoned_at").isNull() & (F.col("wake_at") <= now))


def _expired(runs: DataFrame, now: int, ttl: int, limit: int) -> DataFrame:
    """The oldest expired claims; one exactly ttl old is not expired."""
    old = runs.filter((F.col("status") == "running") & F.col("poisoned_at").isNull() & (F.col("claimed_at") < now - ttl))
    page = old.select("id", F.lit("expired").alias("class"), F.col("claimed_at").alias("eligible_at")).orderBy("eligible_at", "id").limit(limit)
    return page.withColumn("scope_rank", F.lit(1))


def _chosen(pages: DataFrame, within: list[str], last: list[str], limit: int, preference: str) -> DataFrame:
    """At most 2 x limit rows come in, so the windows below are small whatever the queue holds."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy(*within))
    ranked = pages.withColumn("class_rank", rank)
    head = (F.col("class_rank") > 1) if limit >= 2 else (F.col("class") != preference)
    order = Window.orderBy(head.cast("int"), *last)
    return ranked.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def legacy(runs: DataFrame, now: int, limit: int, ttl: int, preference: str = "ready") -> DataFrame:
    """(id, class, eligible_at, class_rank, position), blind to tenants: oldest of each class first, then by age."""
    ready = _ready(runs, now).select("id", F.lit("ready").alias("class"), F.col("wake_at").alias("eligible_at"))
    page = ready.orderBy("eligible_at", "id").limit(limit).withColumn("scope_rank", F.lit(1))
    both = page.unionByName(_expired(runs, now, ttl, limit))
    return _chosen(both, ["eligible_at", "id"], ["eligible_at", "id"], limit, preference).drop("scope_rank")


def windowed(runs: DataFrame, now: int, limit: int, ttl: int, preference: str = "ready", seed: str = "0") -> DataFrame:
    """As legacy, but fair: at most limit scopes (by a keyed hash), breadth first over them, admitted runs first."""
    ready = _ready(runs, now)
    scopes = ready.select("scope_key").distinct().withColumn("h", F.md5(F.concat("scope_key", F.lit("|"), F.lit(seed))))
    scopes = scopes.orderBy("h", "scope_key").limit(limit)
    first = F.when(F.col("tenant_admitted_at").isNotNull(), 0).otherwise(1)
    scope_rank = F.row_number().over(Window.partitionBy("scope_key").orderBy(first, "wake_at", "id"))
    page = (
        ready.join(F.broadcast(scopes), "scope_key", "left_semi")  # at most limit scopes
        .withColumn("scope_rank", scope_rank)
        .filter(F.col("scope_rank") <= limit)
        .select("id", F.lit("ready").alias("class"), F.col("wake_at").alias("eligible_at"), "scope_rank")
        .orderBy("scope_rank", "eligible_at", "id")
        .limit(limit)
    )
    both = page.unionByName(_expired(runs, now, ttl, limit))
    return _chosen(both, ["scope_rank", "eligible_at", "id"], ["class_rank", "eligible_at", "id"], limit, preference)


def token(batch: str) -> Column:
    parts = ["run_id", "checkpoint_seq", "claim_attempts"]
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts], F.lit(batch)), 256)


def outcomes(runs: DataFrame, chosen: DataFrame, now: int, max_attempts: int, batch: str, admit: bool = False) -> DataFrame:
    """The claimed runs: a lease with a fresh token, or poison when the attempts are used up.  admit: the windowed engine."""
    fresh = F.col("claim_attempts") < max_attempts
    return runs.join(F.broadcast(chosen.select("id", "class", "position")), "id").select(  # at most the limit of a batch
        "id",
        "run_id",
        "class",
        "position",
        F.when(fresh, "leased").otherwise("poisoned").alias("outcome"),
        F.when(fresh, token(batch)).alias("claim_token"),
        F.when(fresh, F.lit(now)).alias("claimed_at"),
        F.when(fresh, F.col("claim_attempts") + 1).otherwise(F.col("claim_attempts")).alias("claim_attempts"),
        F.when(~fresh, F.lit(now)).alias("poisoned_at"),
        F.when(~fresh, F.lit(POISON)).alias("poison_reason"),
        (F.when(fresh, F.coalesce("tenant_admitted_at", F.lit(now))) if admit else F.col("tenant_admitted_at")).alias("tenant_admitted_at"),
    )


def stats(runs: DataFrame, now: int, ttl: int, chosen: DataFrame) -> DataFrame:
    """Candidates, selected, steals (of claims of others that had expired) and the age of the oldest by class."""
    ready = _ready(runs, now).select("id", F.lit("ready").alias("class"), F.col("wake_at").alias("at"))
    old = runs.filter((F.col("status") == "running") & F.col("poisoned_at").isNull() & (F.col("claimed_at") < now - ttl))
    both = ready.unionByName(old.select("id", F.lit("expired").alias("class"), F.col("claimed_at").alias("at")))
    picked = chosen.groupBy("class").agg(F.count(F.lit(1)).alias("selected"))
    all_ = both.groupBy("class").agg(F.count(F.lit(1)).alias("candidates"), (F.lit(now) - F.min("at")).alias("oldest_age"))
    return all_.join(picked, "class", "left").select(
        "class", "candidates", F.coalesce("selected", F.lit(0)).alias("selected"), F.when(F.col("class") == "expired", F.coalesce("selected", F.lit(0))).otherwise(0).alias("steals"), "oldest_age"
    )


def refreshed(claims: DataFrame, now: int) -> DataFrame:
    """A claim's time never moves backward."""
    return claims.withColumn("claimed_at", F.greatest("claimed_at", F.lit(now)))


def released(claims: DataFrame, wake_at: int) -> DataFrame:
    gone = {"claim_token": F.lit(None).cast("string"), "claimed_at": F.lit(None).cast("long"), "wake_at": F.lit(wake_at)}
    return claims.withColumns(gone)


def backoff(base: int, cap: int, doublings: int = 30) -> Column:
    """min(base x 2 ^ min(abandons, doublings), cap)"""
    exponent = F.least(F.col("claim_abandons"), F.lit(doublings))
    return F.least(F.lit(base) * F.pow(F.lit(2.0), exponent), F.lit(float(cap))).cast("long")


def abandoned(claims: DataFrame, now: int, max_abandons: int, base: int, cap: int) -> DataFrame:
    """Hands an attempt back; poison once the abandons reach their most, else a wake after the backoff."""
    out = F.col("claim_abandons") + 1 >= max_abandons
    return claims.select(
        "id",
        F.when(out, "poisoned").otherwise("rescheduled").alias("outcome"),
        (F.col("claim_abandons") + 1).alias("claim_abandons"),
        F.greatest(F.col("claim_attempts") - 1, F.lit(0)).alias("claim_attempts"),
        F.when(~out, F.lit(now) + backoff(base, cap)).alias("wake_at"),
        F.when(out, F.lit("max_claim_abandons_exceeded")).alias("poison_reason"),
    )


def recovered(runs: DataFrame, now: int) -> DataFrame:
    """Poisoned runs back in the queue with clean counters."""
    return runs.filter("poisoned_at is not null").select(
        "id", F.lit(now).alias("wake_at"), F.lit(0).alias("claim_attempts"), F.lit(0).alias("claim_abandons")
    )


def queue_view(now: int, ttl: int) -> Column:
    cases = [
        (F.col("poisoned_at").isNotNull(), "poisoned"),
        (F.col("claimed_at") < now - ttl, "recoverable"),
        (F.col("claimed_at").isNotNull(), "claimed"),
        (F.col("wake_at") <= now, "ready"),
        (F.col("wake_at").isNotNull(), "scheduled"),
    ]
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0])).otherwise(F.col("status"))


def next_preference(limit: int, preference: str, claimed: bool) -> str:
    """Claims of a single run take turns between the classes; a failed claim does not use up a turn."""
    if limit != 1 or not claimed:
        return preference
    return "expired" if preference == "ready" else "ready"
