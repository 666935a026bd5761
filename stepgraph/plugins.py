"""What a user can replace: how claims are chosen, where tables are kept, who is told of commits.

A claim policy turns the table of runs into a plan of claims; a store keeps named tables by version; observers are
told of each commit after it; telemetry counts the events that commits logged.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import admission, commits
from .sources.snapshots import checkpoint

LOG = logging.getLogger(__name__)


class Unavailable(Exception):
    """code: wrong_mode, read_only or locked."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


class ClaimPolicy(Protocol):
    """configure once, then for each batch: plan, decode the rows it gives, observe what became of them."""

    mode: str

    def configure(self, options: dict[str, Any]) -> None: ...

    def plan(self, runs: DataFrame, now: int, limit: int) -> DataFrame: ...

    def decode(self, rows: Sequence[Row]) -> list[dict[str, Any]]: ...

    def observe(self, claims: list[dict[str, Any]]) -> dict[str, int]: ...


@dataclass
class Legacy:
    """Blind to tenants.  A batch of one alternates between the classes."""

    ttl: int = 60_000_000
    max_attempts: int = 5
    preference: str = "ready"
    batches: int = 0
    mode: str = "legacy"

    def configure(self, options: dict[str, Any]) -> None:
        unknown = set(options) - {"ttl", "max_attempts"}
        if unknown:
            raise ValueError(f"unknown option {min(unknown)}")
        for name, value in options.items():
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ValueError(f"{name} must be a positive integer")
            setattr(self, name, value)

    def chosen(self, runs: DataFrame, now: int, limit: int) -> DataFrame:
        return admission.legacy(runs, now, limit, self.ttl, self.preference)

    def plan(self, runs: DataFrame, now: int, limit: int) -> DataFrame:
        self.batches += 1
        batch = f"{self.mode}-{now}-{self.batches}"
        return admission.outcomes(runs, self.chosen(runs, now, limit), now, self.max_attempts, batch, admit=self.mode == "windowed")

    def decode(self, rows: Sequence[Row]) -> list[dict[str, Any]]:
        return [r.asDict() for r in sorted(rows, key=lambda r: r["position"])]

    def observe(self, claims: list[dict[str, Any]]) -> dict[str, int]:
        leased = [c for c in claims if c["outcome"] == "leased"]
        if len(claims) == 1:
            self.preference = admission.next_preference(1, self.preference, bool(leased))
        return {"leased": len(leased), "poisoned": len(claims) - len(leased), "steals": sum(c["class"] == "expired" for c in leased)}


@dataclass
class Windowed(Legacy):
    """Fair between tenants."""

    mode: str = "windowed"
    seed: str = "0"

    def chosen(self, runs: DataFrame, now: int, limit: int) -> DataFrame:
        return admission.windowed(runs, now, limit, self.ttl, self.preference, self.seed)


class Store(Protocol):
    """Versions of named tables; SnapshotStore keeps them as files, MemoryStore in checkpoints."""

    def current(self) -> int: ...

    def read(self, name: str, version: int | None = None) -> DataFrame: ...

    def appended(self, name: str, version: int | None = None) -> DataFrame: ...

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int: ...


@dataclass
class MemoryStore:
    """Versions for as long as the session lasts."""

    spark: SparkSession
    versions: list[dict[str, DataFrame]] = field(default_factory=list)

    def current(self) -> int:
        return len(self.versions)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.versions[(version or self.current()) - 1][name]

    def appended(self, name: str, version: int | None = None) -> DataFrame:
        parts = [v[name] for v in self.versions[: version or self.current()] if name in v]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int:
        if self.current() != expected:
            raise RuntimeError(f"version {self.current()} is current, not {expected}")
        self.versions.append({name: checkpoint(df) for name, df in tables.items()})
        return self.current()


#: Called with the version and a few counts after each commit.
Observer = Callable[[int, dict[str, Any]], None]


def tell(observers: Iterable[Observer], version: int, counts: dict[str, Any]) -> None:
    """An observer that raises is logged: the commit stands, and the others are told."""
    for observer in observers:
        try:
            observer(version, counts)
        except Exception:
            LOG.exception("an observer of commit %s failed", version)


def telemetry(log: DataFrame) -> DataFrame:
    """(name, step, count) of the events of a log (run_id, seq, step, type, subject): node, run and checkpoint measures."""
    kind, verb = F.substring_index("type", "_", 1), F.expr("substr(type, instr(type, '_') + 1)")
    return log.groupBy(F.concat_ws(".", kind, verb).alias("name"), "step").agg(F.count(F.lit(1)).alias("count"))


class Leases:
    """Claims that act on the table runs of a store, and appends to events: each call is one commit, refused if another came first.

    read_only: reads only, every change is unavailable.  A policy of another mode than the store's is unavailable too.
    """

    def __init__(self, store: Store, policy: ClaimPolicy, mode: str = "legacy", read_only: bool = False, observers: Iterable[Observer] = ()) -> None:
        self.store, self.policy, self.mode, self.read_only, self.observers = store, policy, mode, read_only, list(observers)

    def _gate(self) -> DataFrame:
        if self.read_only:
            raise Unavailable("read_only")
        if self.policy.mode != self.mode:
            raise Unavailable("wrong_mode")
        return self.store.read("runs")

    def _commit(self, runs: DataFrame, version: int, **counts: Any) -> None:
        try:
            tell(self.observers, self.store.commit({"runs": runs}, version), counts)
        except RuntimeError as error:
            raise Unavailable("locked") from error

    def claim(self, now: int, limit: int) -> list[dict[str, Any]]:
        """The runs of one batch, those to work on and those that became poison."""
        runs, version = self._gate(), self.store.current()
        plan = checkpoint(self.policy.plan(runs, now, limit))  # at most limit rows
        claims = self.policy.decode(plan.collect())
        if claims:
            self._commit(commits.claimed(runs, plan), version, **self.policy.observe(claims))
        return claims

    def _mine(self, tokens: Sequence[str]) -> DataFrame:
        return self.store.read("runs").sparkSession.createDataFrame([(t,) for t in tokens], "claim_token string")

    def refresh(self, tokens: Sequence[str], now: int) -> None:
        """Later claim times for claims still held; a time never moves backward."""
        runs, version = self._gate(), self.store.current()
        mine = self._mine(tokens).distinct().withColumn("_mine", F.lit(True))
        later = F.when(F.col("_mine"), F.greatest("claimed_at", F.lit(now))).otherwise(F.col("claimed_at"))
        self._commit(runs.join(mine, "claim_token", "left").withColumn("claimed_at", later).select(*runs.columns), version)

    def abandon(self, tokens: Sequence[str], now: int, base: int = 1_000_000, cap: int = 60_000_000, max_abandons: int | None = None) -> None:
        """Claims handed back, with a backoff; max_abandons None never poisons."""
        runs, version = self._gate(), self.store.current()
        self._commit(commits.abandoned(runs, self._mine(tokens), now, base, cap, max_abandons), version)

    def retry_poisoned(self, run_id: str, now: int) -> bool:
        """False if the run is unknown or not poisoned."""
        runs, version = self._gate(), self.store.current()
        which = F.col("run_id") == run_id
        if runs.filter(which & F.col("poisoned_at").isNotNull()).isEmpty():
            return False
        self._commit(commits.retried(runs, which, now), version)
        return True

    def commit(self, proposals: DataFrame, now: int) -> DataFrame:
        """(proposal_id, outcome): proposals that hold become the runs' state, their events are appended, in one commit."""
        runs, version = self._gate(), self.store.current()
        judged = checkpoint(commits.judged(proposals, runs))
        new = {"runs": commits.committed(judged, runs, now), "events": commits.new_events(judged, self.store.appended("events"))}
        try:
            tell(self.observers, self.store.commit(new, version), {"proposals": judged.count()})
        except RuntimeError as error:
            raise Unavailable("locked") from error
        return judged.select("proposal_id", "outcome")

    def signal(self, change: Callable[[DataFrame], DataFrame], attempts: int = 3) -> int:
        """An unclaimed change by compare-and-set: the table is read again and the change made anew when another commit came first."""
        for left in range(attempts - 1, -1, -1):
            runs, version = self._gate(), self.store.current()
            try:
                self._commit(change(runs), version)
                return self.store.current()
            except Unavailable as error:
                if error.code != "locked" or not left:
                    raise
        raise ValueError("attempts must be at least 1")


class Dispatcher:
    """Polls for claims and works on them; polls asked for while one runs become one more."""

    def __init__(self, leases: Leases, work: Callable[[list[dict[str, Any]]], DataFrame | None], limit: int = 100) -> None:
        self.leases, self.work, self.limit, self.busy, self.asked = leases, work, limit, False, False

    def poll(self, now: int) -> int:
        """Claims until a batch comes back short of its limit; the number of runs that were leased."""
        if self.busy:
            self.asked = True
            return 0
        self.busy, done = True, 0
        try:
            while True:
                self.asked = False
                claims = self.leases.claim(now, self.limit)
                leased = [c for c in claims if c["outcome"] == "leased"]
                if leased:
                    done += len(leased)
                    proposals = self.work(leased)
                    if proposals is not None:
                        self.leases.commit(proposals, now)
                if len(claims) < self.limit and not self.asked:
                    return done
        finally:
            self.busy = False
