"""The engine behind one object: saved graphs, runs, signals and reads, kept apart by tenant.

Graph versions are appended to one table; the runs of a graph version live in a shell of their own, as their columns
follow from its fields.  Runs advance when they are started, answered or cancelled, by DataFrames of any size:
start_run is start_runs for one row.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.store import limit_of
from .plans import wire
from .plans.engine import Engine
from .plans.graph import Graph
from .sources.snapshots import SnapshotStore
from .streaming.shell import OVER, RunShell

GRAPHS = "graph_id string, graph_hash string, document string, inserted_at long"
REST = ("running", "waiting", *OVER)


class RuntimeFault(Exception):
    """code: not_found, invalid_tenant, invalid_graph, invalid_input, already_exists, inactive_run, invalid_value or graph_content_conflict."""

    def __init__(self, code: str, about: str = "") -> None:
        super().__init__(f"{code}: {about}" if about else code)
        self.code = code


@dataclass(frozen=True)
class GraphRef:
    graph_id: str
    graph_hash: str


class Runtime:
    """tenant_mode none forbids a tenant, required demands one; the tenants share nothing but the base folder."""

    def __init__(self, spark: SparkSession, base: str, registry: wire.Registry, tenant_mode: str = "none", tenant_id: str | None = None) -> None:
        if tenant_mode not in ("none", "required"):
            raise RuntimeFault("invalid_tenant", f"unknown mode {tenant_mode}")
        if (tenant_mode == "required") != bool(tenant_id):
            raise RuntimeFault("invalid_tenant", "a tenant is needed" if tenant_mode == "required" else "no tenant is accepted")
        scope = "tenantless" if tenant_id is None else f"tenant-{tenant_id.encode().hex()}"
        self.spark, self.registry, self.base = spark, registry, f"{base.rstrip('/')}/{scope}"
        self._graphs = SnapshotStore(spark, f"{self.base}/graphs")
        self._shells: dict[str, RunShell] = {}

    # Graphs

    def _versions(self) -> DataFrame:
        return self._graphs.appended("graphs") if self._graphs.current() else self.spark.createDataFrame([], GRAPHS)

    def save_graph(self, graph: Graph) -> GraphRef:
        """Publishing the same graph again gives the same reference and stores nothing."""
        errors = [d for d in graph.verify() if d.severity == "error"]
        if errors:
            raise RuntimeFault("invalid_graph", "; ".join(f"{d.code} at {d.where}" for d in errors))
        ref, document = GraphRef(graph.id, graph.hash()), wire.to_json(graph)
        stored = self._versions().filter((F.col("graph_id") == ref.graph_id) & (F.col("graph_hash") == ref.graph_hash)).select("document").first()
        if stored is not None:
            if wire.from_json(stored.document, self.registry).canonical() != graph.canonical():
                raise RuntimeFault("graph_content_conflict", ref.graph_hash)
            return ref
        row = self.spark.createDataFrame([(ref.graph_id, ref.graph_hash, document, time.time_ns() // 1000)], GRAPHS)
        self._graphs.commit({"graphs": row}, self._graphs.current())
        return ref

    def fetch_graph(self, ref: GraphRef) -> Graph:
        row = self._versions().filter((F.col("graph_id") == ref.graph_id) & (F.col("graph_hash") == ref.graph_hash)).first()
        if row is None:
            raise RuntimeFault("not_found", ref.graph_hash)
        graph = wire.from_json(row.document, self.registry)
        if graph.hash() != ref.graph_hash:
            raise RuntimeFault("graph_content_conflict", ref.graph_hash)
        return graph

    def list_graph_versions(self, graph_id: str, limit: int = 100, before: tuple[int, str] | None = None) -> DataFrame:
        """Newest first, one row more than the page if there is another."""
        rows = self._versions().filter(F.col("graph_id") == graph_id).select("graph_id", "graph_hash", "inserted_at")
        if before is not None:
            rows = rows.filter((F.col("inserted_at") < before[0]) | ((F.col("inserted_at") == before[0]) & (F.col("graph_hash") < before[1])))
        return rows.orderBy(F.desc("inserted_at"), F.desc("graph_hash")).limit(limit_of(limit) + 1)

    def fetch_latest_graph_ref(self, graph_id: str) -> GraphRef:
        row = self.list_graph_versions(graph_id, 1).first()
        if row is None:
            raise RuntimeFault("not_found", graph_id)
        return GraphRef(row.graph_id, row.graph_hash)

    # Runs

    def _shell(self, ref: GraphRef) -> RunShell:
        if ref.graph_hash not in self._shells:
            self._shells[ref.graph_hash] = RunShell(self.spark, Engine(self.fetch_graph(ref)), f"{self.base}/runs/{ref.graph_hash}")
        return self._shells[ref.graph_hash]

    def _signal(self, shell: RunShell, rows: DataFrame) -> None:
        shell.process(rows, shell.store.current())

    def _signals(self, shell: RunShell, rows: DataFrame, kind: str) -> DataFrame:
        """Signals of one kind, absent inputs null."""
        given: dict[str, Column] = {"kind": F.lit(kind), "run_id": F.col("run_id").cast("string")}
        kinds: dict[str, Any] = {"node": T.StringType(), "value": T.StringType()} | {k: f.schema.spark_type() for k, f in shell.engine.graph.inputs.items()}
        for name, of in kinds.items():
            given[name] = F.col(name).cast(of) if name in rows.columns else F.lit(None).cast(of)
        return rows.select(*[c.alias(k) for k, c in given.items()])

    def start_runs(self, ref: GraphRef, inputs: DataFrame) -> None:
        """One run for each row of (run_id, inputs); columns that are no inputs are refused, known run ids ignored."""
        shell = self._shell(ref)
        extra = set(inputs.columns) - {"run_id", *shell.engine.graph.inputs}
        if extra:
            raise RuntimeFault("invalid_input", f"unknown {', '.join(sorted(extra))}")
        self._signal(shell, self._signals(shell, inputs, "start"))

    def start_run(self, ref: GraphRef, given: dict[str, Any], run_id: str | None = None) -> str:
        shell, run_id = self._shell(ref), run_id or uuid.uuid4().hex
        inputs = shell.engine.graph.inputs
        unknown, missing = set(given) - set(inputs), [k for k, f in inputs.items() if f.required and f.default is None and given.get(k) is None]
        if unknown or missing:
            raise RuntimeFault("invalid_input", f"unknown {sorted(unknown)}, missing {sorted(missing)}")
        if shell.store.current() and not shell.runs().filter(F.col("run_id") == run_id).isEmpty():
            raise RuntimeFault("already_exists", run_id)
        kinds = T.StructType([T.StructField("run_id", T.StringType()), *[T.StructField(k, inputs[k].schema.spark_type()) for k in given]])
        self.start_runs(ref, self.spark.createDataFrame([(run_id, *given.values())], kinds))
        return run_id

    def _live(self, ref: GraphRef, run_id: str) -> tuple[RunShell, Row]:
        shell = self._shell(ref)
        row = shell.runs().filter(F.col("run_id") == run_id).first() if shell.store.current() else None
        if row is None:
            raise RuntimeFault("not_found", run_id)
        return shell, row

    def resolve_interrupts(self, ref: GraphRef, answers: DataFrame) -> None:
        """Answers (run_id, node, value); those that do not apply are ignored."""
        shell = self._shell(ref)
        self._signal(shell, self._signals(shell, answers, "resolve"))

    def resolve_interrupt(self, ref: GraphRef, run_id: str, node: str, value: str) -> Row:
        shell, row = self._live(ref, run_id)
        answer = self.spark.createDataFrame([(run_id, node, value)], "run_id string, node string, value string")
        fate = shell.engine.resolutions(shell.runs().filter(F.col("run_id") == run_id), answer).first()
        if fate is None or fate.outcome != "resolved":
            raise RuntimeFault("inactive_run" if row.status in OVER else fate.outcome if fate else "not_found", node)
        self.resolve_interrupts(ref, answer)
        return self.fetch_run(ref, run_id)

    def cancel_run(self, ref: GraphRef, run_id: str) -> Row:
        """A run that is cancelled already stays so; one that is done or failed is refused."""
        shell, row = self._live(ref, run_id)
        if row.status in ("done", "failed"):
            raise RuntimeFault("inactive_run", run_id)
        if row.status != "cancelled":
            one = self.spark.createDataFrame([(run_id,)], "run_id string")
            self._signal(shell, self._signals(shell, one, "cancel"))
        return self.fetch_run(ref, run_id)

    def drain_runs(self, ref: GraphRef) -> bool:
        """Advances what is running until all runs rest; False if nothing was running."""
        shell = self._shell(ref)
        if not shell.store.current() or shell.store.read("live").filter("status = 'running'").isEmpty():
            return False
        none = self.spark.createDataFrame([], "run_id string")
        self._signal(shell, self._signals(shell, none, "start"))
        return True

    # Reads

    def fetch_run(self, ref: GraphRef, run_id: str) -> Row:
        """Status, step and outputs."""
        shell, _ = self._live(ref, run_id)
        return shell.engine.outputs(shell.runs().filter(F.col("run_id") == run_id)).first()

    def inspect_run(self, ref: GraphRef, run_id: str) -> Row:
        """All of a run's state: values, versions, active edges, attempts."""
        return self._live(ref, run_id)[1]

    def await_run(self, ref: GraphRef, run_id: str, timeout: float = 60, poll: float = 0.5) -> Row:
        """Until the run waits or is over."""
        until = time.monotonic() + timeout
        while (row := self.fetch_run(ref, run_id)).status == "running":
            if time.monotonic() > until:
                raise TimeoutError(run_id)
            time.sleep(poll)
        return row

    def list_runs(self, ref: GraphRef, limit: int = 100, statuses: tuple[str, ...] = (), before: tuple[int, str] | None = None) -> DataFrame:
        """Newest first, one row more than the page if there is another."""
        wrong = [s for s in statuses if s not in REST]
        if wrong:
            raise ValueError(f"unknown status {wrong[0]}")
        shell, most = self._shell(ref), limit_of(limit) + 1
        if not shell.store.current():
            return self.spark.createDataFrame([], "run_id string, status string, step int, code string, waiting string, started_at long, updated_at long")
        rows = shell.runs().select("run_id", "status", "step", "code", "waiting", "started_at", "updated_at")
        if statuses:
            rows = rows.filter(F.col("status").isin(*statuses))
        if before is not None:
            rows = rows.filter((F.col("started_at") < before[0]) | ((F.col("started_at") == before[0]) & (F.col("run_id") < before[1])))
        return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(most)

    def fetch_latest_run(self, ref: GraphRef, statuses: tuple[str, ...] = ()) -> Row:
        row = self.list_runs(ref, 1, statuses).first()
        if row is None:
            raise RuntimeFault("not_found", ref.graph_id)
        return row

    def list_events(self, ref: GraphRef, run_id: str, after: int = 0, limit: int = 250) -> DataFrame:
        shell, _ = self._live(ref, run_id)
        rows = shell.events().filter((F.col("run_id") == run_id) & (F.col("seq") > after))
        return rows.orderBy("seq").limit(limit_of(limit))

    def fetch_event(self, ref: GraphRef, run_id: str, seq: int) -> Row:
        row = self.list_events(ref, run_id, seq - 1, 1).first()
        if row is None or row.seq != seq:
            raise RuntimeFault("not_found", f"event {seq}")
        return row

    def fetch_latest_event(self, ref: GraphRef, run_id: str) -> Row | None:
        """None for a run without events."""
        shell, _ = self._live(ref, run_id)
        return shell.events().filter(F.col("run_id") == run_id).orderBy(F.desc("seq")).first()


# Without a store


def run_inline(spark: SparkSession, graph: Graph, inputs: DataFrame, key: str) -> tuple[Engine, DataFrame]:
    engine = Engine(graph)
    return engine, engine.run(engine.start(inputs, key))


def step_inline(engine: Engine, runs: DataFrame, steps: int = 1) -> DataFrame:
    for _ in range(steps):
        runs = engine.step(runs)
    return runs


def resolve_interrupt_inline(engine: Engine, runs: DataFrame, answers: DataFrame) -> DataFrame:
    return engine.run(engine.resolve(runs, answers))


def resume_inline(engine: Engine, runs: DataFrame, now: int) -> DataFrame:
    """Parked runs that are due by now, in milliseconds, and all others that run."""
    return engine.run(runs, now=now)
