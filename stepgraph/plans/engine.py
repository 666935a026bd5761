"""Supersteps over many runs at once: a compiled graph advances a DataFrame of runs by narrow projections.

A run is a row.  Field f has the columns v_f (value) and n_f (version; 0 is unset), w_f says whether the last
step wrote it; edge e has a_e (active) and, for a fan-in, s_e (sources completed since it last fired).  A step
reads only committed columns, folds the writes of all active nodes in the order of their ids, evaluates guards
on the result, and moves on, without a shuffle.  Acyclic graphs unroll into one plan; cyclic ones are
checkpointed every few steps and stop when no run is active.

A node that may fail has t_n (its next attempt) and k_n (it succeeded and is held while a sibling is tried again); one
with a backoff f_n too, the time before which it is not tried.  Such runs have a clock, in milliseconds: a step tries
what is due by it, and a run in which nothing is due is parked until wake_at, the earliest of these times.  A node of
user code has u_n, what its last attempt gave, and its runs why, the reason of the last failure.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import Channel, to_column
from ..functions.schemas import Schema, violations
from ..sources.snapshots import checkpoint, spread
from . import calls
from .graph import FINISH, START, Field, Graph, Reducer

HOST_LIMIT = 100


@dataclass(frozen=True)
class View:
    """What a node sees: committed values, with defaults for fields never written."""

    graph: Graph
    attempt: Column

    def __getitem__(self, name: str) -> Column:
        return F.col(f"v_{name}")

    def version(self, name: str) -> Column:
        return F.col(f"n_{name}")


def write_schema(f: Field) -> Schema:
    """What one write must satisfy: bounds of a list or a sum hold for the declared field, not for each write."""
    s = f.schema
    if f.reducer.kind in ("append", "union"):
        return Schema("list", item=s.item)
    if f.reducer.kind == "sum":
        return Schema(s.kind)
    if f.reducer.kind == "merge" and s.kind == "object":
        return replace(s, required=False, fields={k: replace(v, required=False) for k, v in s.fields.items()})
    return s


def _identity(schema: Schema, x: Column, by: tuple[str, ...]) -> Column:
    """What tells one list element from another: its value at the path, or the whole element where there is none."""
    at, there = x, F.lit(True)
    for name in by:
        if schema.kind == "object" and name in schema.fields:
            at, schema = at.getField(name), schema.fields[name]
            there = there & at.isNotNull()
        elif schema.kind == "map":
            there = there & F.coalesce(F.map_contains_key(at, name), F.lit(False))
            at, schema = F.try_element_at(at, F.lit(name)), Schema("string")
        else:
            return F.to_json(F.struct(x.alias("value")))
    return F.when(there, F.to_json(F.struct(at.alias("key")))).otherwise(F.to_json(F.struct(x.alias("value"))))


def _merged(schema: Schema, left: Column, right: Column, deep: bool) -> Column:
    """Right wins.  A typed object has no absent fields, so there a null on the right leaves the left."""
    if schema.kind == "map":
        return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
    parts = []
    for name, inner in schema.fields.items():
        a, b = left.getField(name), right.getField(name)
        both = _merged(inner, a, b, deep) if deep and inner.kind in ("map", "object") else b
        parts.append((F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(b, a))).alias(name))
    return F.struct(*parts)


def parsed(value: Column, schema: Schema) -> Column:
    """Text as a value of a schema; null for what is none, which is told from no text by the caller."""
    return F.from_json(value, schema.spark_type()) if schema.kind in ("list", "map", "object") else value.try_cast(schema.spark_type())


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


class Engine:
    def __init__(self, graph: Graph, host_limit: int = HOST_LIMIT) -> None:
        errors = [d for d in graph.verify() if d.severity == "error"]
        if errors:
            raise ValueError("; ".join(f"{d.code} at {d.where}" for d in errors))
        self.graph, self.limit = graph, graph.max_supersteps or host_limit
        self.nodes = sorted(graph.nodes)
        self.edges = sorted(graph.edges)
        self.flaky = [n for n in self.nodes if graph.nodes[n].fails or graph.nodes[n].call]
        self.called = [n for n in self.nodes if graph.nodes[n].call]
        self.later = [n for n in self.flaky if graph.nodes[n].backoff_ms]

    def _kinds(self, name: str) -> dict:
        return {f: self.graph.fields[f].schema.spark_type() for f in self.graph.nodes[name].writes}

    def _asks(self, name: str) -> Column | None:
        """Whether an attempt of the node interrupts, if it can."""
        node = self.graph.nodes[name]
        if node.call:
            return F.col(f"u_{name}.status") == "interrupt" if node.resume else None
        return node.interrupts(self._view(name)) if node.interrupts else None

    def _fails(self, name: str) -> Column:
        node = self.graph.nodes[name]
        if not node.call:
            return node.fails(self._view(name))
        status = F.col(f"u_{name}.status")
        return (status == "error") | (status == "interrupt") if not node.resume else status == "error"

    def _writes(self, name: str) -> dict[str, tuple[Column, Column]]:
        """By field, whether the node writes it and what."""
        node = self.graph.nodes[name]
        if node.call:
            return {f: (F.coalesce(F.col(f"u_{name}.p_{f}"), F.lit(False)), F.col(f"u_{name}.v_{f}")) for f in node.writes}
        return {f: (F.lit(True), of(self._view(name))) for f, of in node.update.items()}

    def _view(self, name: str) -> View:
        return View(self.graph, F.col(f"t_{name}") if name in self.flaky else F.lit(1))

    def _zero(self, name: str) -> Column:
        f = self.graph.channels()[name]
        kind = f.schema.spark_type()
        value = f.default
        if value is None and f.reducer.kind == "sum":
            value = 0
        if value is None and f.reducer.kind in ("append", "union"):
            return F.array().cast(kind)
        if f.reducer.kind == "merge" or isinstance(value, dict):
            value = value or {}
            if f.schema.kind == "object":
                return F.struct(*[F.lit(value.get(k)).cast(v.spark_type()).alias(k) for k, v in f.schema.fields.items()])
            return F.create_map(*[F.lit(x) for pair in value.items() for x in pair]).cast(kind)
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value]).cast(kind)
        return F.lit(value).cast(kind)

    def start(self, inputs: DataFrame, key: str, now: int = 0) -> DataFrame:
        """Runs from a DataFrame with one column for each input; a run with a missing or invalid one has failed.

        now: the clock of graphs with backoffs, in milliseconds.
        """
        inputs = spread(inputs)
        columns: list[Column] = [F.col(key).alias("run_id")]
        bad = []
        for name, f in self.graph.inputs.items():
            given = F.col(name).try_cast(f.schema.spark_type())
            bad.append(F.col(name).isNotNull() & given.isNull())
            columns += [F.coalesce(given, self._zero(name)).alias(f"v_{name}"), given.isNotNull().cast("int").alias(f"n_{name}"), given.isNotNull().alias(f"w_{name}")]
            if f.required and f.default is None:
                bad.append(given.isNull())
            bad.append(F.size(violations(f.schema, given, name)) > 0)
        for name in self.graph.fields:
            columns += [self._zero(name).alias(f"v_{name}"), F.lit(0).alias(f"n_{name}"), F.lit(False).alias(f"w_{name}")]
        rows = inputs.select(*columns, _any(bad).alias("_invalid"))
        invalid = F.col("_invalid")
        edges: dict[str, Column] = {}
        for name in self.edges:
            e = self.graph.edges[name]
            edges[f"a_{name}"] = (self._guard(e.guard) & ~invalid) if START in e.sources else F.lit(False)
            if e.barrier:
                edges[f"s_{name}"] = F.array().cast("array<string>")
        rows = rows.withColumns(edges)
        return rows.withColumns(
            {
                "step": F.lit(0),
                **{f"t_{n}": F.lit(1) for n in self.flaky},
                **{f"k_{n}": F.lit(False) for n in self.flaky},
                **{f"f_{n}": F.lit(None).cast("long") for n in self.later},
                **{f"u_{n}": F.lit(None).cast(calls.result_type(self._kinds(n))) for n in self.called},
                **({"why": F.lit(None).cast("string")} if self.called else {}),
                **({"clock": F.lit(now).cast("long"), "wake_at": F.lit(None).cast("long")} if self.later else {}),
                "status": F.when(invalid, "failed").otherwise("running"),
                "code": F.when(invalid, "invalid_input"),
                "waiting": F.lit(None).cast("string"),
                "trace": F.array().cast("array<string>"),
                "logged": F.lit(0).cast("long"),
                "resolved": F.array().cast("array<string>"),
            }
        ).drop("_invalid")

    def _guard(self, guard) -> Column:
        if guard is None:
            return F.lit(True)
        view = {
            name: Channel(F.col(f"v_{name}"), F.col(f"n_{name}"), f.schema.spark_type(), f.default is not None)
            for name, f in self.graph.channels().items()
        }
        return to_column(guard, view, {name: F.col(f"w_{name}") for name in view})

    def _reduced(self, name: str, reducer: Reducer, writes: list[tuple[Column, Column]]) -> Column:
        """The prior value folded with (whether written, value) pairs in the order of node ids."""
        prior, unset = F.col(f"v_{name}"), F.col(f"n_{name}") == 0
        if reducer.kind == "sum":
            return reduce(lambda a, w: a + F.when(w[0], F.coalesce(w[1], F.lit(0))).otherwise(F.lit(0)), writes, prior)
        if reducer.kind in ("append", "union"):
            kind = self.graph.channels()[name].schema.spark_type()
            null = F.array(F.lit(None)).cast(kind)
            out = F.concat(prior, *[F.when(on, F.coalesce(v.cast(kind), null)).otherwise(F.array().cast(kind)) for on, v in writes])
            if reducer.by:
                item = self.graph.channels()[name].schema.item
                keys = F.transform(out, lambda x: _identity(item, x, reducer.by))
                out = F.filter(out, lambda x, i: F.array_position(keys, _identity(item, x, reducer.by)) == i + 1)
            elif reducer.unique or reducer.kind == "union":
                out = F.array_distinct(out)
            if reducer.max_length is not None:
                n = reducer.max_length
                out = F.slice(out, F.greatest(F.size(out) - n + 1, F.lit(1)), F.lit(n))
            return out
        if reducer.kind == "merge":
            schema = self.graph.channels()[name].schema
            return reduce(lambda a, w: F.when(w[0] & w[1].isNotNull(), _merged(schema, a, w[1], reducer.deep)).otherwise(a), writes, prior)
        kept = prior if reducer.kind == "first_value" else None
        order = writes if reducer.kind == "first_value" else writes[::-1]
        if self.graph.channels()[name].default is not None and kept is not None:
            return prior
        out = reduce(lambda rest, w: F.when(w[0], w[1]).otherwise(rest), order[::-1], prior)
        return out if kept is None else F.when(unset, out).otherwise(prior)

    def step(self, runs: DataFrame, jump: bool = True) -> DataFrame:
        """One superstep of every running run.  jump: the clock of a run in which nothing is due moves to wake_at first."""
        g = self.graph
        into = {n: [e for e in self.edges if g.edges[e].target == n] for n in self.nodes}
        running = F.col("status") == "running"
        active = {n: running & _any([F.col(f"a_{e}") for e in into[n]]) for n in self.nodes}
        if self.later and jump:
            runs = runs.withColumn("clock", F.when(running, F.greatest("clock", "wake_at")).otherwise(F.col("clock")))
        rows = runs.withColumns({f"x_{n}": c for n, c in active.items()})
        on = {n: F.col(f"x_{n}") for n in self.nodes}
        some = _any(list(on.values()))
        # Not due: the node's last attempt failed, and its backoff is not over.  If that is all there is to do, the run is parked.
        wait = {n: on[n] & F.coalesce(F.col(f"f_{n}") > F.col("clock"), F.lit(False)) for n in self.later}
        rows = rows.withColumns({f"q_{n}": c for n, c in wait.items()})
        wait = {n: F.col(f"q_{n}") for n in wait}
        tried = {n: on[n] & ~F.col(f"k_{n}") & ~wait.get(n, F.lit(False)) if n in self.flaky else on[n] for n in self.nodes}
        due = _any([tried[n] for n in self.flaky]) | ~_any(list(wait.values())) if self.later else F.lit(True)
        rows = rows.withColumns({"_go": running & some & (F.col("step") < self.limit) & due, "_over": running & some & (F.col("step") >= self.limit), "_some": some})
        go = F.col("_go")
        for n in self.called:
            state = {c: F.col(f"v_{c}") for c in sorted(g.channels())}
            fresh = calls.called(g.nodes[n].call, state, go & tried[n], F.col(f"t_{n}"), self._kinds(n), g.nodes[n].timeout_ms)
            rows = rows.withColumn(f"z_{n}", fresh).withColumn(f"u_{n}", F.when(go & tried[n], F.col(f"z_{n}")).otherwise(F.col(f"u_{n}"))).drop(f"z_{n}")
        asks = {n: on[n] & F.coalesce(c, F.lit(False)) for n in self.nodes if (c := self._asks(n)) is not None}
        rows = rows.withColumns({f"i_{n}": go & c for n, c in asks.items()})
        # A node whose attempt succeeded beside a failed one is held: its view stays, so that its writes wait unseen.
        bad = {n: go & tried[n] & F.coalesce(self._fails(n), F.lit(False)) for n in self.flaky}
        rows = rows.withColumns({f"b_{n}": c for n, c in bad.items()})
        bad = {n: F.col(f"b_{n}") for n in self.flaky}
        rows = rows.withColumn("_wait", go & _any(list(wait.values())))
        wrong = []
        writes = {n: self._writes(n) for n in self.nodes}
        for name, f in g.channels().items():
            for n in self.nodes:
                if name in writes[n]:
                    parked = F.col(f"i_{n}") if n in asks else F.lit(False)
                    given, value = writes[n][name]
                    ready = given & ~wait.get(n, F.lit(False))
                    wrong.append(go & on[n] & ready & ~parked & ~bad.get(n, F.lit(False)) & (F.size(violations(write_schema(f), value.cast(f.schema.spark_type()), name)) > 0))
        rows = rows.withColumn("_wrong", _any(wrong))
        last = lambda n: F.col(f"t_{n}") >= g.nodes[n].max_attempts
        spent = _any([c & (last(n) | ~F.coalesce(F.col(f"u_{n}.retryable"), F.lit(False)) if n in self.called else last(n)) for n, c in bad.items()])
        rows = rows.withColumns({"_final": F.col("_wrong") | spent, "_bad": F.col("_wrong") | _any(list(bad.values()))})
        # An invalid write is never tried again; a failed attempt is, while any are left.  Else the run has failed.
        commit = go & ~F.col("_bad") & ~F.col("_wait")
        done = {n: commit & on[n] & (~F.col(f"i_{n}") if n in asks else F.lit(True)) for n in self.nodes}
        values, written = {}, {}
        for name, f in g.channels().items():
            writers = [(done[n] & writes[n][name][0], writes[n][name][1]) for n in self.nodes if name in writes[n]]
            written[name] = _any([w for w, _ in writers])
            if writers:
                values[f"v_{name}"] = F.when(written[name], self._reduced(name, f.reducer, writers)).otherwise(F.col(f"v_{name}"))
        bump = {f"n_{name}": F.col(f"n_{name}") + w.cast("int") for name, w in written.items()}
        marks = {f"w_{name}": F.when(commit, w).otherwise(F.col(f"w_{name}")) for name, w in written.items()}
        rows = rows.withColumns({**{f"d_{n}": c for n, c in done.items()}, "_commit": commit, **values, **bump, **marks})
        edges: dict[str, Column] = {}
        for name in self.edges:
            e = g.edges[name]
            old = F.col(f"a_{name}")
            parked = F.col(f"i_{e.target}") if e.target in asks else F.lit(False)
            finished = [F.col(f"d_{s}") for s in e.sources if s != START]
            if e.barrier and START not in e.sources:
                now = F.array_compact(F.array(*[F.when(F.col(f"d_{s}"), F.lit(s)) for s in e.sources]))
                seen = F.array_union(F.col(f"s_{name}"), now)
                fire = F.size(F.array_except(F.array(*map(F.lit, e.sources)), seen)) == 0
                edges[f"s_{name}"] = F.when(F.col("_commit"), F.when(fire, F.array().cast("array<string>")).otherwise(seen)).otherwise(F.col(f"s_{name}"))
                fired = fire
            else:
                fired = _any(finished)
            edges[f"l_{name}"] = F.col("_commit") & fired & self._guard(e.guard)
            live = fired & self._guard(e.guard) if e.target != FINISH else F.lit(False)
            edges[f"a_{name}"] = F.when(F.col("_commit"), live | (old & parked)).otherwise(old)
        asked = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"i_{n}"), F.lit(n)) for n in asks])), ",") if asks else F.lit("")
        over = F.col("_over")
        rows = rows.withColumns(edges)
        rows = rows.withColumn("trace", F.concat("trace", self._log([*asks], over)))
        pending = _any([F.col(f"a_{e}") for e in self.edges if g.edges[e].target != FINISH and g.edges[e].target not in asks])
        held = _any([F.col(f"a_{e}") & ~F.col(f"i_{g.edges[e].target}") for e in self.edges if g.edges[e].target in asks])
        blocked = (asked != "") & ~(pending | held)
        rows = rows.withColumns(
            {
                "status": F.when(F.col("_final") | over, "failed")
                .when(running & ~F.col("_some"), "done")
                .when(F.col("_commit") & blocked, "waiting")
                .otherwise(F.col("status")),
                "code": F.when(F.col("_final"), "node_failed").when(over, "max_supersteps_exceeded").otherwise(F.col("code")),
                "waiting": F.when(F.col("_commit"), F.when(asked != "", asked)).otherwise(F.col("waiting")),
                **{
                    f"t_{n}": F.when(F.col("_commit"), 1).when(F.col(f"b_{n}") & ~F.col("_final"), F.col(f"t_{n}") + 1).otherwise(F.col(f"t_{n}"))
                    for n in self.flaky
                },
                **{
                    f"k_{n}": F.when(F.col("_commit"), False)
                    .when(F.col("_go"), F.col(f"k_{n}") | (F.col(f"x_{n}") & ~F.col(f"b_{n}") & ~wait.get(n, F.lit(False))))
                    .otherwise(F.col(f"k_{n}"))
                    for n in self.flaky
                },
                **{
                    f"f_{n}": F.when(F.col("_commit") | F.col("_final"), None)
                    .when(F.col(f"b_{n}"), F.col("clock") + g.nodes[n].backoff_ms)
                    .when(F.col("_go") & ~wait[n], None)
                    .otherwise(F.col(f"f_{n}"))
                    for n in self.later
                },
                **({"why": self._reason()} if self.called else {}),
                "step": F.col("step") + F.col("_commit").cast("int"),
            }
        )
        if self.later:  # the earliest of the times before which nothing is tried
            rows = rows.withColumn("wake_at", F.when(F.col("status") == "running", F.array_min(F.array(*[F.col(f"f_{n}") for n in self.later]))))
        used = [*[f"{p}_{n}" for n in self.nodes for p in "xd"], *[f"i_{n}" for n in asks], *[f"b_{n}" for n in self.flaky], *[f"l_{e}" for e in self.edges]]
        return rows.drop("_go", "_over", "_some", "_wait", "_wrong", "_bad", "_final", "_commit", *used, *[f"q_{n}" for n in self.later])

    def _reason(self) -> Column:
        """The reason of this step's first failed call, by node; the one before if there is none."""
        said = [F.when(F.col(f"b_{n}"), F.coalesce(F.col(f"u_{n}.reason"), F.lit("invalid_interrupt"))) for n in self.called]
        return F.coalesce(*said, F.col("why"))

    def _log(self, asking: list[str], over: Column) -> Column:
        """What this step adds to the trace, as step:type:subject, a checkpoint closing each transition."""
        g = self.graph
        ends = lambda e: g.edges[e].target == FINISH
        said = [(F.col(f"d_{n}"), "node_completed", n) for n in self.nodes]
        said += [(F.col("_commit") & F.col(f"w_{c}"), "channel_updated", c) for c in sorted(g.channels())]
        said += [(F.col(f"l_{e}"), "edge_triggered", e) for e in sorted(self.edges, key=lambda e: (ends(e), e))]
        said += [(F.col("_commit") & F.col(f"i_{n}"), "interrupt_requested", n) for n in asking]
        said += [(F.col(f"b_{n}") & ~F.col("_final"), "node_failed", n) for n in self.flaky]
        failed, ended = F.col("_final") | over, (F.col("status") == "running") & ~F.col("_some")
        said += [(failed, "run_failed", ""), (ended, "run_completed", ""), (F.col("_commit") | F.col("_bad") | failed | ended, "checkpoint_committed", "")]
        return F.array_compact(F.array(*[F.when(c, F.concat(F.col("step").cast("string"), F.lit(f":{kind}:{subject}"))) for c, kind, subject in said]))

    def run(self, runs: DataFrame, every: int = 3, now: int | None = None) -> DataFrame:
        """Supersteps until no run is running.

        The rows are written every so many steps and at the end: steps nest expressions, and a filter pushed
        through many of them would multiply what the optimizer has to hold.  now: the time in milliseconds; runs that
        wait for a later one stay parked.  Without it, each run's clock jumps to when it is due.
        """
        attempts = max([n.max_attempts for n in self.graph.nodes.values()], default=1)
        if not self.graph.cycles() and attempts == 1:
            left = min(self.limit, self.graph.depth()) + 1
            while left > 0:
                for _ in range(min(left, every)):
                    runs = self.step(runs)
                runs = checkpoint(runs)
                left -= every
            return runs
        ready = F.col("status") == "running"
        if now is not None and self.later:
            runs = runs.withColumn("clock", F.greatest("clock", F.lit(now)))
            ready = ready & F.coalesce(F.col("wake_at") <= F.col("clock"), F.lit(True))
        while True:
            for _ in range(every):
                runs = self.step(runs, jump=now is None)
            runs = checkpoint(runs)
            if runs.filter(ready).isEmpty():
                return runs

    def drain(self, runs: DataFrame, budget: int, now: int | None = None) -> DataFrame:
        """At most budget supersteps; what still runs then yields, see disposition()."""
        for _ in range(budget):
            runs = self.step(runs, jump=now is None)
        return checkpoint(runs)

    def disposition(self, runs: DataFrame) -> DataFrame:
        """(run_id, disposition, until): park_terminal, park_external for an answer, park_at a time, or park_immediate, as a run that yields is taken up at once."""
        until = F.col("wake_at") if self.later else F.lit(None).cast("long")
        waits = (F.col("status") == "running") & F.coalesce(until > F.col("clock"), F.lit(False)) if self.later else F.lit(False)
        how = F.when(F.col("status").isin("done", "failed", "cancelled"), "park_terminal").when(F.col("status") == "waiting", "park_external").when(waits, "park_at").otherwise("park_immediate")
        return runs.select("run_id", how.alias("disposition"), F.when(waits, until).alias("until"))

    def _answers(self, runs: DataFrame, answers: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """Runs with the answers to them by node, the least of rivals, and what becomes of each node's answer."""
        gates = [n for n in self.nodes if self.graph.nodes[n].resume]
        one = answers.filter(F.col("node").isin(*gates)).groupBy("run_id", "node").agg(F.min(F.struct("value")).alias("_a"))
        by_run = one.groupBy("run_id").agg(*[F.max(F.when(F.col("node") == n, F.col("_a"))).alias(f"_a_{n}") for n in gates])
        rows = runs.join(by_run, "run_id", "left")
        fate = {}
        for n in gates:
            schema = self.graph.fields[self.graph.nodes[n].resume].schema
            valid = F.lit(True)
            for asked in (schema, self.graph.nodes[n].answer):
                if asked is not None:
                    given = parsed(F.col(f"_a_{n}.value"), asked)
                    valid = valid & (given.isNotNull() | F.col(f"_a_{n}.value").isNull()) & (F.size(violations(asked, given, n)) == 0)
            opened = F.coalesce(F.array_contains(F.split("waiting", ","), n), F.lit(False))
            fate[n] = (
                F.when(F.col(f"_a_{n}").isNull(), F.lit(None).cast("string"))
                .when(F.col("status").isin("done", "failed", "cancelled"), "inactive_run")
                .when(~opened & F.array_contains("resolved", n), "already_resolved")
                .when(~opened, "not_found")
                .when(~valid, "invalid_value")
                .otherwise("resolved")
            )
        return rows, fate

    def resolve(self, runs: DataFrame, answers: DataFrame) -> DataFrame:
        """Answers (run_id, node, value) to interrupts, written through the reducer of the node's resume field; the node runs again.

        Several nodes of one run may be answered together.  Rival answers to one node: the least value counts.
        """
        rows, fate = self._answers(runs, answers)
        rows = rows.withColumns({f"_f_{n}": F.coalesce(c == "resolved", F.lit(False)) for n, c in fate.items()})
        # One projection for each node, so that answers to the same field fold one after the other.
        for n in fate:
            name, here = self.graph.nodes[n].resume, F.col(f"_f_{n}")
            f = self.graph.fields[name]
            new = self._reduced(name, f.reducer, [(here, parsed(F.col(f"_a_{n}.value"), f.schema))])
            said = [F.concat(F.col("step").cast("string"), F.lit(e)) for e in (f":interrupt_resolved:{n}", f":channel_updated:{name}", ":checkpoint_committed:")]
            rows = rows.withColumn("trace", F.when(here, F.concat("trace", F.array(*said))).otherwise(F.col("trace")))
            rows = rows.withColumn("resolved", F.when(here, F.array_union("resolved", F.array(F.lit(n)))).otherwise(F.col("resolved")))
            rows = rows.withColumns({f"v_{name}": F.when(here, new).otherwise(F.col(f"v_{name}")), f"n_{name}": F.col(f"n_{name}") + here.cast("int"), f"w_{name}": here | F.col(f"w_{name}")})
        some = _any([F.col(f"_f_{n}") for n in fate])
        return rows.withColumn("status", F.when(some, "running").otherwise(F.col("status"))).drop(*[f"_{p}_{n}" for n in fate for p in "af"])

    def resolutions(self, runs: DataFrame, answers: DataFrame) -> DataFrame:
        """(run_id, node, outcome) of the answers to known runs: resolved, inactive_run, already_resolved, not_found or invalid_value."""
        rows, fate = self._answers(runs, answers)
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), c.alias("outcome")) for n, c in fate.items()]))
        return rows.select("run_id", each.alias("e")).select("run_id", "e.*").filter("outcome is not null")

    def cancel(self, runs: DataFrame, which: Column) -> DataFrame:
        live = F.col("status").isin("running", "waiting") & which
        said = F.array(*[F.concat(F.col("step").cast("string"), F.lit(e)) for e in (":run_cancelled:", ":checkpoint_committed:")])
        return runs.withColumns({"trace": F.when(live, F.concat("trace", said)).otherwise(F.col("trace")), "status": F.when(live, "cancelled").otherwise(F.col("status"))})

    def outputs(self, runs: DataFrame) -> DataFrame:
        """Every declared output; a field never written is null, its default does not show."""
        given = [F.when(F.col(f"n_{source}") > 0, F.col(f"v_{source}")).alias(name) for name, source in sorted(self.graph.outputs.items())]
        return runs.select("run_id", "status", "step", *given)

    def log(self, runs: DataFrame) -> DataFrame:
        """(run_id, seq, step, type, subject) of the events that a run carries, in order; the subject is a node, field or edge."""
        rows = runs.select("run_id", "logged", F.posexplode("trace").alias("pos", "e")).withColumn("e", F.split("e", ":", 3))
        return rows.select(
            "run_id",
            (F.col("logged") + F.col("pos") + 1).cast("long").alias("seq"),
            F.col("e")[0].cast("int").alias("step"),
            F.col("e")[1].alias("type"),
            F.nullif(F.col("e")[2], F.lit("")).alias("subject"),
        )

    def flushed(self, runs: DataFrame) -> DataFrame:
        """Runs without the events that log() gave, so that a long run carries only what is not written yet."""
        return runs.withColumns({"logged": F.col("logged") + F.size("trace"), "trace": F.array().cast("array<string>")})

    def events(self, runs: DataFrame) -> DataFrame:
        """(run_id, seq, step, node_id) of completed nodes, numbered among themselves."""
        kept = F.filter("trace", lambda e: F.split(e, ":", 3)[1] == "node_completed")
        return self.log(runs.withColumn("trace", kept)).select("run_id", "seq", "step", F.col("subject").alias("node_id"))
