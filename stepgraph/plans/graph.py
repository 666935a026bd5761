"""Graph documents: building, diagnostics, topology, canonical form and identity."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column

from ..functions.guards import Guard, Path
from ..functions.schemas import Schema, reasons

START, FINISH = "$start", "$finish"
PUBLIC_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*\Z")
#: Which schema types a reducer can fold into.
FOLDS = {"append": {"list"}, "union": {"list"}, "sum": {"integer", "float"}, "merge": {"map", "object"}}


@dataclass(frozen=True)
class Reducer:
    kind: str = "last_value"
    unique: bool = False
    max_length: int | None = None
    by: tuple[str, ...] = ()
    deep: bool = False

    @staticmethod
    def of(what: Any) -> Reducer:
        """A reducer from its short form: "sum" or ("append", {"unique": True}); by may be one name or a path."""
        if isinstance(what, Reducer):
            return what
        kind, options = (what, {}) if isinstance(what, str) else what if isinstance(what, tuple) and len(what) == 2 else (None, None)
        if not isinstance(kind, str) or not isinstance(options, dict) or kind not in (*FOLDS, "last_value", "first_value"):
            raise ValueError(f"not a reducer: {what!r}")
        by = options.get("by", ())
        return Reducer(kind, **options | {"by": (by,) if isinstance(by, str) else tuple(by)})


@dataclass(frozen=True)
class Field:
    schema: Schema | None
    reducer: Reducer = Reducer()
    default: Any = None
    required: bool = False


@dataclass(frozen=True)
class Node:
    """update: field -> column from the view; fails and interrupts: conditions under which an attempt does so.

    implementation and config name what built the node; only such nodes have a wire form.  branches: groups of
    outgoing edges of which one is meant to be taken.  answer: what an answer to its interrupt must satisfy.
    backoff_ms: how long a failed attempt waits for the next.  call: user code in place of columns, see plans/calls.py;
    it writes the fields writes and is given up after timeout_ms.
    """

    update: dict[str, Callable[[Any], Column]] = field(default_factory=dict)
    fails: Callable[[Any], Column] | None = None
    interrupts: Callable[[Any], Column] | None = None
    resume: str | None = None
    max_attempts: int = 1
    implementation: str | None = None
    config: dict[str, Any] = field(default_factory=dict)
    branches: dict[str, tuple[str, ...]] = field(default_factory=dict)
    answer: Schema | None = None
    backoff_ms: int = 0
    call: Callable[..., Any] | None = None
    writes: tuple[str, ...] = ()
    timeout_ms: int = 2_000

    @property
    def written(self) -> tuple[str, ...]:
        return (*self.update, *self.writes)


@dataclass(frozen=True)
class Edge:
    source: str | tuple[str, ...]
    target: str
    guard: Guard | None = None

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,) if isinstance(self.source, str) else tuple(self.source)

    @property
    def barrier(self) -> bool:
        """Every list of sources is one, of a single source too."""
        return not isinstance(self.source, str)


@dataclass(frozen=True)
class Diagnostic:
    code: str
    where: str
    severity: str = "error"


@dataclass(frozen=True)
class Graph:
    id: str
    inputs: dict[str, Field] = field(default_factory=dict)
    fields: dict[str, Field] = field(default_factory=dict)
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: dict[str, Edge] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    max_supersteps: int | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    output_schemas: dict[str, Schema] = field(default_factory=dict)

    def put_input(self, name: str, what: Field) -> Graph:
        rest = {k: v for k, v in self.fields.items() if k != name}
        return replace(self, inputs=self.inputs | {name: what}, fields=rest)

    def put_field(self, name: str, what: Field) -> Graph:
        return replace(self, fields=self.fields | {name: what})

    def put_node(self, name: str, what: Node) -> Graph:
        return replace(self, nodes=self.nodes | {name: what})

    def update_node(self, name: str, **changes: Any) -> Graph:
        return self.put_node(name, replace(self.nodes[name], **changes))

    def delete_node(self, name: str) -> Graph:
        """Edges stay; verify() then tells which lost an end."""
        return replace(self, nodes={k: v for k, v in self.nodes.items() if k != name})

    def put_edge(self, name: str, source: str | tuple[str, ...], target: str, guard: Guard | None = None) -> Graph:
        return replace(self, edges=self.edges | {name: Edge(source, target, guard)})

    def update_edge(self, name: str, **changes: Any) -> Graph:
        return replace(self, edges=self.edges | {name: replace(self.edges[name], **changes)})

    def update_field(self, name: str, **changes: Any) -> Graph:
        return self.put_field(name, replace(self.fields[name], **changes))

    def delete_field(self, name: str) -> Graph:
        """Outputs, guards and nodes that use it stay; verify() then tells which."""
        return replace(self, fields={k: v for k, v in self.fields.items() if k != name})

    def policy(self, max_supersteps: int | None) -> Graph:
        return replace(self, max_supersteps=max_supersteps)

    def put_metadata(self, name: str, what: Any) -> Graph:
        return replace(self, metadata=self.metadata | {name: what})

    def delete_edge(self, name: str) -> Graph:
        return replace(self, edges={k: v for k, v in self.edges.items() if k != name})

    def put_output(self, name: str, source: str | None = None, schema: Schema | None = None) -> Graph:
        schemas = {k: v for k, v in self.output_schemas.items() if k != name} | ({name: schema} if schema else {})
        return replace(self, outputs=self.outputs | {name: source or name}, output_schemas=schemas)

    def channels(self) -> dict[str, Field]:
        return self.inputs | self.fields

    def canonical(self) -> str:
        """A document that does not depend on the order in which things were put."""

        def plain(x: Any) -> Any:
            if isinstance(x, (Guard, Path)):
                return {"op": getattr(x, "op", "path"), "args": [plain(a) for a in (x.args if isinstance(x, Guard) else (x.channel, x.segments))]}
            if isinstance(x, (Field, Schema, Reducer)):
                return {k: plain(v) for k, v in vars(x).items() if v not in (None, (), {}, False)}
            if isinstance(x, Node):
                extra = {"branches": plain(x.branches)} if x.branches else {}
                extra |= {"answer": plain(x.answer)} if x.answer else {}
                extra |= {k: getattr(x, k) for k in ("backoff_ms", "timeout_ms") if getattr(x, k) != getattr(Node(), k)}
                extra |= {"writes": sorted(x.writes)} if x.writes else {}
                built = extra | {"implementation": x.implementation, "config": plain(x.config)} if x.implementation else extra
                return {"update": sorted(x.update), "resume": x.resume, "max_attempts": x.max_attempts} | built
            if isinstance(x, Edge):
                return {"from": plain(x.source), "to": x.target, "guard": plain(x.guard)}
            if isinstance(x, dict):
                return {str(k): plain(v) for k, v in x.items()}
            if isinstance(x, (tuple, list)):
                return [plain(v) for v in x]
            return {"float": repr(x)} if isinstance(x, float) else x

        return json.dumps({k: plain(v) for k, v in vars(self).items()}, sort_keys=True, separators=(",", ":"))

    def hash(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    def runtime_id(self) -> str:
        return f"{self.id}@{self.hash()[:12]}"

    def reached(self, backward: bool = False) -> set[str]:
        """Nodes reached from the start, fan-ins only once all their sources are; backward: nodes that reach the finish."""
        seen, grown = {FINISH if backward else START}, True
        while grown:
            grown = False
            for e in self.edges.values():
                if backward:
                    new = set(e.sources) - seen if e.target in seen else set()
                else:
                    new = {e.target} - seen if e.sources and set(e.sources) <= seen else set()
                if new:
                    seen |= new
                    grown = True
        return seen & set(self.nodes)

    def depth(self) -> int:
        """Nodes on the longest path of a graph without cycles."""
        before = {n: {s for e in self.edges.values() if e.target == n for s in e.sources if s in self.nodes} for n in self.nodes}
        long: dict[str, int] = {}
        while len(long) < len(before):
            long |= {n: 1 + max((long[s] for s in b), default=0) for n, b in before.items() if n not in long and b <= set(long)}
        return max(long.values(), default=0)

    def cycles(self) -> list[set[str]]:
        """Strongly connected components with a cycle, by two depth-first passes."""
        after: dict[str, set[str]] = {n: set() for n in self.nodes}
        before: dict[str, set[str]] = {n: set() for n in self.nodes}
        for e in self.edges.values():
            for s in e.sources:
                if s in after and e.target in after:
                    after[s].add(e.target)
                    before[e.target].add(s)

        def walk(first: str, along: dict[str, set[str]], seen: set[str]) -> list[str]:
            done, stack = [], [(first, iter(sorted(along[first])))]
            seen.add(first)
            while stack:
                node, rest = stack[-1]
                following = next((n for n in rest if n not in seen), None)
                if following is None:
                    done.append(node)
                    stack.pop()
                else:
                    seen.add(following)
                    stack.append((following, iter(sorted(along[following]))))
            return done

        seen: set[str] = set()
        finished = [n for first in sorted(after) if first not in seen for n in walk(first, after, seen)]
        seen = set()
        out = []
        for first in reversed(finished):
            if first not in seen:
                part = set(walk(first, before, seen))
                if len(part) > 1 or first in after[first]:
                    out.append(part)
        return out

    def verify(self) -> list[Diagnostic]:
        """All diagnostics, in order of place; a graph is valid if none is an error."""
        out: list[Diagnostic] = []
        add = lambda code, where, severity="error": out.append(Diagnostic(code, where, severity))
        channels = self.channels()
        for kind, names in (("inputs", self.inputs), ("fields", self.fields), ("nodes", self.nodes), ("edges", self.edges), ("outputs", self.outputs)):
            for name in names:
                if name in (START, FINISH):
                    add("reserved_id", f"{kind}.{name}")
                elif not PUBLIC_ID.match(name):
                    add("invalid_public_id", f"{kind}.{name}")
        for name in set(self.inputs) & set(self.fields):
            add("duplicate_state_id", f"fields.{name}")
        for name, f in channels.items():
            self._verify_field(name, f, add)
        for name, source in self.outputs.items():
            if not isinstance(source, str):
                add("invalid_record", f"outputs.{name}")
            elif source not in channels:
                add("unknown_output_source", f"outputs.{name}")
            elif name in self.output_schemas and channels[source].schema and not self.output_schemas[name].covers(channels[source].schema):
                add("incompatible_output_schema", f"outputs.{name}")
        for name, node in self.nodes.items():
            for target in node.written:
                if target not in self.fields:
                    add("invalid_node_config", f"nodes.{name}")
            if node.call is not None and (node.update or node.fails or node.interrupts) or node.call is None and node.writes:
                add("invalid_node_config", f"nodes.{name}")
            if node.interrupts is not None and node.resume not in self.fields:
                add("invalid_node_config", f"nodes.{name}")
            for policy, least in ((node.max_attempts, 1), (node.backoff_ms, 0), (node.timeout_ms, 1)):
                if isinstance(policy, bool) or not isinstance(policy, int) or policy < least:
                    add("invalid_policy", f"nodes.{name}")
            self._verify_branches(name, node, add)
        # Fields, nodes and edges become columns, whose names Spark compares without case.
        for kind, names in (("fields", channels), ("nodes", self.nodes), ("edges", self.edges)):
            for name in names:
                if any(other < name and other.lower() == name.lower() for other in names):
                    add("runtime_id_collision", f"{kind}.{name}")
        if self.max_supersteps is not None and (isinstance(self.max_supersteps, bool) or not isinstance(self.max_supersteps, int) or self.max_supersteps < 1):
            add("invalid_policy", "policies.max_supersteps")
        for name, edge in self.edges.items():
            self._verify_edge(name, edge, channels, add)
        self._verify_topology(add)
        self._verify_usage(add)
        return sorted(out, key=lambda d: (d.where, d.code))

    def _verify_branches(self, name: str, node: Node, add: Callable) -> None:
        taken: set[str] = set()
        for group, members in node.branches.items():
            for e in members:
                where = f"nodes.{name}.branches.{group}"
                if e in taken:
                    add("duplicate_branch_edge", where)
                taken.add(e)
                if e not in self.edges:
                    add("unknown_branch_edge", where)
                elif name not in self.edges[e].sources:
                    add("branch_edge_source_mismatch", where)
                elif self.edges[e].guard is None:
                    add("unguarded_branch_edge", where, "warning")

    def _verify_field(self, name: str, f: Field, add: Callable) -> None:
        where = f"fields.{name}"
        if not isinstance(f, Field):
            add("invalid_field", where)
            return
        if f.schema is None:
            add("missing_field_schema", where)
            return
        if not f.schema.sound():
            add("invalid_schema", where)
        try:
            json.dumps(f.default, allow_nan=False)
        except (TypeError, ValueError):
            add("non_durable_graph_value", where)
        allowed = FOLDS.get(f.reducer.kind)
        if f.reducer.kind not in (*FOLDS, "last_value", "first_value") or f.reducer.max_length is not None and f.reducer.max_length < 1:
            add("invalid_reducer", where)
        elif allowed and f.schema.kind not in allowed:
            add("reducer_schema_mismatch", where)
        if f.reducer.kind == "append" and f.schema.kind == "list" and f.schema.item is not None and f.schema.item.kind == "list":
            add("ambiguous_list_write", where, "warning")
        if f.default is not None and f.schema.sound() and reasons(f.schema, f.default, name):
            add("invalid_field_default", where)

    def _verify_edge(self, name: str, edge: Edge, channels: dict[str, Field], add: Callable) -> None:
        where = f"edges.{name}"
        if not edge.sources:
            add("empty_edge_sources", where)
        if len(set(edge.sources)) < len(edge.sources):
            add("duplicate_edge_source", where)
        for s in edge.sources:
            if s == FINISH:
                add("invalid_finish_endpoint", where)
            elif s == START and edge.barrier and len(edge.sources) > 1:
                add("invalid_start_endpoint", where)
            elif s != START and s not in self.nodes:
                add("unknown_edge_source", where)
        if edge.target == START:
            add("invalid_start_endpoint", where)
        elif edge.target != FINISH and edge.target not in self.nodes:
            add("unknown_edge_target", where)

        def refs(g: Any) -> None:
            if isinstance(g, Path):
                if g.channel not in channels:
                    add("unknown_guard_field", where)
                if not all(isinstance(s, (str, int)) for s in g.segments):
                    add("invalid_guard_path", where)
                return
            arity = {"changed": 1, "exists": 1, "not": 1, "equals": 2, "version_at_least": 2}
            if not isinstance(g, Guard) or g.op not in (*arity, "all", "any") or len(g.args) != arity.get(g.op, len(g.args)):
                add("invalid_guard", where)
            elif g.op in ("all", "any", "not"):
                for a in g.args:
                    refs(a)
            else:
                if isinstance(g.args[0], str):
                    if g.args[0] not in channels:
                        add("unknown_guard_field", where)
                else:
                    refs(g.args[0])
                if g.op == "equals" and isinstance(g.args[1], Path):
                    refs(g.args[1])

        if edge.guard is not None:
            refs(edge.guard)

    def _verify_topology(self, add: Callable) -> None:
        if not any(START in e.sources for e in self.edges.values()):
            add("no_entrypoint", "edges")
        else:
            for name in set(self.nodes) - self.reached():
                add("unreachable_node", f"nodes.{name}")
        if not any(e.target == FINISH for e in self.edges.values()):
            add("no_terminal_edge", "edges", "warning")
        else:
            for name in set(self.nodes) - self.reached(backward=True):
                add("dead_end_node", f"nodes.{name}", "warning")
        for part in self.cycles():
            where = f"nodes.{min(part)}"
            if self.max_supersteps is None:
                add("unbounded_cycle", where, "warning")
            inside = [e for e in self.edges.values() if set(e.sources) & part]
            if all(e.guard is None for e in inside):
                add("unguarded_cycle", where, "warning")

    def _verify_usage(self, add: Callable) -> None:
        used = set(self.outputs.values()) | {f for n in self.nodes.values() for f in (*n.written, n.resume)}
        text = json.dumps(json.loads(self.canonical())["edges"])
        for name in self.fields:
            if name not in used and json.dumps(name) not in text:
                add("orphaned_field", f"fields.{name}", "warning")
