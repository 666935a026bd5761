"""Graph documents as plain maps that JSON can carry, read back strictly.

Functions have no wire form, so a node names the implementation that built it and its config; reading takes a
registry from such names to builders.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import MISSING, dataclass, fields, replace
from typing import Any

from ..functions.guards import Guard, Path
from ..functions.schemas import Schema, reasons
from .graph import Edge, Field, Graph, Node, Reducer

VERSION = 1


@dataclass(frozen=True)
class Implementation:
    """Builds nodes from a config; the declared config fields are checked and their defaults filled in when a node is built."""

    build: Callable[[dict[str, Any]], Node]
    config: dict[str, Field] | None = None

    def __call__(self, config: dict[str, Any]) -> Node:
        return self.build(config)


#: Policies of a node that its wire form holds where they differ from the usual.
TIMES = ("backoff_ms", "timeout_ms")
Registry = Mapping[str, Callable[[dict[str, Any]], Node]]


class DocumentError(ValueError):
    def __init__(self, code: str, where: str) -> None:
        super().__init__(f"{code} at {where}")
        self.code, self.where = code, where


def built(registry: Registry, name: str, config: dict[str, Any] | None = None, **changes: Any) -> Node:
    """A node of a registered implementation."""
    if name is None:
        raise DocumentError("missing_node_implementation", "nodes")
    if name not in registry:
        raise DocumentError("unsupported_node_implementation", str(name))
    if not callable(registry[name]):
        raise DocumentError("invalid_node_implementation", name)
    config, declared = dict(config or {}), getattr(registry[name], "config", None)
    if declared is not None:
        if any(not isinstance(f, Field) or f.schema is None or not f.schema.sound() for f in declared.values()):
            raise DocumentError("invalid_node_config_schema", name)
        config = {k: f.default for k, f in declared.items() if f.default is not None} | config
        wrong = sorted(set(config) - set(declared)) + [k for k, f in declared.items() if f.required and config.get(k) is None]
        wrong += [r for k, f in declared.items() if k in config for r in reasons(f.schema, config[k], k)]
        if wrong:
            raise DocumentError("invalid_node_config", f"{name}: {wrong[0]}")
    return replace(registry[name](config), implementation=name, config=config, **changes)


def _dumped(x: Any) -> Any:
    """Dataclasses without what has its default value; paths and guards tagged, as literals can be maps too."""
    if isinstance(x, Path):
        return {"$path": [x.channel, *x.segments]}
    if isinstance(x, Guard):
        return {"$guard": x.op, "args": [_dumped(a) for a in x.args]}
    if isinstance(x, (Schema, Reducer, Field)):
        out = {}
        for f in fields(x):
            value = getattr(x, f.name)
            default = f.default if f.default is not MISSING else f.default_factory() if f.default_factory is not MISSING else MISSING
            if default is MISSING or value != default or type(value) is not type(default):
                out[f.name] = _dumped(value)
        return out
    if isinstance(x, dict):
        if any(not isinstance(k, str) or k.startswith("$") for k in x):
            raise DocumentError("invalid_document", f"keys of {sorted(map(str, x))}")
        return {k: _dumped(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_dumped(v) for v in x]
    if x is None or isinstance(x, (str, bool, int, float)):
        return x
    raise DocumentError("invalid_document", repr(x))


def to_map(graph: Graph) -> dict[str, Any]:
    def node(name: str, n: Node) -> dict[str, Any]:
        if n.implementation is None:
            raise DocumentError("unregistered_implementation", f"nodes.{name}")
        extra = ({"branches": _dumped(n.branches)} if n.branches else {}) | ({"answer": _dumped(n.answer)} if n.answer else {})
        extra |= {k: getattr(n, k) for k in TIMES if getattr(n, k) != getattr(Node(), k)}
        return {"implementation": n.implementation, "config": _dumped(n.config), "max_attempts": n.max_attempts} | extra

    return {
        "schema_version": VERSION,
        "id": graph.id,
        "inputs": _dumped(graph.inputs),
        "fields": _dumped(graph.fields),
        "outputs": {k: {"source": v} | ({"schema": _dumped(graph.output_schemas[k])} if k in graph.output_schemas else {}) for k, v in graph.outputs.items()},
        "nodes": {k: node(k, v) for k, v in graph.nodes.items()},
        "edges": {k: {"from": _dumped(v.source), "to": v.target} | ({"guard": _dumped(v.guard)} if v.guard else {}) for k, v in graph.edges.items()},
        "policies": {} if graph.max_supersteps is None else {"max_supersteps": graph.max_supersteps},
        "metadata": _dumped(graph.metadata),
    }


def _known(x: Any, where: str, *names: str) -> dict[str, Any]:
    if not isinstance(x, dict):
        raise DocumentError("invalid_document", where)
    for k in x:
        if k not in names:
            raise DocumentError("unknown_key", f"{where}.{k}")
    return x


def _items(x: Any, where: str) -> dict[str, Any]:
    if not isinstance(x, dict) or any(not isinstance(k, str) for k in x):
        raise DocumentError("invalid_document", where)
    return x


def _tuples(x: Any) -> Any:
    return tuple(_tuples(v) for v in x) if isinstance(x, list) else x


def _record(kind: type, x: Any, where: str) -> Any:
    x = _known(x, where, *[f.name for f in fields(kind)])
    try:
        return kind(**x)
    except (TypeError, ValueError) as error:
        raise DocumentError("invalid_document", where) from error


def _schema(x: Any, where: str) -> Schema:
    x = dict(_items(x, where))
    if x.get("item") is not None:
        x["item"] = _schema(x["item"], f"{where}.item")
    if "fields" in x:
        x["fields"] = {k: _schema(v, f"{where}.{k}") for k, v in _items(x["fields"], where).items()}
    if "values" in x:
        x["values"] = _tuples(x["values"])
    return _record(Schema, x, where)


def _field(x: Any, where: str) -> Field:
    x = dict(_items(x, where))
    x["schema"] = None if x.get("schema") is None else _schema(x["schema"], f"{where}.schema")
    if "reducer" in x:
        x["reducer"] = _record(Reducer, {k: _tuples(v) for k, v in _items(x["reducer"], where).items()}, f"{where}.reducer")
    return _record(Field, x, where)


def _guard(x: Any, where: str) -> Any:
    if isinstance(x, dict) and "$path" in x:
        parts = _known(x, where, "$path")["$path"]
        if not isinstance(parts, list) or not parts:
            raise DocumentError("invalid_guard_path", where)
        return Path(parts[0], tuple(parts[1:]))
    if isinstance(x, dict) and "$guard" in x:
        args = _known(x, where, "$guard", "args").get("args")
        if not isinstance(args, list):
            raise DocumentError("invalid_guard", where)
        return Guard(x["$guard"], tuple(_guard(a, where) for a in args))
    return x


def _edge(x: Any, where: str) -> Edge:
    x = _known(x, where, "from", "to", "guard")
    source, target = x.get("from"), x.get("to")
    if not isinstance(target, str) or not isinstance(source, (str, list)):
        raise DocumentError("invalid_document", where)
    return Edge(_tuples(source), target, _guard(x["guard"], f"{where}.guard") if "guard" in x else None)


def _node(x: Any, where: str, registry: Registry) -> Node:
    x = _known(x, where, "implementation", "config", "max_attempts", "branches", "answer", *TIMES)
    changes = {"max_attempts": x.get("max_attempts", 1), "branches": {k: _tuples(v) for k, v in _items(x.get("branches", {}), where).items()}}
    changes |= {k: x[k] for k in TIMES if k in x}
    if "answer" in x:
        changes["answer"] = _schema(x["answer"], f"{where}.answer")
    return built(registry, x.get("implementation"), x.get("config"), **changes)


def from_map(document: Any, registry: Registry) -> Graph:
    """Refuses unknown keys, versions and implementations, and what is not of the expected shape."""
    top = _known(document, "graph", "schema_version", "id", "inputs", "fields", "outputs", "nodes", "edges", "policies", "metadata")
    if top.get("schema_version") != VERSION:
        raise DocumentError("unsupported_schema_version", "schema_version")
    if not isinstance(top.get("id"), str):
        raise DocumentError("invalid_document", "id")
    each = lambda name, load: {k: load(v, f"{name}.{k}") for k, v in _items(top.get(name, {}), name).items()}
    return Graph(
        top["id"],
        inputs=each("inputs", _field),
        fields=each("fields", _field),
        nodes=each("nodes", lambda v, at: _node(v, at, registry)),
        edges=each("edges", _edge),
        outputs=each("outputs", lambda v, at: _known(v, at, "source", "schema").get("source")),
        output_schemas={k: _schema(v["schema"], f"outputs.{k}.schema") for k, v in _items(top.get("outputs", {}), "outputs").items() if "schema" in v},
        max_supersteps=_known(top.get("policies", {}), "policies", "max_supersteps").get("max_supersteps"),
        metadata=_items(top.get("metadata", {}), "metadata"),
    )


def to_json(graph: Graph) -> str:
    return json.dumps(to_map(graph), sort_keys=True, separators=(",", ":"), allow_nan=False)


def from_json(text: str, registry: Registry) -> Graph:
    return from_map(json.loads(text), registry)
