"""The facade over a store in a temporary folder, and the wire form of graphs."""

import json

import pytest
from pyspark.sql import functions as F

from stepgraph.api import Runtime, RuntimeFault
from stepgraph.functions import guards as G
from stepgraph.functions.schemas import Schema
from stepgraph.plans import wire
from stepgraph.plans.graph import FINISH, START, Field, Graph, Node, Reducer

TEXT = Schema("string", max_length=9)
REGISTRY = {
    "copy": lambda c: Node({c["to"]: lambda v: v[c["from"]]}),
    "gate": lambda c: Node({c["to"]: lambda v: F.concat(F.lit("did "), v[c["on"]])}, interrupts=lambda v: v.version(c["on"]) == 0, resume=c["on"]),
}


def graph(limit=7):
    g = Graph("review", max_supersteps=limit).put_input("topic", Field(TEXT, required=True)).put_field("draft", Field(TEXT)).put_field("say", Field(TEXT))
    g = g.put_field("out", Field(Schema("string"))).put_field("all", Field(Schema("list", item=Schema("string")), Reducer("union"), default=["x"])).put_output("out").put_output("draft").put_output("all")
    g = g.put_node("a", wire.built(REGISTRY, "copy", {"from": "topic", "to": "draft"})).put_node("b", wire.built(REGISTRY, "gate", {"on": "say", "to": "out"}, max_attempts=2))
    g = g.put_edge("e0", START, "a").put_edge("e1", ("a",), "b", G.all_of(G.exists(G.path("draft", ())), G.not_(G.equals("topic", "skip"))))
    return g.put_edge("e2", "b", FINISH).put_metadata("owner", {"team": [1, 2.5, None, True]})


def test_wire_round_trip_keeps_identity():
    g = graph()
    again = wire.from_json(wire.to_json(g), REGISTRY)
    assert again.hash() == g.hash() and wire.to_json(again) == wire.to_json(g)
    assert again.edges == g.edges and again.fields["draft"] == g.fields["draft"]


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda d: d.update(more=1), "unknown_key"),
        (lambda d: d["edges"]["e0"].update(colour="red"), "unknown_key"),
        (lambda d: d["fields"]["draft"]["schema"].update(kind="no"), "invalid_document"),
        (lambda d: d.update(schema_version=2), "unsupported_schema_version"),
        (lambda d: d.pop("id"), "invalid_document"),
        (lambda d: d["nodes"]["a"].update(implementation="gone"), "unsupported_node_implementation"),
        (lambda d: d.update(nodes=[]), "invalid_document"),
        (lambda d: d["edges"]["e1"].update(guard={"$guard": "exists"}), "invalid_guard"),
    ],
)
def test_wire_is_read_strictly(change, code):
    document = json.loads(wire.to_json(graph()))
    change(document)
    with pytest.raises(wire.DocumentError) as error:
        wire.from_map(document, REGISTRY)
    assert error.value.code == code


def test_nodes_of_functions_have_no_wire_form():
    with pytest.raises(wire.DocumentError):
        wire.to_map(Graph("g").put_node("n", Node()))


def test_config_is_checked_and_filled_in():
    declared = {"to": Field(Schema("string"), required=True), "n": Field(Schema("integer", max=9), default=3)}
    registry = {"put": wire.Implementation(lambda c: Node({c["to"]: lambda v: F.lit(c["n"])}), declared), "bad": wire.Implementation(lambda c: Node(), {"x": Field(None)}), "no": 1}
    assert wire.built(registry, "put", {"to": "a"}).config == {"to": "a", "n": 3}
    for name, config, code in (("put", {}, "invalid_node_config"), ("put", {"to": "a", "n": 10}, "invalid_node_config"), ("put", {"to": "a", "x": 1}, "invalid_node_config"), ("bad", {}, "invalid_node_config_schema"), ("no", {}, "invalid_node_implementation"), (None, {}, "missing_node_implementation")):
        with pytest.raises(wire.DocumentError) as error:
            wire.built(registry, name, config)
        assert error.value.code == code


def test_more_diagnostics():
    codes = lambda g: {d.code for d in g.verify()}
    g = graph()
    assert not codes(g)
    assert {"unknown_branch_edge", "branch_edge_source_mismatch", "duplicate_branch_edge", "unguarded_branch_edge"} <= codes(g.update_node("b", branches={"x": ("e0", "nope"), "y": ("e0", "e2")}))
    assert "incompatible_output_schema" in codes(g.put_output("out", schema=Schema("integer"))) and not codes(g.put_output("out", schema=Schema("string")))
    assert "runtime_id_collision" in codes(g.put_field("OUT", Field(TEXT)))
    assert "invalid_schema" in codes(g.update_field("draft", schema=Schema("string", pattern="(")))
    assert "invalid_schema" in codes(g.update_field("draft", schema=Schema("integer", min=2, max=1)))
    assert "non_durable_graph_value" in codes(g.update_field("draft", default=float("nan")))
    assert "invalid_field_default" in codes(g.update_field("draft", default="longer than nine"))
    assert "invalid_field" in codes(g.put_field("f", None)) and "invalid_record" in codes(g.put_output("o", 5))
    assert "invalid_policy" in codes(g.update_node("a", max_attempts=0))


def test_edits():
    g = graph()
    assert g.update_edge("e2", target="a").edges["e2"].target == "a"
    assert "unknown_output_source" in {d.code for d in g.delete_field("out").verify()}
    assert g.update_field("draft", required=True).fields["draft"].required
    assert "invalid_policy" in {d.code for d in g.policy(0).verify()}


def fails(code, f, *args, **kw):
    with pytest.raises(RuntimeFault) as error:
        f(*args, **kw)
    assert error.value.code == code


def test_runs_of_one_tenant(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    fails("invalid_tenant", Runtime, spark, base, REGISTRY, "required")
    fails("invalid_tenant", Runtime, spark, base, REGISTRY, "none", "t")
    r = Runtime(spark, base, REGISTRY, "required", "t")
    ref = r.save_graph(graph())
    assert r.save_graph(graph()) == ref and r.list_graph_versions("review").count() == 1
    newer = r.save_graph(graph(8))
    assert r.fetch_latest_graph_ref("review") == newer and r.fetch_graph(ref).hash() == ref.graph_hash
    assert r.list_runs(ref).count() == 0
    one = r.start_run(ref, {"topic": "cats"})
    fails("already_exists", r.start_run, ref, {"topic": "cats"}, one)
    fails("invalid_input", r.start_run, ref, {})
    fails("invalid_input", r.start_run, ref, {"topic": "a", "more": 1})
    r.start_runs(ref, spark.createDataFrame([("two", "dogs"), ("three", "skip"), ("four", "far too long")], "run_id string, topic string"))
    got = {x.run_id: (x.status, x.waiting) for x in r.list_runs(ref).collect()}
    assert got == {one: ("waiting", "b"), "two": ("waiting", "b"), "three": ("done", None), "four": ("failed", None)}
    fails("invalid_value", r.resolve_interrupt, ref, one, "b", "far too long")
    fails("not_found", r.resolve_interrupt, ref, one, "a", "x")
    fails("not_found", r.resolve_interrupt, ref, "nobody", "b", "x")
    done = r.resolve_interrupt(ref, one, "b", "yes")
    assert (done.status, done.out, done.draft, done.all) == ("done", "did yes", "cats", None)
    fails("inactive_run", r.resolve_interrupt, ref, one, "b", "x")
    fails("inactive_run", r.cancel_run, ref, one)
    assert r.cancel_run(ref, "two").status == "cancelled" and r.cancel_run(ref, "two").status == "cancelled"
    assert not r.drain_runs(ref) and r.await_run(ref, one).status == "done"
    assert r.list_runs(ref, statuses=("cancelled", "failed")).count() == 2 and r.fetch_latest_run(ref, ("cancelled",)).run_id == "two"
    events = r.list_events(ref, one).collect()
    assert r.fetch_event(ref, one, 2).type == events[1].type and r.fetch_latest_event(ref, one) == events[-1]
    fails("not_found", r.fetch_event, ref, one, 99)
    assert r.inspect_run(ref, one).v_say == "yes"
    other = Runtime(spark, base, REGISTRY, "required", "u")
    fails("not_found", other.fetch_run, ref, one)
