"""Stores, leases, policies, observers and nodes of user code."""

import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepgraph.functions import guards as G
from stepgraph.functions.schemas import Schema, compiles
from stepgraph.operators import commits
from stepgraph.operators import metrics as M
from stepgraph.plans import calls, flows, wire
from stepgraph.plans.engine import Engine
from stepgraph.plans.graph import FINISH, START, Field, Graph, Node, Reducer
from stepgraph.plugins import Dispatcher, Leases, Legacy, MemoryStore, Unavailable, Windowed, telemetry
from stepgraph.sources.snapshots import SnapshotStore
from stepgraph.sources.tables import DAY, NOW, run_events, runs
from stepgraph.streaming.shell import RunShell

DATA = "/root/testdata/sf0.001"
INT, TEXT = Schema("integer"), Schema("string")


@pytest.fixture(params=["memory", "files"])
def held(request, spark, tmp_path):
    out = MemoryStore(spark) if request.param == "memory" else SnapshotStore(spark, str(tmp_path / "store"))
    out.commit({"runs": runs(spark, DATA), "events": run_events(spark, DATA)}, 0)
    return out


def policy(**options):
    out = Legacy()
    out.configure({"ttl": DAY} | options)
    return out


def test_leases_act_on_the_store(held):
    told = []
    leases = Leases(held, policy(), observers=[lambda v, c: 1 / 0, lambda v, c: told.append((v, c))])
    claims = leases.claim(NOW, 20)
    assert len(claims) == 20 and {c["outcome"] for c in claims} <= {"leased", "poisoned"}
    assert told and told[0][0] == 2 and told[0][1]["leased"] + told[0][1]["poisoned"] == 20
    tokens = [c["claim_token"] for c in claims if c["claim_token"]]
    now = {r.claim_token: r for r in held.read("runs").filter(F.col("claim_token").isin(tokens)).collect()}
    assert set(now) == set(tokens) and all(r.wake_at is None and r.claimed_at == NOW for r in now.values())
    assert not {c["id"] for c in leases.claim(NOW, 20)} & {c["id"] for c in claims}
    leases.refresh(tokens[:1], NOW + 5)
    leases.refresh(tokens[:1], NOW + 1)
    assert held.read("runs").filter(F.col("claim_token") == tokens[0]).first().claimed_at == NOW + 5
    before = now[tokens[1]]
    leases.abandon(tokens[1:2], NOW)
    after = held.read("runs").filter(F.col("id") == before.id).first()
    assert after.claim_token is None and after.wake_at > NOW and after.claim_abandons == before.claim_abandons + 1 and after.poisoned_at is None
    leases.abandon([tokens[2]], NOW, max_abandons=1)
    poisoned = held.read("runs").filter(F.col("id") == now[tokens[2]].id).first()
    assert poisoned.poison_reason == "max_claim_abandons_exceeded" and poisoned.wake_at is None
    assert leases.retry_poisoned(poisoned.run_id, NOW) and not leases.retry_poisoned(poisoned.run_id, NOW) and not leases.retry_poisoned("none", NOW)
    assert held.read("runs").filter(F.col("id") == poisoned.id).first().wake_at == NOW
    assert held.read("runs").count() == held.read("runs", 1).count()


def test_gates(held):
    for leases, code in ((Leases(held, policy(), read_only=True), "read_only"), (Leases(held, Windowed()), "wrong_mode")):
        with pytest.raises(Unavailable) as error:
            leases.claim(NOW, 5)
        assert error.value.code == code
    with pytest.raises(ValueError):
        policy(unknown=1)
    with pytest.raises(ValueError):
        policy(ttl=0)


def test_signals_are_made_anew_when_another_commit_came_first(held):
    leases, calls_ = Leases(held, policy()), []

    def change(rows):
        calls_.append(1)
        if len(calls_) < 3:  # another writer is quicker, twice
            held.commit({"runs": rows}, held.current())
        return rows.withColumn("status", F.when(F.col("id") == 1, "cancelled").otherwise(F.col("status")))

    assert leases.signal(change) == 4 and len(calls_) == 3
    calls_.clear()
    with pytest.raises(Unavailable):
        leases.signal(change, attempts=2)


def test_dispatcher_commits_what_work_proposes(spark, held):
    leases = Leases(held, policy(max_attempts=100))
    seen = []

    def work(claims):
        seen.extend(c["run_id"] for c in claims)
        if len(seen) == len(claims):
            assert dispatcher.poll(NOW) == 0  # asked for while it runs
        mine = spark.createDataFrame([(c["run_id"], c["claim_token"]) for c in claims], "run_id string, token string")
        return held.read("runs").join(mine, "run_id").select(
            F.col("id").alias("proposal_id"), "run_id", "scope_key", "graph_id", "graph_hash", "started_at", F.col("checkpoint_seq").alias("expected_seq"),
            (F.col("checkpoint_seq") + 1).alias("checkpoint_seq"), "token", F.lit("done").alias("status"), (F.col("step") + 1).alias("step"), F.lit("terminal").alias("effect"),
            F.lit(None).cast("long").alias("until"), F.lit(NOW).alias("updated_at"), F.lit(NOW).alias("finished_at"), F.array(F.lit("run_completed")).alias("events"),
        )

    dispatcher = Dispatcher(leases, work, limit=40)
    held.commit({"runs": held.read("runs").filter("id < 800")}, 1)
    due = held.read("runs").filter(f"status = 'running' and poisoned_at is null and (wake_at <= {NOW} or claimed_at < {NOW - DAY})").count()
    assert dispatcher.poll(NOW) == due == len(set(seen)) > 40
    rows = held.read("runs").filter(F.col("run_id").isin(seen)).collect()
    assert all(r.status == "done" and r.claim_token is None and r.wake_at is None for r in rows)
    assert held.appended("events").filter("type = 'run_completed'").count() == due
    assert commits.duplicated(held.appended("events"), ["run_id", "seq"]).collect() == []


def test_runs_without_a_claim_are_not_dealt_to_one_task(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = spark.createDataFrame(runs(spark, DATA).collect(), runs(spark, DATA).schema).repartition(8)
    tokens = spark.createDataFrame([(None,), ("tok-3",), ("tok-3",), ("none",)], "claim_token string").unionByName(rows.filter("id % 2 = 0").select("claim_token"))
    mine = {r.claim_token for r in tokens.collect()} - {None}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = commits.abandoned(rows, tokens, NOW, 1, 8).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    names = ["id", "claim_token", "claim_abandons", "wake_at"]
    want = [(r.id, None, r.claim_abandons + 1, NOW + min(2**r.claim_abandons, 8)) if r.claim_token in mine else tuple(r[n] for n in names) for r in rows.collect()]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(want) and any(r.claim_token in mine for r in rows.collect())
    sizes = Counter(r.part for r in got)
    assert max(sizes.values()) < len(got) / 4  # most runs have no claim


def test_attempts_are_classified():
    run = lambda call, ms=500: calls.attempt(call, {"x": 1}, 1, ("y",), ms)[:3]
    assert calls.attempt(lambda s, n: ("ok", {"y": s["x"] + n}), {"x": 1}, 1, ("y",), 500) == ("ok", False, None, {"y": 2})
    assert run(lambda s, n: ("error", "later")) == ("error", True, "later")
    assert run(lambda s, n: s["none"]) == ("error", True, "KeyError: 'none'")
    assert run(lambda s, n: exit(3)) == ("error", True, "SystemExit: 3")
    assert run(lambda s, n: time.sleep(2), 50) == ("error", True, "timeout")
    assert run(lambda s, n: None) == run(lambda s, n: ("await", 1)) == run(lambda s, n: ("ok", 5)) == ("error", False, "invalid_return")
    assert run(lambda s, n: ("ok", {"z": 1})) == ("error", False, "invalid_write")
    assert run(lambda s, n: ("interrupt", None)) == ("interrupt", False, None)


def test_calls_that_wait_pass_beside_each_other(spark):
    """Half of the calls of one task wait, a third of these beyond their time; each row keeps its own result."""

    def waits(state, attempt):
        if state["key"] % 2:
            time.sleep(1 if state["key"] % 6 == 1 else 0.2)
        return "ok", {"out": state["key"] + attempt}

    rows = spark.range(120).coalesce(1)
    made = lambda on: rows.select("id", calls.called(waits, {"key": F.col("id")}, on, F.lit(1), {"out": T.LongType()}, 500).alias("u")).collect()
    assert all(r.u.status is None for r in made(F.lit(False)))  # starts Python
    began = time.monotonic()
    got = {r.id: (r.u.status, r.u.reason, r.u.v_out) for r in made(F.col("id") % 5 != 0)}
    assert time.monotonic() - began < 6  # one after another they wait 14 s
    assert got == {i: (None, None, None) if i % 5 == 0 else ("error", "timeout", None) if i % 6 == 1 else ("ok", None, i + 1) for i in range(120)}


def test_calls_that_do_not_wait_share_a_thread(spark):
    name = lambda state, attempt: ("ok", {"out": threading.current_thread().name})
    rows = spark.range(400).coalesce(1)
    made = rows.select(calls.called(name, {"key": F.col("id")}, F.lit(True), F.lit(1), {"out": T.StringType()}, 5000).alias("u")).collect()
    assert len(made) == 400 and len({r.u.v_out for r in made}) <= 10


def test_called_nodes_interrupt_and_hold(spark):
    """A call that succeeded is not made again while its sibling is tried again, and an interrupt waits for its answer."""

    def ask(state, attempt):
        return ("interrupt", None) if state["say"] is None else ("ok", {"out": state["say"] + "!"})

    def count(state, attempt):
        return "ok", {"many": [attempt]}

    g = Graph("calls").put_input("key", Field(INT, required=True))
    for name, f in (("say", Field(TEXT)), ("out", Field(TEXT)), ("many", Field(Schema("list", item=INT), Reducer("append")))):
        g = g.put_field(name, f).put_output(name)
    g = g.put_node("count", Node(call=count, writes=("many",))).put_node("flaky", Node(fails=lambda v: v.attempt < 3, max_attempts=3, backoff_ms=10))
    g = g.put_node("ask", Node(call=ask, writes=("out",), resume="say"))
    g = g.put_edge("e0", START, "count").put_edge("e1", START, "flaky").put_edge("e2", ("count", "flaky"), "ask").put_edge("e3", "ask", FINISH)
    engine = Engine(g)
    rows = engine.run(engine.start(spark.createDataFrame([(1,), (2,)], "key long"), "key"))
    assert {(r.run_id, r.status, r.waiting, tuple(r.v_many), r.clock) for r in rows.collect()} == {(1, "waiting", "ask", (1,), 20), (2, "waiting", "ask", (1,), 20)}
    answers = spark.createDataFrame([(1, "ask", "yes")], "run_id long, node string, value string")
    got = {r.run_id: (r.status, r.out) for r in engine.outputs(engine.run(engine.resolve(rows, answers))).collect()}
    assert got == {1: ("done", "yes!"), 2: ("waiting", None)}


def test_parked_runs_wait_for_the_clock(spark):
    engine = Engine(flows.backoff())
    start = spark.createDataFrame([(k, "p") for k in range(4)], "key long, prio string")
    rows = engine.run(engine.start(start, "key", now=100), now=100)
    assert {r.run_id: (r.status, r.wake_at) for r in rows.collect()} == {0: ("done", None), 1: ("running", 600), 2: ("running", 600), 3: ("running", 600)}
    rows = engine.run(rows, now=599)
    assert {r.run_id: r.disposition for r in engine.disposition(rows).collect()} == {0: "park_terminal", 1: "park_at", 2: "park_at", 3: "park_at"}
    rows = engine.run(engine.run(rows, now=600), now=2000)
    assert {r.run_id: (r.status, r.v_out) for r in rows.collect()} == {0: ("done", 1), 1: ("done", 2), 2: ("done", 3), 3: ("failed", None)}


def test_shell_goes_on_past_a_bad_answer(spark, tmp_path):
    told = []
    for store in (None, MemoryStore(spark)):
        shell = RunShell(spark, Engine(flows.counted_review()), str(tmp_path / "shell"), store, [lambda v, c: told.append((v, c["live"]))])
        schema = "kind string, run_id string, node string, value string, key long, prio string"
        batches = [
            [("start", "a", None, None, 1, "p"), ("start", "b", None, None, 2, "p")],
            [("resolve", "a", "gate", "abc", None, None), ("resolve", "b", "gate", "7", None, None)],
            [("resolve", "a", "gate", "8", None, None)],
        ]
        for n, batch in enumerate(batches):
            assert shell.process(spark.createDataFrame(batch, schema), n)
        assert {r.run_id: (r.status, r.applied) for r in shell.outputs().collect()} == {"a": ("done", 9), "b": ("done", 8)}
    assert told == [(1, 2), (2, 1), (3, 0)] * 2


def test_policies_are_checked():
    g = flows.python_node()
    for bad in ({"backoff_ms": -1}, {"timeout_ms": 0}, {"max_attempts": True}):
        assert "invalid_policy" in {d.code for d in g.update_node("call", **bad).verify()}
    assert "invalid_node_config" in {d.code for d in g.update_node("call", writes=("nothing",)).verify()}
    assert "invalid_node_config" in {d.code for d in g.update_node("call", fails=lambda v: v["key"] > 0).verify()}


def test_called_nodes_have_a_wire_form():
    registry = {"sized": lambda config: Node(call=flows.sized, writes=("size", "tries"))}
    g = flows.python_node().put_node("call", wire.built(registry, "sized", max_attempts=2, backoff_ms=7, timeout_ms=50))
    back = wire.from_json(wire.to_json(g), registry)
    assert back.hash() == g.hash() and (back.nodes["call"].backoff_ms, back.nodes["call"].timeout_ms) == (7, 50)
    assert back.hash() != g.update_node("call", backoff_ms=8).hash()


def test_short_forms():
    assert Schema.of("string") == Schema("string") and Schema.of(("integer", {"min": 0})) == Schema("integer", min=0)
    assert Schema.of(("list", ("enum", ["a"]), {"min_items": 1})) == Schema("list", item=Schema("enum", values=("a",)), min_items=1)
    assert Schema.of(("object", {"a": "float"})).fields == {"a": Schema("float")}
    assert Reducer.of("sum") == Reducer("sum") and Reducer.of(("union", {"by": "id"})) == Reducer("union", by=("id",))
    for bad in (5, ("string", 3), ("integer",), "nothing"):
        with pytest.raises(ValueError):
            Schema.of(bad)
    for bad in (5, "nothing", ("sum", 3)):
        with pytest.raises(ValueError):
            Reducer.of(bad)


def test_patterns_must_suit_both_engines(spark):
    assert compiles("a+") and not compiles("(?P<x>a)") and not compiles("a++(") and not Schema("string", pattern="(?P<x>a)").sound()


def test_unlike_values_are_unequal(spark):
    kinds = spark.createDataFrame([("5", 5, 5.0, True)], "s string, i long, f double, b boolean")
    view = {f.name: G.Channel(F.col(f.name), F.lit(1), f.dataType) for f in kinds.schema.fields}
    tests = [("s", 5, False), ("s", "5", True), ("i", "5", False), ("i", 5.0, True), ("f", 5, True), ("b", 1, False), ("b", True, True), ("i", G.path("s", []), False), ("i", G.path("f", []), True)]
    got = kinds.select(*[G.to_column(G.equals(a, b), view).alias(str(n)) for n, (a, b, _) in enumerate(tests)]).first()
    assert list(got) == [want for _, _, want in tests]


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("if(id < 4990, 'hot', null) g", "id * 7 % 4999 v")
    got = {r.g: r for r in M.nearest_rank(df, ["g"], "v").collect()}
    for g in ("hot", None):
        values = sorted(r.v for r in df.collect() if r.g == g)
        assert [got[g].n, got[g].least, got[g].most] == [len(values), values[0], values[-1]]
        assert [got[g].p50, got[g].p95, got[g].p99] == [values[-(-len(values) * p // 100) - 1] for p in (50, 95, 99)]
    assert M.nearest_rank(df.limit(0), ["g"], "v").collect() == []


def test_telemetry(spark):
    log = spark.createDataFrame([("a", 1, 0, "node_completed", "x"), ("b", 1, 0, "node_completed", "x"), ("a", 2, 0, "checkpoint_committed", None)], "run_id string, seq long, step int, type string, subject string")
    assert {(r.name, r.step, r["count"]) for r in telemetry(log).collect()} == {("node.completed", 0, 2), ("checkpoint.committed", 0, 1)}
