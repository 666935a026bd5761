"""Every registered query with SQL against DuckDB on the smallest tables, and units of the state algebra."""

import json
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepgraph.functions import guards as G
from stepgraph.functions import reducers as R
from stepgraph.functions.schemas import Schema, violations
from stepgraph.operators import admission, reach, store
from stepgraph.plans import catalog, flows
from stepgraph.plans.engine import Engine
from stepgraph.plans.graph import FINISH, START, Field, Graph, Node, Reducer
from stepgraph.sources.snapshots import SnapshotStore, checkpoint

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalog.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


WRITES = [("r", 1, "a", 1.0), ("r", 2, None, 2.0), ("r", 3, "b", 3.0), ("r", 4, "a", 4.0), ("q", 1, None, None)]


def folded(spark, fold, *args, **kw):
    df = spark.createDataFrame(WRITES, "run string, o int, v string, x double")
    return {r["run"]: r["value"] for r in fold(df, ["run"], ["o"], *args, **kw).collect()}


def test_reducers_keep_nulls_and_order(spark):
    assert folded(spark, R.append, "v") == {"r": ["a", None, "b", "a"], "q": [None]}
    assert folded(spark, R.append, "v", unique=True) == {"r": ["a", None, "b"], "q": [None]}
    assert folded(spark, R.append, "v", unique=True, max_length=2) == {"r": [None, "b"], "q": [None]}
    assert folded(spark, R.last_value, "v")["r"] == "a"
    assert folded(spark, R.first_value, "v")["r"] == "a"
    assert folded(spark, R.total, "x", ordered=True) == {"r": 10.0, "q": 0.0}
    with pytest.raises(ValueError):
        folded(spark, R.append, "v", max_length=0)


def test_union_by_keeps_elements_without_the_key_apart(spark):
    assert folded(spark, R.union, "x", by=F.col("v"))["r"] == [1.0, 2.0, 3.0]


def test_merge_deep_is_right_biased():
    assert R.merged_deep({"a": {"b": 1, "c": 2}}, {"a": {"b": None}, "d": 1}) == {"a": {"b": None, "c": 2}, "d": 1}


def test_guards_tell_unset_from_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), (3, 2)], "v long, n int")
    view = {"f": G.Channel(F.col("v"), F.col("n"), T.LongType())}
    test = lambda g: [r[0] for r in df.select(G.to_column(g, view)).collect()]
    assert test(G.exists("f")) == [True, False, True]
    assert test(G.equals("f", 3)) == [False, False, True]
    assert test(G.all_of()) == [True] * 3 and test(G.any_of()) == [False] * 3
    assert test(G.not_(G.version_at_least("f", 2))) == [True, True, False]


def test_list_violations_carry_the_index(spark):
    df = spark.createDataFrame([([1, 9],), (None,)], "v array<long>")
    got = [r[0] for r in df.select(violations(Schema("list", item=Schema("integer", max=5)), F.col("v"), "v")).collect()]
    assert got == [["v[1] must be at most 5"], []]


def codes(graph):
    return {d.code for d in graph.verify()}


def test_diagnostics():
    assert not codes(flows.linear()) and not codes(flows.fanout_join())
    g = flows.linear()
    assert "unknown_edge_target" in codes(g.put_edge("x", "one", "nowhere"))
    assert "unreachable_node" in codes(g.put_node("alone", Node()))
    assert "duplicate_edge_source" in codes(g.put_edge("x", ("one", "one"), "two"))
    assert "reducer_schema_mismatch" in codes(g.put_field("l", Field(Schema("string"), Reducer("sum"))))
    assert "orphaned_field" in codes(g.put_field("unused", Field(Schema("string"))))
    assert "unbounded_cycle" in codes(flows.counter(None))
    assert "invalid_public_id" in codes(g.put_output("not ok", "a"))
    assert "unknown_guard_field" in codes(g.put_edge("x", "one", FINISH, G.exists("no")))
    assert "no_entrypoint" in codes(Graph("g").put_node("a", Node()))


def test_identity_does_not_depend_on_order():
    a = Graph("g").put_node("x", Node()).put_node("y", Node()).put_edge("e", START, "x")
    b = Graph("g").put_edge("e", START, "x").put_node("y", Node()).put_node("x", Node())
    assert a.hash() == b.hash() and a.hash() != b.put_edge("f", "x", "y").hash()


def test_missing_required_input_fails(spark):
    engine = Engine(flows.linear())
    out = engine.outputs(engine.run(engine.start(spark.createDataFrame([(None, "p")], "key long, prio string"), "prio"))).collect()
    assert [(r.status, r.a) for r in out] == [("failed", None)]


def test_fan_in_needs_all_its_sources(spark):
    edges = spark.createDataFrame([(1, "x", 0, 2), (1, "x", 1, 2), (1, "y", 0, 3)], "graph int, edge string, source int, target int")
    start = spark.createDataFrame([(1, 0)], "graph int, node int")
    assert {r.node for r in reach.reachable(edges, start, barriers=True).collect()} == {0, 3}
    assert {r.node for r in reach.reachable(edges, start).collect()} == {0, 2, 3}


def test_queries_without_sql_against_brute_force(spark):
    lines = [r.asDict() for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_partkey").collect()]
    graphs = {}
    for x in lines:
        graphs.setdefault(x["l_orderkey"], set()).add((x["l_suppkey"] % 8, x["l_partkey"] % 8))
    want = set()
    for graph, pairs in graphs.items():
        needs = {}
        for source, target in pairs:
            needs.setdefault((target, source % 3), set()).add(source)
        seen = {min(s for s, _ in pairs)}
        while more := {t for (t, _), sources in needs.items() if sources <= seen} - seen:
            seen |= more
        want |= {(graph, n) for n in seen}
    assert {tuple(r) for r in catalog.QUERIES["graph_and_reachability"](spark, DATA).collect()} == want

    state = {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts").collect():
        held = state.setdefault(str(r.user_id), {})
        held[r.event_type] = {**held.get(r.event_type, {}), **json.loads(r.props)}
    assert {r.run_id: json.loads(r.value) for r in catalog.QUERIES["reduce_merge_deep"](spark, DATA).collect()} == state


def test_answers_of_next_preference_and_retention_policy():
    assert [admission.next_preference(*x) for x in ((1, "ready", True), (1, "expired", True), (1, "ready", False), (2, "ready", True))] == ["expired", "ready", "ready", "ready"]
    assert store.retention_policy(1, 1) == (1, 1)
    for ages in ((2, 1), (0, 1)):
        with pytest.raises(ValueError):
            store.retention_policy(*ages)


def test_snapshot_commit_is_fenced(spark, tmp_path):
    tables = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert tables.commit({"runs": spark.range(3)}, 0) == 1
    with pytest.raises(RuntimeError):
        tables.commit({"runs": spark.range(9)}, 0)
    assert tables.read("runs").count() == 3 and tables.commit({"runs": spark.range(2)}, 1) == 2
    assert tables.read("runs").count() == 2 and tables.appended("runs").count() == 5


def test_cycles_in_chains_and_cores(spark):
    """A chain longer than the trimming, two cycles that a path joins, and a self-loop."""
    chain = [("long", i, i + 1) for i in range(12)]
    core = [("core", 1, 2), ("core", 2, 1), ("core", 2, 3), ("core", 3, 4), ("core", 4, 5), ("core", 5, 4), ("core", 5, 6), ("loop", 7, 7)]
    df = spark.createDataFrame(chain + core, "graph string, source long, target long")
    assert {(r.graph, r.node) for r in reach.cyclic(df).collect()} == {("core", 1), ("core", 2), ("core", 4), ("core", 5), ("loop", 7)}
    assert reach.cyclic(df.limit(0)).collect() == []


def test_reach_over_many_rounds(spark):
    df = spark.createDataFrame([("g", str(i), i, i + 1) for i in range(20)], "graph string, edge string, source long, target long")
    start = spark.createDataFrame([("g", 3)], "graph string, node long")
    assert sorted(r.node for r in reach.reachable(df, start).collect()) == list(range(3, 21))


def test_graphs_within_tasks_and_by_rounds_agree(spark, monkeypatch):
    """Small graphs go whole in one job's shuffle, larger ones by rounds; null ends, repeated rows and several start nodes alike."""
    draw = random.Random(5)
    rows = [(g, str(draw.randrange(6)), draw.randrange(9), draw.randrange(9)) for g in range(60) for _ in range(1 + g % 14)]
    rows += rows[::7] + [(1, "n", 1, None), (1, "n", 2, 3), (2, None, 0, 1), (None, "x", 0, 1), (3, "o", None, 4), (3, "o", 0, 5), (99, "x", 1, 5)]
    edges = spark.createDataFrame(rows, "graph int, edge string, source int, target int")
    begins = [(g, draw.randrange(9)) for g in range(60) for _ in range(1 + g % 3)] + [(99, 1), (99, 5), (98, 4), (98, 4), (None, 1), (4, None)]
    start = spark.createDataFrame(begins, "graph int, node int")
    for barriers in (False, True):
        want = set(begins)
        while True:
            needs = {}
            for g, e, s, t in rows:
                key = (g, e) if barriers else (g, s)
                if None not in key:
                    sources, targets = needs.setdefault(key, (set(), set()))
                    sources.update([(g, s)] if s is not None else [])
                    targets.update([(g, t)] if t is not None else [])
            more = {n for sources, targets in needs.values() if sources and sources <= want for n in targets} - want
            if not more:
                break
            want |= more
        for small in (1_000, 7, 0):
            monkeypatch.setattr(reach, "SMALL", small)
            got = [tuple(r) for r in reach.reachable(edges, start, barriers).collect()]
            assert len(got) == len(want) and set(got) == want


def test_small_graphs_are_written_once(spark, monkeypatch):
    """Rounds of joins would write the edges of all graphs and what each round finds."""
    written = []
    monkeypatch.setattr(reach, "checkpoint", lambda df: written.append(df := checkpoint(df)) or df)
    edges = spark.createDataFrame([(g, str(i), i, i + 1) for g in range(50) for i in range(9)], "graph int, edge string, source int, target int")
    for barriers in (False, True):
        rows = reach.reachable(edges, edges.select("graph", F.lit(2).alias("node")), barriers)
        assert rows.count() == 50 * 8 and sum(df.count() for df in written) == 0
