"""The superstep engine where SQL has no closed form: folds of typed values, several gates, held attempts, answers."""

from pyspark.sql import functions as F

from stepgraph.functions.schemas import Schema
from stepgraph.plans.engine import Engine
from stepgraph.plans.graph import FINISH, START, Field, Graph, Node, Reducer

INT, TEXT = Schema("integer"), Schema("string")
PAIR = Schema("object", fields={"id": INT, "tag": TEXT, "in": Schema("object", fields={"a": INT, "b": INT})})


def pair(i, tag, a=None, b=None):
    inner = F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    return F.struct(F.lit(i).cast("long").alias("id"), F.lit(tag).cast("string").alias("tag"), inner.alias("in"))


def finished(spark, graph, keys=(1,)):
    engine = Engine(graph)
    return engine, engine.run(engine.start(spark.createDataFrame([(k,) for k in keys], "key long"), "key"))


def base(**fields):
    g = Graph("g").put_input("key", Field(INT, required=True))
    for name, f in fields.items():
        g = g.put_field(name, f).put_output(name)
    return g


def both(g, a, b):
    g = g.put_node("a", a).put_node("b", b).put_edge("sa", START, "a").put_edge("sb", START, "b")
    return g.put_edge("fa", "a", FINISH).put_edge("fb", "b", FINISH)


def test_union_by_keeps_the_first_of_a_key_and_whole_elements_without_one(spark):
    g = base(all=Field(Schema("list", item=PAIR), Reducer("union", by=("id",))))
    a = Node({"all": lambda v: F.array(pair(1, "x"), pair(None, "n"))})
    b = Node({"all": lambda v: F.array(pair(1, "y"), pair(2, "z"), pair(None, "n"), pair(None, "m"))})
    engine, rows = finished(spark, both(g, a, b))
    got = engine.outputs(rows).first()["all"]
    assert [(r.id, r.tag) for r in got] == [(1, "x"), (None, "n"), (2, "z"), (None, "m")]


def test_merge_of_objects_is_right_biased_and_deep_where_asked(spark):
    for deep, a in ((True, 1), (False, None)):
        g = base(o=Field(PAIR, Reducer("merge", deep=deep)))
        engine, rows = finished(spark, both(g, Node({"o": lambda v: pair(1, "x", a=1)}), Node({"o": lambda v: pair(None, "y", b=2)})))
        got = engine.outputs(rows).first()["o"]
        assert (got.id, got.tag, got["in"].a, got["in"].b) == (1, "y", a, 2)


def test_null_writes(spark):
    g = base(n=Field(INT, Reducer("sum")), l=Field(Schema("list", item=INT), Reducer("append")), m=Field(Schema("map"), Reducer("merge")))
    null = lambda v: F.lit(None)
    one = Node({"n": lambda v: F.lit(1), "l": lambda v: F.array(F.lit(1)), "m": lambda v: F.create_map(F.lit("k"), F.lit("v"))})
    engine, rows = finished(spark, both(g, one, Node({"n": null, "l": null, "m": lambda v: F.lit(None).cast("map<string,string>")})))
    r = engine.outputs(rows).first()
    assert (r.n, r.l, r.m) == (1, [1, None], {"k": "v"})


def test_two_gates_of_one_run_are_answered_together_or_one_by_one(spark):
    gate = lambda name: Node({"out": lambda v: F.array(v[name])}, interrupts=lambda v: v.version(name) == 0, resume=name)
    g = base(p=Field(Schema("string", max_length=3)), q=Field(TEXT), out=Field(Schema("list", item=TEXT), Reducer("append")))
    engine, rows = finished(spark, both(g, gate("p"), gate("q")), (1, 2, 3))
    assert {r.waiting for r in rows.collect()} == {"a,b"}
    answers = spark.createDataFrame([(1, "a", "x"), (1, "a", "w"), (1, "b", "y"), (2, "b", "z"), (3, "a", "too long"), (3, "no", "x"), (9, "a", "x")], "run_id long, node string, value string")
    fates = {(r.run_id, r.node): r.outcome for r in engine.resolutions(rows, answers).collect()}
    assert fates == {(1, "a"): "resolved", (1, "b"): "resolved", (2, "b"): "resolved", (3, "a"): "invalid_value"}
    after = engine.run(engine.resolve(rows, answers))
    got = {r.run_id: (r.status, r.out) for r in engine.outputs(after).collect()}
    assert got == {1: ("done", ["w", "y"]), 2: ("waiting", ["z"]), 3: ("waiting", None)}
    late = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "x")], answers.schema)
    assert {r.run_id: r.outcome for r in engine.resolutions(after, late).collect()} == {1: "inactive_run", 2: "already_resolved", 3: "resolved"}


def test_failed_attempts_show_in_the_log_and_write_nothing(spark):
    g = base(out=Field(INT))
    g = both(g, Node({"out": lambda v: v["key"]}), Node(fails=lambda v: v.attempt <= v["key"], max_attempts=2))
    engine, rows = finished(spark, g, (1, 2))
    log = {}
    for r in engine.log(rows).orderBy("run_id", "seq").collect():
        log.setdefault(r.run_id, []).append(r.type)
    assert log[1][:2] == ["node_failed", "checkpoint_committed"] and log[1][-2:] == ["run_completed", "checkpoint_committed"]
    assert log[2] == ["node_failed", "checkpoint_committed", "run_failed", "checkpoint_committed"]
    assert {r.run_id: r.out for r in engine.outputs(rows).collect()} == {1: 1, 2: None}
