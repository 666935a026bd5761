"""Dataflows over all orders: each advances every order as a run and is checked against its closed form."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions.schemas import Schema
from ..sources.tables import table
from .engine import Engine
from .graph import FINISH, START, Field, Graph, Node, Reducer

INT, TEXT = Schema("integer"), Schema("string")


def _base(name: str, **fields: Field) -> Graph:
    graph = Graph(name).put_input("key", Field(INT, required=True)).put_input("prio", Field(TEXT))
    for field, what in fields.items():
        graph = graph.put_field(field, what).put_output(field)
    return graph


def _inputs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("prio"))


def _run(graph: Graph):
    def run(spark, d):
        engine = Engine(graph)
        return engine.outputs(engine.run(engine.start(_inputs(spark, d), "key")))

    return run


def node(**update) -> Node:
    return Node(update)


def linear() -> Graph:
    """key -> a = key + 1 -> b = 2 a."""
    g = _base("linear", a=Field(INT), b=Field(INT)).put_node("one", node(a=lambda v: v["key"] + 1)).put_node("two", node(b=lambda v: v["a"] * 2))
    return g.put_edge("e0", START, "one").put_edge("e1", "one", "two").put_edge("e2", "two", FINISH)


def fanout_join() -> Graph:
    """Two branches append in the order of their ids, a fan-in sums what both wrote."""
    g = _base("fanout", left=Field(INT), right=Field(INT), both=Field(INT), log=Field(Schema("list", item=TEXT), Reducer("append")))
    one = lambda t: F.array(F.lit(t))
    g = g.put_node("root", Node()).put_node("l", node(left=lambda v: v["key"] % 10, log=lambda v: one("l"))).put_node("r", node(right=lambda v: v["key"] % 7, log=lambda v: one("r")))
    g = g.put_node("join", node(both=lambda v: v["left"] + v["right"], log=lambda v: one("join")))
    g = g.put_edge("e0", START, "root").put_edge("e1", "root", "l").put_edge("e2", "root", "r").put_edge("e3", ("l", "r"), "join").put_edge("e4", "join", FINISH)
    return g


def guarded() -> Graph:
    """One of two nodes by a guard and its negation."""
    high = G.any_of(G.equals("prio", "1-URGENT"), G.equals("prio", "2-HIGH"))
    g = _base("guarded", plan=Field(TEXT)).put_node("start", Node()).put_node("fast", node(plan=lambda v: F.lit("fast"))).put_node("slow", node(plan=lambda v: F.lit("slow")))
    g = g.put_edge("e0", START, "start").put_edge("e1", "start", "fast", high).put_edge("e2", "start", "slow", G.not_(high))
    return g.put_edge("e3", "fast", FINISH).put_edge("e4", "slow", FINISH)


def counter(limit: int | None = 50) -> Graph:
    """Counts up to key % 6 + 1 in a cycle."""
    g = _base("counter", count=Field(INT, Reducer("sum"), default=0), left=Field(INT))
    g = g.put_node("add", node(count=lambda v: F.lit(1), left=lambda v: v["key"] % 6 - v["count"]))
    g = g.put_edge("e0", START, "add").put_edge("e1", "add", "add", G.not_(G.equals("left", 0))).put_edge("e2", "add", FINISH)
    return Graph(**{**vars(g), "max_supersteps": limit})


def conflict() -> Graph:
    """Two writers of one field in one step: the last node id wins; first keeps the first."""
    g = _base("conflict", out=Field(TEXT), first=Field(TEXT, Reducer("first_value")))
    for name in ("b", "a"):
        g = g.put_node(name, node(out=lambda v, n=name: F.concat(F.lit(n), v["key"].cast("string")), first=lambda v, n=name: F.lit(n)))
        g = g.put_edge(f"s{name}", START, name).put_edge(f"f{name}", name, FINISH)
    return g


def isolation() -> Graph:
    """A reader in the step of a writer sees the value from before."""
    g = _base("isolation", x=Field(TEXT, default="old"), y=Field(TEXT)).put_node("w", node(x=lambda v: F.lit("new"))).put_node("r", node(y=lambda v: v["x"]))
    return g.put_edge("e0", START, "w").put_edge("e1", START, "r").put_edge("e2", "w", FINISH).put_edge("e3", "r", FINISH)


def failure() -> Graph:
    """A failing node voids what its siblings wrote in that step."""
    g = _base("failure", ok=Field(TEXT)).put_node("good", node(ok=lambda v: F.lit("yes"))).put_node("bad", Node(fails=lambda v: v["key"] % 4 == 0))
    return g.put_edge("e0", START, "good").put_edge("e1", START, "bad").put_edge("e2", "good", FINISH).put_edge("e3", "bad", FINISH)


def retry() -> Graph:
    """Fails key % 4 times with three attempts."""
    g = _base("retry", out=Field(INT)).put_node("flaky", Node({"out": lambda v: v.attempt}, fails=lambda v: v.attempt <= v["key"] % 4, max_attempts=3))
    return g.put_edge("e0", START, "flaky").put_edge("e1", "flaky", FINISH)


def review() -> Graph:
    """Waits for a decision, then applies it."""
    g = _base("review", decision=Field(TEXT), applied=Field(TEXT))
    g = g.put_node("gate", Node({"applied": lambda v: F.concat(F.lit("did "), v["decision"])}, interrupts=lambda v: v.version("decision") == 0, resume="decision"))
    return g.put_edge("e0", START, "gate").put_edge("e1", "gate", FINISH)


def _review(spark, d):
    engine = Engine(review())
    waiting = engine.run(engine.start(_inputs(spark, d), "key"))
    answers = _inputs(spark, d).filter("key % 3 <> 0").select(F.col("key").alias("run_id"), F.lit("gate").alias("node"), F.col("prio").alias("value"))
    return engine.outputs(engine.run(engine.resolve(waiting, answers)))


def _limited(spark, d):
    engine = Engine(counter(4))
    rows = engine.run(engine.start(_inputs(spark, d), "key"))
    return rows.groupBy("status", "code").agg(F.count(F.lit(1)).alias("runs"), F.max("step").alias("steps"))


def _events(spark, d):
    engine = Engine(fanout_join())
    return engine.events(engine.run(engine.start(_inputs(spark, d), "key")))


def _log(spark, d):
    """Every event of the fan-out, its subject empty for a whole run."""
    engine = Engine(fanout_join())
    return engine.log(engine.run(engine.start(_inputs(spark, d), "key"))).fillna("", ["subject"])


def retry_beside() -> Graph:
    """A node that succeeds at its first attempt only is held while its sibling is tried again."""
    g = _base("beside", out=Field(INT), once=Field(INT)).put_node("flaky", Node({"out": lambda v: v.attempt}, fails=lambda v: v.attempt <= v["key"] % 3, max_attempts=3))
    g = g.put_node("once", Node({"once": lambda v: v.attempt}, fails=lambda v: v.attempt > 1, max_attempts=9))
    return g.put_edge("e0", START, "flaky").put_edge("e1", START, "once").put_edge("e2", ("flaky", "once"), FINISH)


def backoff() -> Graph:
    """Fails key % 4 times with three attempts, half a second apart; a sibling that succeeded is held meanwhile."""
    g = _base("backoff", out=Field(INT), once=Field(INT))
    g = g.put_node("flaky", Node({"out": lambda v: v.attempt}, fails=lambda v: v.attempt <= v["key"] % 4, max_attempts=3, backoff_ms=500))
    g = g.put_node("once", Node({"once": lambda v: v.attempt}, fails=lambda v: v.attempt > 1, max_attempts=9))
    return g.put_edge("e0", START, "flaky").put_edge("e1", START, "once").put_edge("e2", ("flaky", "once"), FINISH)


def _backoff(spark, d):
    engine = Engine(backoff())
    rows = engine.run(engine.start(_inputs(spark, d), "key"))
    return engine.outputs(rows).join(rows.select("run_id", "clock"), "run_id")


def _parked(spark, d):
    """What is due half a second after the start has run; the rest waits for its deadline."""
    engine = Engine(backoff())
    rows = engine.run(engine.start(_inputs(spark, d), "key", now=10_000), now=10_000)
    return engine.disposition(engine.run(rows, now=10_500))


def sized(state: dict, attempt: int):
    """A call that raises once for some runs and gives nonsense for others."""
    if state["key"] % 5 == 0 and attempt == 1:
        raise ValueError("first attempt")
    if state["key"] % 11 == 0:
        return "nonsense"
    return "ok", {"size": len(state["prio"]), "tries": attempt}


def python_node() -> Graph:
    g = _base("sized", size=Field(INT), tries=Field(INT)).put_node("call", Node(call=sized, writes=("size", "tries"), max_attempts=2))
    return g.put_edge("e0", START, "call").put_edge("e1", "call", FINISH)


def _python(spark, d):
    engine = Engine(python_node())
    rows = engine.run(engine.start(_inputs(spark, d), "key"))
    return engine.outputs(rows).join(rows.select("run_id", "why"), "run_id")


def slow(state: dict, attempt: int):
    if state["key"] % 3000 == 1:
        time.sleep(3)
    return "ok", {"out": state["key"]}


def timeout() -> Graph:
    g = _base("slow", out=Field(INT)).put_node("call", Node(call=slow, writes=("out",), timeout_ms=1000))
    return g.put_edge("e0", START, "call").put_edge("e1", "call", FINISH)


def _timeout(spark, d):
    engine = Engine(timeout())
    rows = engine.run(engine.start(_inputs(spark, d), "key"))
    return rows.groupBy("status", "why").agg(F.count(F.lit(1)).alias("runs"), F.sum("v_out").alias("total"))


def doubled() -> Graph:
    g = Graph("doubled").put_input("n", Field(INT, required=True)).put_field("out", Field(INT)).put_output("out")
    return g.put_node("two", node(out=lambda v: v["n"] * 2)).put_edge("e0", START, "two").put_edge("e1", "two", FINISH)


def _bad_inputs(spark, d):
    """A third of the runs are given text that is no number; they fail, the others do not."""
    engine = Engine(doubled())
    given = F.when(F.col("key") % 3 == 0, F.col("prio")).otherwise(F.col("key").cast("string"))
    rows = engine.run(engine.start(_inputs(spark, d).select("key", given.alias("n")), "key"))
    return engine.outputs(rows).join(rows.select("run_id", "code"), "run_id")


def counted_review() -> Graph:
    """Waits for a number of at most 40,000."""
    g = _base("counted", decision=Field(Schema("integer", max=40_000)), applied=Field(INT))
    g = g.put_node("gate", Node({"applied": lambda v: v["decision"] + 1}, interrupts=lambda v: v.version("decision") == 0, resume="decision"))
    return g.put_edge("e0", START, "gate").put_edge("e1", "gate", FINISH)


def _bad_answers(spark, d):
    """Answers that are no numbers or too large leave their runs waiting and the others alone."""
    engine = Engine(counted_review())
    waiting = engine.run(engine.start(_inputs(spark, d), "key"))
    value = F.when(F.col("key") % 3 == 1, F.concat(F.lit("x"), F.col("prio"))).otherwise(F.col("key").cast("string"))
    answers = _inputs(spark, d).filter("key % 3 <> 0").select(F.col("key").alias("run_id"), F.lit("gate").alias("node"), value.alias("value"))
    fate = engine.resolutions(waiting, answers).select("run_id", "outcome")
    return engine.outputs(engine.run(engine.resolve(waiting, answers))).join(fate, "run_id", "left")


def _yields(spark, d):
    """Counters with a budget of three supersteps: those not over by then yield."""
    engine = Engine(counter())
    rows = engine.disposition(engine.drain(engine.start(_inputs(spark, d), "key"), 3))
    return rows.groupBy("disposition").agg(F.count(F.lit(1)).alias("runs"))


def checked() -> Graph:
    """A write outside its field's bounds fails the run and is not tried again."""
    g = _base("checked", small=Field(Schema("integer", max=5)), seen=Field(Schema("map"), Reducer("merge")))
    g = g.put_node("a", Node({"small": lambda v: v["key"] % 8, "seen": lambda v: F.create_map(F.lit("x"), F.lit("a"), F.lit("p"), v["prio"])}, max_attempts=3))
    g = g.put_node("b", node(seen=lambda v: F.create_map(F.lit("x"), F.lit("b"))))
    return g.put_edge("e0", START, "a").put_edge("e1", START, "b").put_edge("e2", "a", FINISH).put_edge("e3", "b", FINISH)


def _checked(spark, d):
    return _run(checked())(spark, d).select("run_id", "status", "small", F.element_at("seen", "x").alias("x"), F.element_at("seen", "p").alias("p"))


_WHOLE_LOG = """[('0', 'node_completed', 'root'), ('0', 'edge_triggered', 'e1'), ('0', 'edge_triggered', 'e2'), ('0', 'checkpoint_committed', ''),
  ('1', 'node_completed', 'l'), ('1', 'node_completed', 'r'), ('1', 'channel_updated', 'left'), ('1', 'channel_updated', 'log'), ('1', 'channel_updated', 'right'),
  ('1', 'edge_triggered', 'e3'), ('1', 'checkpoint_committed', ''), ('2', 'node_completed', 'join'), ('2', 'channel_updated', 'both'), ('2', 'channel_updated', 'log'),
  ('2', 'edge_triggered', 'e4'), ('2', 'checkpoint_committed', ''), ('3', 'run_completed', ''), ('3', 'checkpoint_committed', '')]"""


def _fanout(spark, d):
    return _run(fanout_join())(spark, d).withColumn("log", F.array_join("log", ","))


def queries() -> dict:
    o = "FROM orders"
    return {
        "bsp_linear": (_run(linear()), f"SELECT o_orderkey AS run_id, 'done' AS status, 2 AS step, o_orderkey + 1 AS a, 2 * (o_orderkey + 1) AS b {o}"),
        "bsp_fanout_join": (_fanout, f"SELECT o_orderkey AS run_id, 'done' AS status, 3 AS step, o_orderkey % 10 AS \"left\", o_orderkey % 7 AS \"right\", o_orderkey % 10 + o_orderkey % 7 AS \"both\", 'l,r,join' AS log {o}"),
        "bsp_guarded": (_run(guarded()), f"SELECT o_orderkey AS run_id, 'done' AS status, 2 AS step, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS plan {o}"),
        "bsp_cycle_counter": (_run(counter()), f"SELECT o_orderkey AS run_id, 'done' AS status, CAST(o_orderkey % 6 + 1 AS INTEGER) AS step, o_orderkey % 6 + 1 AS count, CAST(0 AS BIGINT) AS \"left\" {o}"),
        "bsp_write_conflict": (_run(conflict()), f"SELECT o_orderkey AS run_id, 'done' AS status, 1 AS step, 'b' || o_orderkey AS out, 'a' AS first {o}"),
        "bsp_isolation": (_run(isolation()), f"SELECT o_orderkey AS run_id, 'done' AS status, 1 AS step, 'new' AS x, 'old' AS y {o}"),
        "bsp_failure_discards": (_run(failure()), f"SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS step, CASE WHEN o_orderkey % 4 <> 0 THEN 'yes' END AS ok {o}"),
        "bsp_retry": (_run(retry()), f"SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 3 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 1 END AS step, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 4 + 1 AS INTEGER) END AS out {o}"),
        "bsp_interrupt_resolve": (_review, f"SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'waiting' ELSE 'done' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS step, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS decision, CASE WHEN o_orderkey % 3 <> 0 THEN 'did ' || o_orderpriority END AS applied {o}"),
        "bsp_max_supersteps": (_limited, f"SELECT CASE WHEN o_orderkey % 6 < 4 THEN 'done' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 6 >= 4 THEN 'max_supersteps_exceeded' END AS code, count(*) AS runs, CAST(max(least(o_orderkey % 6 + 1, 4)) AS INTEGER) AS steps {o} GROUP BY 1, 2"),
        "bsp_event_log": (_log, f"SELECT o_orderkey AS run_id, i AS seq, CAST(e[1] AS INTEGER) AS step, e[2] AS type, e[3] AS subject FROM (SELECT o_orderkey, i, w[i] AS e FROM orders, range(1, 19) t(i), (SELECT {_WHOLE_LOG.replace('(', '[').replace(')', ']')} AS w))"),
        "bsp_retry_held": (_run(retry_beside()), f"SELECT o_orderkey AS run_id, 'done' AS status, 1 AS step, CAST(o_orderkey % 3 + 1 AS INTEGER) AS out, 1 AS once {o}"),
        "bsp_write_validation": (_checked, f"SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 8 > 5 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 8 <= 5 THEN o_orderkey % 8 END AS small, CASE WHEN o_orderkey % 8 <= 5 THEN 'b' END AS x, CASE WHEN o_orderkey % 8 <= 5 THEN o_orderpriority END AS p {o}"),
        "bsp_backoff": (_backoff, f"SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 3 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 1 END AS step, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 4 + 1 AS INTEGER) END AS out, CASE WHEN o_orderkey % 4 < 3 THEN 1 END AS once, 500 * least(o_orderkey % 4, 2) AS clock {o}"),
        "bsp_parked": (_parked, f"SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 < 2 THEN 'park_terminal' ELSE 'park_at' END AS disposition, CASE WHEN o_orderkey % 4 >= 2 THEN CAST(11000 AS BIGINT) END AS until {o}"),
        "bsp_udf_node": (_python, f"SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS step, CASE WHEN o_orderkey % 11 <> 0 THEN length(o_orderpriority) END AS size, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END END AS tries, CASE WHEN o_orderkey % 11 = 0 THEN 'invalid_return' WHEN o_orderkey % 5 = 0 THEN 'ValueError: first attempt' END AS why {o}"),
        "bsp_timeout": (_timeout, f"SELECT CASE WHEN o_orderkey % 3000 = 1 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 3000 = 1 THEN 'timeout' END AS why, count(*) AS runs, CAST(sum(CASE WHEN o_orderkey % 3000 <> 1 THEN o_orderkey END) AS BIGINT) AS total {o} GROUP BY 1, 2"),
        "bsp_bad_inputs": (_bad_inputs, f"SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS step, CASE WHEN o_orderkey % 3 <> 0 THEN 2 * o_orderkey END AS out, CASE WHEN o_orderkey % 3 = 0 THEN 'invalid_input' END AS code {o}"),
        "bsp_bad_answers": (_bad_answers, f"SELECT o_orderkey AS run_id, CASE WHEN ok THEN 'done' ELSE 'waiting' END AS status, CASE WHEN ok THEN 2 ELSE 1 END AS step, CASE WHEN ok THEN o_orderkey END AS decision, CASE WHEN ok THEN o_orderkey + 1 END AS applied, CASE WHEN ok THEN 'resolved' WHEN o_orderkey % 3 <> 0 THEN 'invalid_value' END AS outcome FROM (SELECT *, o_orderkey % 3 = 2 AND o_orderkey <= 40000 AS ok {o})"),
        "bsp_yield": (_yields, f"SELECT CASE WHEN o_orderkey % 6 < 2 THEN 'park_terminal' ELSE 'park_immediate' END AS disposition, count(*) AS runs {o} GROUP BY 1"),
        "bsp_events": (_events, f"SELECT o_orderkey AS run_id, CAST(e[1] AS BIGINT) AS seq, CAST(e[2] AS INTEGER) AS step, e[3] AS node_id FROM (SELECT o_orderkey, unnest([['1', '0', 'root'], ['2', '1', 'l'], ['3', '1', 'r'], ['4', '2', 'join']]) AS e {o})"),
    }
