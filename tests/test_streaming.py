"""Streams: batches, replays, repeated deliveries and restarts."""

from pyspark.sql import functions as F

from stepgraph.plans import flows
from stepgraph.plans.engine import Engine
from stepgraph.streaming import fold
from stepgraph.streaming.shell import RunShell

SIGNAL = "kind string, run_id long, key long, prio string, node string, value string"


def signals(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SIGNAL)


def test_shell_batches_replays_and_ignored_signals(spark, tmp_path):
    shell = RunShell(spark, Engine(flows.review()), f"file://{tmp_path}/s")
    first = signals(spark, ("start", 1, 1, "p"), ("start", 1, 2, "q"), ("start", 2, 2, "p"), ("start", 3, None, "p"), ("start", None, 4, "p"), (None, 5, 5, "p"))
    assert shell.process(first, 0)
    state = lambda: {r.run_id: (r.status, r.applied) for r in shell.outputs().collect()}
    assert state() == {1: ("waiting", None), 2: ("waiting", None), 3: ("failed", None)}
    assert not shell.process(signals(spark, ("cancel", 1)), 0)
    assert state()[1] == ("waiting", None)
    assert shell.process(signals(spark, ("start", 1, 9, "z"), ("resolve", 1, None, None, "gate", "yes"), ("cancel", 2), ("cancel", 3)), 1)
    assert state() == {1: ("done", "did yes"), 2: ("cancelled", None), 3: ("failed", None)}
    assert shell.process(signals(spark), 2) and shell.process(signals(spark, ("resolve", 1, None, None, "gate", "no"), ("start", 2, 2, "p")), 3)
    assert state() == {1: ("done", "did yes"), 2: ("cancelled", None), 3: ("failed", None)}
    log = [(r.seq, r.type) for r in shell.events().filter("run_id = 1").orderBy("seq").collect()]
    assert [s for s, _ in log] == list(range(1, len(log) + 1))
    assert [t for _, t in log if t in ("interrupt_requested", "node_completed", "run_completed")] == ["interrupt_requested", "node_completed", "run_completed"]


def test_empty_first_batch(spark, tmp_path):
    shell = RunShell(spark, Engine(flows.review()), f"file://{tmp_path}/s")
    assert shell.process(signals(spark), 0) and shell.outputs().count() == 0 and shell.events().count() == 0


def test_folded_stream_over_batches_and_a_restart(spark, tmp_path):
    schema = "run_id string, seq long, type string, amount long"
    write = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    write("a", [("r", 1, "x", 1), ("r", 2, "y", None), ("q", 1, "z", 5), (None, 1, "z", 5), ("r", None, "z", 5)])

    def consume():
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        fold.sink(fold.folded(rows), f"{tmp_path}/out", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        return {r.run_id: (r.version, r.first_type, r.last_type, r.total, r.recent) for r in fold.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}

    assert consume() == {"r": (2, "x", "y", 1, "x,y"), "q": (1, "z", "z", 5, "z")}
    write("b", [("r", 2, "again", 9), ("r", 4, "d", 4), ("r", 3, "c", 3)])
    assert consume() == {"r": (4, "x", "d", 8, "y,c,d"), "q": (1, "z", "z", 5, "z")}
