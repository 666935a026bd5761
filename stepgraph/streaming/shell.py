"""Runs advanced by a stream of signals: each micro-batch is one fenced commit of the store.

A signal starts a run, answers an interrupt or cancels.  Batch n commits as version n + 1 and is skipped when that
version exists, so a batch replayed after a failure changes nothing.  Live runs (running or waiting) are written
anew by every commit, without the events that were written before; finished runs and events are only appended.  A commit's cost follows the live runs; one that
starts runs also looks their ids up among those of all finished runs, of which it reads the one column.  Within a batch a run starts first, then its answers count, then it is cancelled.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.engine import Engine
from ..plugins import Observer, Store, tell
from ..sources.snapshots import SnapshotStore, checkpoint

OVER = ("done", "failed", "cancelled")


class RunShell:
    """signals: kind (start, resolve or cancel), run_id, node, value, and one column for each input of the graph.

    Null or unknown kinds and null run ids are ignored.  Of rival starts of one run the least by its inputs counts;
    a start of a run that exists is ignored.
    """

    def __init__(self, spark: SparkSession, engine: Engine, base: str, store: Store | None = None, observers: Iterable[Observer] = ()) -> None:
        """observers are told the version and the number of live runs and of signals after each commit."""
        self.spark, self.engine, self.store, self.observers = spark, engine, store or SnapshotStore(spark, base), list(observers)

    def _started(self, signals: DataFrame, known: DataFrame | None, now: int) -> DataFrame:
        inputs = sorted(self.engine.graph.inputs)
        rows = signals.filter("kind = 'start' and run_id is not null")
        rows = rows.groupBy("run_id").agg(F.min(F.struct(*inputs)).alias("i")).select("run_id", "i.*")
        if known is not None:
            rows = rows.join(known, "run_id", "left_anti")
        return self.engine.start(rows, "run_id").withColumns({"started_at": F.lit(now), "updated_at": F.lit(now)})

    def process(self, signals: DataFrame, batch: int) -> bool:
        """Applies one batch; False if it was applied before."""
        now = time.time_ns() // 1000
        if self.store.current() > batch:
            return False
        signals = checkpoint(signals)
        first = self.store.current() == 0
        live = None if first else self.store.read("live")
        known = None if first else self._known(live, signals)
        rows = self._started(signals, known, now)
        if live is not None:
            rows = rows.unionByName(live)
        rows = self.engine.run(rows)
        answers = signals.filter("kind = 'resolve' and run_id is not null").select("run_id", "node", "value")
        rows = self.engine.run(self.engine.resolve(rows, answers))
        gone = signals.filter("kind = 'cancel'").select("run_id", F.lit(True).alias("_gone")).distinct()
        rows = rows.join(gone, "run_id", "left")
        rows = checkpoint(self.engine.cancel(rows, F.coalesce("_gone", F.lit(False))).drop("_gone"))
        over = F.col("status").isin(*OVER)
        log = self.engine.log(rows)
        moved = (F.size("trace") > 0) | over
        rows = self.engine.flushed(rows.withColumn("updated_at", F.when(moved, F.lit(now)).otherwise(F.col("updated_at"))))
        self.store.commit({"live": rows.filter(~over), "finished": rows.filter(over), "events": log}, batch)
        if self.observers:
            tell(self.observers, batch + 1, {"signals": signals.count(), "live": self.store.read("live").count()})
        return True

    def _known(self, live: DataFrame, signals: DataFrame) -> DataFrame:
        """Those of the runs that a batch starts that exist already; nothing of the history is read if it starts none."""
        new = checkpoint(signals.filter("kind = 'start' and run_id is not null").select("run_id").distinct())
        if new.isEmpty():
            return new
        return live.select("run_id").unionByName(self.store.appended("finished").select("run_id")).join(new, "run_id", "left_semi")

    def runs(self) -> DataFrame:
        """The state of every run, live or finished."""
        return self.store.read("live").unionByName(self.store.appended("finished"))

    def outputs(self) -> DataFrame:
        return self.engine.outputs(self.runs())

    def events(self) -> DataFrame:
        return self.store.appended("events")

    def writer(self, stream: DataFrame, checkpoint_dir: str) -> DataStreamWriter:
        """Start it with .trigger(...).start(); the batch number comes from the query's own checkpoint."""
        return stream.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(lambda rows, batch: self.process(rows, batch) and None)
