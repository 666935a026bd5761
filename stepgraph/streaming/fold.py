"""State of runs folded from a stream of writes, one key at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "version long, first_type string, last_type string, total long, recent string"
OUTPUT = f"run_id string, seq long, {STATE}"
RECENT = 3


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else (0, -1, None, None, 0, "")
    rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable").drop_duplicates("seq")
    rows = rows[rows["seq"] > held[1]]  # what was folded before was delivered again
    if len(rows):
        version, _, first, _, total, recent = held
        types = rows["type"].tolist()
        recent = [*filter(None, recent.split(",")), *types][-RECENT:]
        held = (version + len(rows), int(rows["seq"].iloc[-1]), types[0] if version == 0 else first, types[-1], total + int(rows["amount"].sum()), ",".join(recent))
        state.update(held)
    version, seq, first, last, total, recent = held
    yield pd.DataFrame([(key[0], seq, version, first, last, total, recent)], columns=["run_id", "seq", "version", "first_type", "last_type", "total", "recent"])


def folded(writes: DataFrame) -> DataFrame:
    """(run_id, seq, type, amount) folded by first, last, sum and a window of the last three, in update mode.

    A run's writes must reach the stream in the order of seq from batch to batch; one at or before the run's
    last is a repeated delivery and is left out.  State holds a few numbers for each run, whatever its length.
    """
    rows = writes.filter("run_id is not null and seq is not null").select("run_id", "seq", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("amount", F.lit(0)).alias("amount"))
    state = "version long, seq long, first_type string, last_type string, total long, recent string"
    return rows.groupBy("run_id").applyInPandasWithState(_advance, OUTPUT, state, "update", GroupStateTimeout.NoTimeout)


def sink(stream: DataFrame, path: str, checkpoint_dir: str):
    """Every batch in a folder of its own number, written anew when the batch is: a replay leaves no second copy."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir).foreachBatch(write)


def latest(written: DataFrame) -> DataFrame:
    """The newest state of each run from what sink() wrote."""
    fields = [c for c in written.columns if c not in ("run_id", "batch", "version")]
    return written.groupBy("run_id").agg(F.max_by(F.struct("version", *fields), "version").alias("s")).select("run_id", "s.*")
