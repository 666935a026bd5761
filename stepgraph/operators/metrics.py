"""Scorecard measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.snapshots import checkpoint


def cumulated(rows: DataFrame, keys: list[str], order: str, amount: str, name: str) -> DataFrame:
    """rows with the running sum of amount in their group, by order, which is distinct there.

    Rows are dealt out in ranges of (group, order), so a group of any size is spread over tasks; only one sum for
    each group and range meets in a window.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpoint(rows.repartitionByRange(n, *keys, order).withColumn("_range", F.spark_partition_id()))
    parts = cut.groupBy("_range", *keys).agg(F.sum(amount).alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    inside = F.sum(amount).over(Window.partitionBy("_range", *keys).orderBy(order))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("_range", *keys)]
    joined = cut.withColumn("_inside", inside).alias("a").join(parts.alias("b"), reduce(lambda x, y: x & y, same))
    return joined.select("a.*", (F.col("a._inside") + F.col("b._before")).alias(name)).drop("_range", "_inside")


def nearest_rank(values: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Element ceil(n p / 100) of each group, with least, most and count; ranks in whole numbers, so nothing rounds.

    Equal values are counted before anything is ranked.
    """
    counts = values.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    rows = cumulated(counts, keys, "_v", "_c", "_r").withColumn("_at", F.struct("_r", "_v"))
    n = rows.groupBy(*keys).agg(F.sum("_c").alias("n"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
    both = rows.alias("a").join(F.broadcast(n.alias("b")) if not keys else n.alias("b"), same)
    rank = lambda p: F.floor((F.col("n") * p + 99) / 100)
    at = [F.min(F.when(F.col("_r") >= rank(p), F.col("_at")))["_v"].alias(f"p{p}") for p in percents]
    return both.select("a.*", "b.n").groupBy(*keys).agg(F.max("n").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), *at)


def wait_ms(finished: Column, due: Column, start: Column) -> Column:
    """Whole milliseconds from the later of due and start to the end."""
    return F.floor((finished - F.greatest(due, start)) / 1000).cast("long")


def jain(values: DataFrame, value: str) -> DataFrame:
    """(sum x)^2 / (n sum x^2); 1 when all are zero, null of nothing."""
    s = values.agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count(value).alias("n"))
    index = F.when(F.col("n") == 0, None).when(F.col("q") == 0, 1.0).otherwise(F.col("s") * F.col("s") / (F.col("n") * F.col("q")))
    return s.select(F.round(index, 9).alias("jain"))


def peak(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The most intervals open at once; one that ends when another starts is closed first."""
    moves = intervals.select(*keys, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(
        intervals.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("d"))
    )
    net = moves.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    return cumulated(net, keys, "at", "d", "open").groupBy(*keys).agg(F.max("open").alias("peak"))


def recovery(samples: DataFrame, keys: list[str], at: str, backlog: str, threshold: int, run: int = 3) -> DataFrame:
    """The first sample from which run samples in a row are at most threshold; null if none."""
    ahead = Window.partitionBy(*keys).orderBy(at).rowsBetween(0, run - 1)
    good = (F.max(backlog).over(ahead) <= threshold) & (F.count(F.lit(1)).over(ahead) == run)
    return samples.withColumn("_good", good).groupBy(*keys).agg(F.min(F.when(F.col("_good"), F.col(at))).alias("recovered_at"))


def spread(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, median, cv): the coefficient of variation is 0 of fewer than two values or of a mean of 0."""
    mean = F.avg(value)
    cv = F.when((F.count(value) < 2) | (mean == 0), 0.0).otherwise(F.stddev_samp(value) / mean)
    return values.groupBy(*keys).agg(F.count(value).alias("n"), mean.alias("mean"), F.percentile(value, 0.5).alias("median"), cv.alias("cv"))


def expected(rows: DataFrame, rules: dict[str, tuple[Column, int | None]]) -> DataFrame:
    """(name, expected, actual, pass): how many rows meet each rule, exactly as many as expected."""
    one = rows.agg(*[F.count_if(rule).alias(name) for name, (rule, _) in rules.items()]).unpivot([], list(rules), "name", "actual")
    want = F.create_map(*[x for name, (_, n) in rules.items() for x in (F.lit(name), F.lit(n).cast("long"))])
    return one.withColumn("expected", want[F.col("name")]).withColumn("pass", F.col("actual") == F.col("expected"))


def last_seq(rows: DataFrame, column: str) -> DataFrame:
    """The highest sequence number, 0 of no rows."""
    return rows.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("last"))


def logical_bytes(rows: DataFrame) -> Column:
    """The bytes of a row as JSON."""
    return F.octet_length(F.to_json(F.struct(*rows.columns)))


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


# Scores of the scorecard, from 0 to 100


def throughput_score(rate: Column, target: float) -> Column:
    return F.round(100 * F.least(F.lit(1.0), rate / target))


def efficiency_score(low_rate: Column, high_rate: Column, low: int, high: int) -> Column:
    """Of the rate at the highest level of concurrency, the part that scaling from the lowest accounts for."""
    return F.round(100 * _unit(high_rate / low_rate / (high / low)))


def slowdown_score(control_p95: Column, mixed_p95: Column, good: float = 1.5, bad: float = 8.0) -> Column:
    return F.round(100 * _unit((bad - mixed_p95 / F.greatest(control_p95, F.lit(1))) / (bad - good)))


def recovery_score(ideal: Column, measured: Column) -> Column:
    """0 if it did not recover, which a null says."""
    return F.coalesce(F.round(100 * F.least(F.lit(1.0), ideal / measured)), F.lit(0.0))


def fairness_score(light_p95: Column, drain: Column) -> Column:
    return F.round(100 * _unit(1 - light_p95 / drain))


def stickiness_score(runs: Column, peak_wip: Column, concurrency: int) -> Column:
    return F.round(100 * _unit((runs - peak_wip) / (runs - concurrency)))
