"""Reachability over many graphs at once: small graphs whole, each within a task, large ones by iterated joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshots import checkpoint

#: Rounds after which the parts found are merged; rounds of trimming before cycles are looked for.
MERGE, TRIMS = 8, 3
#: Edges of a graph that a task holds at most; and rows that it gives at once.
SMALL, ROWS = 20_000, 20_000


def reachable(edges: DataFrame, start: DataFrame, barriers: bool = False) -> DataFrame:
    """(graph, node) reachable from start (graph, node) along edges (graph, edge, source, target); repeated rows count once.

    barriers: an edge of several sources counts once all of them are reached, as a fan-in does.  Graphs of at most SMALL
    edges, or more rows if some are repeated, are dealt out whole, in one shuffle; only larger ones go round by round.
    Nulls match nothing; of a fan-in only the sources that are not null must be reached.
    """
    edges = edges.select("graph", "edge", "source", "target").dropna(subset=["graph", "edge"] if barriers else ["graph", "source"])
    start = start.select("graph", "node")
    kinds = [f.dataType for f in edges.schema.fields] + [start.schema["node"].dataType]
    if not all(isinstance(k, (T.IntegralType, T.StringType)) for k in kinds):
        return _rounds(edges, start, barriers)
    large = checkpoint(edges.groupBy("graph").count().filter(F.col("count") > SMALL).select("graph"))
    if large.isEmpty():
        return _within(edges, start, barriers)
    large = F.broadcast(large)  # at most one for SMALL edges
    part = lambda df, how: df.join(large, "graph", how)
    small = _within(part(edges, "left_anti"), part(start, "left_anti"), barriers)
    return small.unionByName(_rounds(part(edges, "left_semi"), part(start, "left_semi"), barriers))


def _reached(edges: list[tuple], start: set, barriers: bool) -> set:
    """start and what it reaches along (edge, source, target)."""
    needs: dict = {}  # by edge, the sources that are not reached yet, and the targets
    for edge, source, target in edges:
        sources, targets = needs.setdefault(edge if barriers else source, (set(), set()))
        if source is not None:
            sources.add(source)
        if target is not None:
            targets.add(target)
    out: dict = {}
    for sources, targets in needs.values():
        for source in sources:
            out.setdefault(source, []).append((sources, targets))
    seen, todo = set(start), list(start)
    while todo:
        node = todo.pop()
        for sources, targets in out.get(node, ()):
            sources.discard(node)
            if not sources:
                todo += targets - seen
                seen |= targets
    return seen


def _within(edges: DataFrame, start: DataFrame, barriers: bool) -> DataFrame:
    """reachable for graphs whose edges fit into a task.  A graph's edges come before its start nodes, which pass through."""
    ends = edges.select("graph", F.lit(0).alias("kind"), "edge", "source", "target")
    begins = start.select("graph", F.lit(1).alias("kind"), F.lit(None).cast(edges.schema["edge"].dataType).alias("edge"), F.col("node").alias("source"), F.col("node").alias("target"))
    rows = ends.unionByName(begins)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("graph", kinds["graph"]), T.StructField("node", kinds["target"])])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []
        held: tuple[list, list] = ([], [])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, types, strict=True)], ["graph", "node"])
            held[0].clear()
            held[1].clear()
            return batch

        now, lines, nodes, begun, before = None, [], None, set(), (None, None)
        for frame in frames:
            types = [frame.schema.field("graph").type, frame.schema.field("target").type]
            for graph, kind, edge, source, target in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if graph != now:
                    more = _reached(lines, begun, barriers) - begun if begun else ()
                    held[0].extend([now] * len(more))
                    held[1].extend(more)
                    now, lines, nodes, begun, before = graph, [], None, set(), (None, None)
                if kind == 0:
                    lines.append((edge, source, target))
                    continue
                if nodes is None:
                    nodes = {x for line in lines for x in line[1:] if x is not None}
                if before != (kind, source):  # start nodes come in order
                    held[0].append(graph)
                    held[1].append(source)
                    if source in nodes:  # no more of them than edges hold
                        begun.add(source)
                before = (kind, source)
                if len(held[0]) >= ROWS:
                    yield flush()
            if len(held[0]) >= ROWS:
                yield flush()
        more = _reached(lines, begun, barriers) - begun if begun else ()
        held[0].extend([now] * len(more))
        held[1].extend(more)
        if held[0]:
            yield flush()

    return rows.repartition("graph").sortWithinPartitions("graph", "kind", "source").mapInArrow(run, schema)


def _rounds(edges: DataFrame, start: DataFrame, barriers: bool) -> DataFrame:
    """reachable by joins.  What a round finds is written once and joined to what was found before; every MERGE rounds the parts are written as one."""
    edges = checkpoint(edges.distinct())
    need = edges.groupBy("graph", "edge").agg(F.count_distinct("source").alias("n"))
    seen = latest = checkpoint(start.distinct())
    rounds = 0
    while True:
        rounds += 1
        if barriers:
            met = edges.join(seen.withColumnRenamed("node", "source"), ["graph", "source"])
            met = met.groupBy("graph", "edge").agg(F.count_distinct("source").alias("m")).join(need, ["graph", "edge"])
            met = edges.join(met.filter("m = n").select("graph", "edge"), ["graph", "edge"], "left_semi")
        else:
            met = edges.join(latest.withColumnRenamed("node", "source"), ["graph", "source"])
        found = met.select("graph", F.col("target").alias("node")).dropna(subset=["node"]).distinct()
        latest = checkpoint(found.join(seen, ["graph", "node"], "left_anti"))
        if latest.isEmpty():
            return seen
        seen = seen.unionByName(latest)
        if rounds % MERGE == 0:
            seen = checkpoint(seen)


def closure(edges: DataFrame) -> DataFrame:
    """(graph, a, b): b can be reached from a by one edge or more, by path doubling."""
    paths = checkpoint(edges.select("graph", F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    size = paths.count()
    while True:
        on = paths.select("graph", F.col("a").alias("b"), F.col("b").alias("c"))
        wider = checkpoint(paths.unionByName(paths.join(on, ["graph", "b"]).select("graph", "a", F.col("c").alias("b"))).distinct())
        now = wider.count()
        if now == size:
            return wider
        paths, size = wider, now


def trimmed(edges: DataFrame, rounds: int = TRIMS) -> DataFrame:
    """edges without those that start where none ends or end where none starts, again and again: they lie on no cycle."""
    now = checkpoint(edges.select("graph", "source", "target").distinct())
    for _ in range(rounds):
        ended = now.select("graph", F.col("target").alias("source")).distinct()
        begun = now.select("graph", F.col("source").alias("target")).distinct()
        now = checkpoint(now.join(ended, ["graph", "source"], "left_semi").join(begun, ["graph", "target"], "left_semi"))
        if now.isEmpty():
            break
    return now


def cyclic(edges: DataFrame) -> DataFrame:
    """(graph, node) on a cycle, self-loops included.  Only what trimming leaves is closed, and paths stay in their graph."""
    return closure(trimmed(edges)).filter("a = b").select("graph", F.col("a").alias("node"))


def dead_ends(edges: DataFrame, finish: DataFrame) -> DataFrame:
    """(graph, node) from which no finish node can be reached."""
    back = edges.select("graph", "edge", F.col("target").alias("source"), F.col("source").alias("target"))
    nodes = edges.select("graph", F.col("source").alias("node")).unionByName(edges.select("graph", F.col("target").alias("node"))).distinct()
    return nodes.join(reachable(back, finish), ["graph", "node"], "left_anti")
