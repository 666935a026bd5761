"""What the two vector searches share: clean vectors, queries in bounded blocks, the merge of nearest lists.

A search runs over an index of packed rows, one row per shard of at most SHARD vectors and BYTES bytes.  Queries are
packed into blocks in the same way.  Shards and blocks are dealt by a shuffle into cells that hold a few of each, so
that every shard meets every block in one cell; nothing passes through the driver or is broadcast, and the index is
read once.  A cell hands on at most k rows a query, which are merged by a grouped top k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

#: Vectors in a shard of the index.
SHARD = 16_384
#: Queries in a block.
BLOCK = 2_048
#: Bytes of the vectors of a shard or block, at most; one vector may have more.
BYTES = 16 << 20
#: Shards and blocks in a cell, about, where there are enough of them to keep all cores busy.
IN_CELL = 4
FOUND = "_block long, _query long, query_id long, vec_id long, score {}"


def usable(vector: str = "embedding", key: str = "vec_id") -> Column:
    """An id and a vector that is not null and holds neither null nor non-finite components."""
    limit = F.lit(float("inf"))
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    return F.coalesce(F.col(key).isNotNull() & F.col(vector).isNotNull() & good, F.lit(False))


def matrices(frames: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, n x d doubles) of at most so many rows, and BYTES, of equal dimension."""
    held: dict[int, list] = {}
    limit = most

    def block(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])

    for frame in frames:
        ids = frame.column(0).to_numpy(zero_copy_only=False)
        column = frame.column(1)
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype("f8")
        sizes = np.diff(offsets)
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            matrix = values[offsets[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
            most = max(1, min(limit, BYTES // (8 * max(d, 1))))
            for i in range(0, len(at), most):
                rows = held.setdefault(d, [])
                rows.append((ids[at[i : i + most]], matrix[i : i + most]))
                if sum(len(r[0]) for r in rows) >= most:
                    all_ids, all_rows = block(rows)
                    yield all_ids[:most], all_rows[:most]
                    held[d] = [(all_ids[most:], all_rows[most:])]
    for rows in held.values():
        if rows and sum(len(r[0]) for r in rows):
            yield block(rows)


def packed(df: DataFrame, size: int, vector: str, key: str) -> DataFrame:
    """(n, ids, dim, data): at most size vectors to a row, as doubles, and a number of its own."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 33
        for ids, rows in matrices(frames, size):
            yield pa.RecordBatch.from_pydict(
                {"n": [n], "ids": [ids.astype("<i8").tobytes()], "dim": [rows.shape[1]], "data": [rows.astype("<f8").tobytes()]}
            )
            n += 1

    return df.select(F.col(key).cast("long"), vector).mapInArrow(run, "n long, ids binary, dim long, data binary")


def unpack(ids: bytes, dim: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(data, "<f8").reshape(len(ids), dim)


def cells(shards: int, blocks: int, cores: int) -> tuple[int, int]:
    """Into how many groups the shards and the blocks are dealt."""
    each = max(1, min(IN_CELL, int((shards * blocks / (4 * cores)) ** 0.5)))
    return max(1, -(-shards // each)), max(1, -(-blocks // each))


def search(index: DataFrame, queries: DataFrame, within: Callable, k: int, score: str, vector: str, key: str, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what within finds in each shard, ties to the smaller vec_id.

    index: rows of packed(), checkpointed, with whatever within needs.  within(shard row, query ids, query matrix)
    yields (position of the query, vec_ids, scores).
    """
    schema = FOUND.format(score)
    names = [c.split()[0] for c in schema.split(", ")]
    blocks = checkpoint(packed(queries, block, vector, key))
    g, h = cells(index.count(), blocks.count(), index.sparkSession.sparkContext.defaultParallelism)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        shards = left.to_pylist()
        for one in right.to_pylist():
            ids, rows = unpack(one["ids"], one["dim"], one["data"])
            got: dict[int, list] = {}
            for shard in shards:
                if shard["dim"] == one["dim"]:
                    for q, vecs, scores in within(shard, ids, rows):
                        got.setdefault(q, []).append((vecs, scores))
            for q, parts in got.items():
                vecs, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
                top = best(vecs, scores, k)
                out.append((np.full(len(top), one["n"]), np.full(len(top), q), np.full(len(top), ids[q]), vecs[top], scores[top]))
        if not out:
            empty = [np.zeros(0, "i8")] * 4 + [np.zeros(0, "f8" if score == "double" else "i8")]
            return pa.table([pa.array(c) for c in empty], names)
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    group = lambda n: F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("_g", group(g)).withColumn("_h", every(h)).groupBy("_g", "_h")
    right = blocks.withColumn("_h", group(h)).withColumn("_g", every(g)).groupBy("_g", "_h")
    found = left.cogroup(right).applyInArrow(run, schema)
    order = Window.partitionBy("_block", "_query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
