"""Exact top-k search by block-at-a-time pruning over quantised vectors.

A shard of the index holds blocks of BLOCK_ROWS vectors (close ones side by side), each with a forward
index (its integer rows) and, for every term (dimension), the largest and smallest weight in the block.
The sum over terms of the larger of weight times maximum and weight times minimum bounds every score in
the block.  A query visits blocks by falling bound, scores them through the forward index, and stops when
the next bound is below its kth score; an equal bound is still visited, as ties go to smaller ids.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take
no part; vectors are compared only with vectors of equal dimension; repeated rows are rows of their own,
a query skips every row of its own id, and a query row that repeats is answered as often; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns are not read.  Weights
are exact integers up to 2 ** 53 after scaling and scores must fit a long; larger ones raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .vectors import SHARD, best, packed, search, unpack, usable

SCALE = 256
BLOCK_ROWS = 32
#: Blocks scored between two looks at the bound.
STRIDE = 8


def quantise(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    whole = np.floor(rows * scale)
    if whole.size and np.abs(whole).max() >= 2.0**53:
        raise OverflowError("a component is too large to be an exact integer")
    return whole


def arrange(rows: np.ndarray) -> np.ndarray:
    """An order of the rows that puts near ones together: halves along the widest direction, down to a block."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK_ROWS:
            out.append(at)
            continue
        part = rows[at] - rows[at].mean(axis=0)
        axis = part[np.argmax((part * part).sum(axis=1))]
        for _ in range(2):  # power iteration towards the widest direction
            axis = part.T @ (part @ axis)
            axis = axis / (np.linalg.norm(axis) or 1.0)
        half = -(-len(at) // (2 * BLOCK_ROWS)) * BLOCK_ROWS
        order = np.argsort(part @ axis, kind="stable")
        todo += [at[order[half:]], at[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, "int64")


def block_index(vectors: DataFrame, vector: str, key: str, scale: int, shard: int) -> DataFrame:
    """One row per shard: ids, integer rows in block order and the block maxima and minima."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                ids, rows = unpack(row["ids"], row["dim"], row["data"])
                rows = quantise(rows, scale)
                order = arrange(rows)
                ids, rows = ids[order], rows[order]
                starts = np.arange(0, len(ids), BLOCK_ROWS)
                high, low = (f.reduceat(rows, starts, axis=0) if rows.size else np.zeros((len(starts), 0)) for f in (np.maximum, np.minimum))
                yield pa.RecordBatch.from_pydict(
                    {k: [v] for k, v in {"n": row["n"], "ids": ids.tobytes(), "dim": row["dim"], "data": rows.tobytes(), "high": high.tobytes(), "low": low.tobytes()}.items()}
                )

    return packed(vectors, shard, vector, key).mapInArrow(run, "n long, ids binary, dim long, data binary, high binary, low binary")


def prune(shard: dict, ids: np.ndarray, rows: np.ndarray, k: int, scale: int = SCALE, visits: list[int] | None = None) -> Iterator[tuple]:
    """The k best of a shard for each query, by block-at-a-time pruning.  visits gets the number of blocks that each query scored."""
    vec, data = unpack(shard["ids"], shard["dim"], shard["data"])
    queries = quantise(rows, scale)
    n, d = data.shape
    if not n:
        return
    most = (np.abs(queries).max(initial=0.0) * np.abs(data).max(initial=0.0)) * max(d, 1)
    if most >= 2.0**63:
        raise OverflowError("a score does not fit a long")
    if most >= 2.0**53:  # doubles would round: slower exact integers
        data, queries = data.astype("int64"), queries.astype("int64")
    blocks = -(-n // BLOCK_ROWS)
    high, low = (np.frombuffer(shard[x], "<f8").reshape(blocks, d).astype(data.dtype) for x in ("high", "low"))
    forward = np.zeros((blocks * BLOCK_ROWS, d), data.dtype)
    forward[:n] = data
    forward = forward.reshape(blocks, BLOCK_ROWS, d)
    names = np.full(blocks * BLOCK_ROWS, -1, "int64")
    names[:n] = vec
    real = np.zeros(blocks * BLOCK_ROWS, bool)
    real[:n] = True
    names, real = names.reshape(blocks, BLOCK_ROWS), real.reshape(blocks, BLOCK_ROWS)
    for q, query in enumerate(queries):
        bound = high @ np.maximum(query, 0) + low @ np.minimum(query, 0)
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        got_ids, got = np.zeros(0, "int64"), np.zeros(0, data.dtype)
        at = 0
        while at < blocks:
            kth = got[-1] if len(got) == k else None
            stop = min(at + STRIDE, blocks)
            if kth is not None:
                if bound[at] < kth:
                    break
                stop = at + max(1, int(np.searchsorted(-bound[at:stop], -kth, "right")))
            now = order[at:stop]
            mine = (real[now] & (names[now] != ids[q])).ravel()
            score = (forward[now].reshape(-1, d) @ query)[mine]
            all_ids, all_scores = np.concatenate([got_ids, names[now].ravel()[mine]]), np.concatenate([got, score])
            top = best(all_ids, all_scores, k)
            got_ids, got = all_ids[top], all_scores[top]
            at = stop
        if visits is not None:
            visits.append(at)
        if len(got):
            yield q, got_ids, got.astype("int64")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id", shard: int = SHARD
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale x), exactly."""
    index = checkpoint(block_index(vectors.filter(usable(vector, key)), vector, key, scale, shard))
    return search(index, queries.filter(usable(vector, key)), lambda s, ids, rows: prune(s, ids, rows, k, scale), k, "long", vector, key)


def op4_topk(spark, sf_dir):
    from .common import table

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)
