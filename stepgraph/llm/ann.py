"""Approximate nearest neighbours by inner product: anisotropic product quantisation, four-bit scans, exact reranking.

Vectors are cut into subspaces of two dimensions with 16 codewords each (four bits).  Codewords and codes
minimise h |parallel residual|^2 + |orthogonal residual|^2 with h = (d - 1) T^2 / (1 - T^2) (Guo et al.,
2020), which keeps the error along the vector, the one that moves large inner products, small.  They are
fitted on a seeded sample of at most FIT_ROWS vectors; every vector is indexed.  A query builds a table of
16 partial products per subspace, scans the codes of a shard, and the best DEPTH rows of each shard are
scored again with the original vectors in double precision.  So is every other row whose approximate score and
error bound reach the k-th of these, so copies and ties past DEPTH are met and the results are exact.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without an id,
take no part; vectors are compared only with vectors of equal dimension; repeated rows are rows of their
own, a query skips every row of its own id; fewer candidates give fewer rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .vectors import SHARD, best, matrices, packed, search, unpack, usable

SUBSPACE = 2
CODES = 16
THRESHOLD = 0.2
#: Vectors the codebooks are fitted on, at most and for each dimension.
FIT_ROWS = 8_192
#: Rows of a shard that are scored exactly for each query, before those that their bound leaves in reach.
DEPTH = 256
#: Rows scored exactly at a time.
CHUNK = 4_096
SEED = 7


def split(rows: np.ndarray) -> np.ndarray:
    """n x m x SUBSPACE, padded with zeros."""
    n, d = rows.shape
    m = max(1, -(-d // SUBSPACE))
    out = np.zeros((n, m * SUBSPACE))
    out[:, :d] = rows
    return out.reshape(n, m, SUBSPACE)


def eta(d: int, threshold: float = THRESHOLD) -> float:
    """How much heavier the parallel residual weighs than the orthogonal one."""
    return max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))


def encode(rows: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes n x m by coordinate descent on the anisotropic loss, from the nearest codewords."""
    parts = split(rows)
    unit = parts / np.linalg.norm(rows, axis=1)[:, None, None]
    n, m, _ = parts.shape
    # squared residual and residual along the vector, for each codeword of each subspace
    square = np.empty((m, n, CODES), "f4")
    along = np.empty((m, n, CODES), "f4")
    for j in range(m):
        rest = parts[:, j, None, :] - books[j][None]
        square[j] = (rest * rest).sum(axis=2)
        along[j] = (rest * unit[:, j, None, :]).sum(axis=2)
    codes = square.argmin(axis=2).T.copy()
    each = np.arange(n)
    total = sum(along[j][each, codes[:, j]] for j in range(m))
    for _ in range(sweeps):
        for j in range(m):
            others = total - along[j][each, codes[:, j]]
            codes[:, j] = (square[j] + (weight - 1) * (others[:, None] + along[j]) ** 2).argmin(axis=1)
            total = others + along[j][each, codes[:, j]]
    return codes.astype("u1")


def fit(rows: np.ndarray, threshold: float = THRESHOLD, rounds: int = 6, seed: int = SEED) -> np.ndarray:
    """Codebooks m x CODES x SUBSPACE for the anisotropic loss."""
    parts = split(rows)
    n, m, _ = parts.shape
    draw = np.random.default_rng(seed)
    books = np.stack([parts[draw.choice(n, CODES, replace=n < CODES), j] for j in range(m)])
    unit = parts / np.linalg.norm(rows, axis=1)[:, None, None]
    weight = eta(rows.shape[1], threshold)
    for turn in range(rounds + 4):
        w = 1.0 if turn < 4 else weight  # plain k-means first
        codes = encode(rows, books, w, sweeps=0 if turn < 4 else 1)
        each = np.stack([books[j][codes[:, j]] for j in range(m)], axis=1)
        total = ((parts - each) * unit).sum(axis=(1, 2))
        for j in range(m):
            others = total - ((parts[:, j] - each[:, j]) * unit[:, j]).sum(axis=1)
            u = unit[:, j]
            aim = parts[:, j] + (w - 1) * u * (others + (u * parts[:, j]).sum(axis=1))[:, None]
            for c in range(CODES):
                at = codes[:, j] == c
                if not at.any():
                    continue
                left = at.sum() * np.eye(SUBSPACE) + (w - 1) * u[at].T @ u[at]
                books[j, c] = np.linalg.solve(left, aim[at].sum(axis=0))
            each[:, j] = books[j][codes[:, j]]
            total = others + ((parts[:, j] - each[:, j]) * u).sum(axis=1)
    return books


def sample(vectors: DataFrame, vector: str, key: str, rows: int, seed: int) -> dict[int, np.ndarray]:
    """For each dimension at most rows vectors, those of the smallest hashes of the id."""
    kept = vectors.select(F.size(vector).alias("dim"), F.xxhash64(F.lit(seed), key).alias("h"), F.col(key).alias("k"), vector)
    counts = {r["dim"]: r["n"] for r in kept.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per dimension
    out = {}
    for dim, n in counts.items():
        bar = int(rows * 1.2 / n * 2**64) - 2**63 if n > 1.2 * rows else None  # the hashes lie anywhere in 64 bits
        some = kept.filter(F.col("dim") == dim)
        if bar is not None:
            some = some.filter(F.col("h") <= bar)
        got = some.orderBy("h", "k", F.xxhash64(vector)).limit(rows).select("k", vector).toArrow().combine_chunks().to_batches()
        parts = [m for _, m in matrices(iter(got), rows)]
        if parts:
            out[dim] = np.concatenate(parts)
    return out


def index_of(vectors: DataFrame, books: dict[int, np.ndarray], vector: str, key: str, threshold: float, shard: int) -> DataFrame:
    """One row per shard: ids, the vectors and two four-bit codes to a byte."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                ids, rows = unpack(row["ids"], row["dim"], row["data"])
                own = books[row["dim"]]
                codes = np.concatenate([encode(rows[i : i + 2048], own, eta(row["dim"], threshold)) for i in range(0, len(rows), 2048)])
                if codes.shape[1] % 2:
                    codes = np.concatenate([codes, np.zeros((len(codes), 1), "u1")], axis=1)
                both = np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T)
                yield pa.RecordBatch.from_pydict({"n": [row["n"]], "ids": [row["ids"]], "dim": [row["dim"]], "data": [row["data"]], "codes": [both.tobytes()]})

    return packed(vectors, shard, vector, key).mapInArrow(run, "n long, ids binary, dim long, data binary, codes binary")


def residuals(data: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Lengths of what the codes (two to a byte, subspaces first) leave of each vector."""
    parts = split(data)
    square = np.zeros(len(data))
    for j in range(len(books)):
        own = codes[j // 2] >> 4 if j % 2 else codes[j // 2] & 15
        square += ((parts[:, j] - books[j][own]) ** 2).sum(axis=1)
    return np.sqrt(square)


def exactly(data: np.ndarray, query: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of the rows at, CHUNK at a time."""
    out = np.zeros(len(at))
    for first in range(0, len(at), CHUNK):
        near = data[at[first : first + CHUNK]]
        for x in range(near.shape[1]):  # always in the order of the dimensions
            out[first : first + CHUNK] += near[:, x] * query[x]
    return out


def scan(shard: dict, ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, depth: int) -> Iterator[tuple]:
    """The k best of a shard: approximate scores from tables, exact ones for the best depth rows, then for every row in reach.

    A row's exact score is at most its approximate one and the product of its residual's and the query's lengths.
    Rows for which this reaches the k-th exact score found so far are scored too, so none of the k best is missed.
    """
    vec, data = unpack(shard["ids"], shard["dim"], shard["data"])
    n = len(vec)
    codes = np.frombuffer(shard["codes"], "u1").reshape(-1, n)
    parts = split(queries)
    m = len(books)
    rest = residuals(data, codes, books)
    longest = np.linalg.norm(data, axis=1).max(initial=0) + rest.max(initial=0)
    rest = rest + (m + 4) * 2.0**-22 * longest  # rounding of the tables and their sums
    length = np.linalg.norm(queries, axis=1)
    for first in range(0, len(queries), 128):
        some = parts[first : first + 128]
        score = np.zeros((n, len(some)), "f4")
        for j in range(0, m, 2):  # a byte holds the codes of two subspaces: the two tables summed
            low = books[j] @ some[:, j].T
            high = books[j + 1] @ some[:, j + 1].T if j + 1 < m else np.zeros((CODES, len(some)))
            table = (high[:, None] + low[None]).reshape(CODES * CODES, -1).astype("f4")
            score += table[codes[j // 2]]
        score = np.ascontiguousarray(score.T)
        for i, row in enumerate(score):
            q = first + i
            other = vec != ids[q]
            at = np.argpartition(row, n - depth - 1)[n - depth - 1 :] if n > depth + 1 else np.arange(n)
            at = at[other[at]]
            exact = exactly(data, queries[q], at)
            if n > depth + 1:
                least = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
                reach = other & (row + rest * length[q] >= least)
                reach[at] = False
                more = np.flatnonzero(reach)
                at, exact = np.concatenate([at, more]), np.concatenate([exact, exactly(data, queries[q], more)])
            top = best(vec[at], exact, k)
            if len(top):
                yield q, vec[at][top], exact[top]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vector: str = "embedding",
    key: str = "vec_id",
    depth: int = DEPTH,
    threshold: float = THRESHOLD,
    fit_rows: int = FIT_ROWS,
    shard: int = SHARD,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, exactly scored."""
    clean = lambda df: df.filter(usable(vector, key) & F.exists(vector, lambda x: x != 0))
    books = {d: fit(rows, threshold, seed=seed) for d, rows in sample(clean(vectors), vector, key, fit_rows, seed).items()}
    index = checkpoint(index_of(clean(vectors), books, vector, key, threshold, shard))
    return search(index, clean(queries), lambda s, ids, rows: scan(s, ids, rows, books[s["dim"]], k, depth), k, "double", vector, key)


def op6_ann(spark, sf_dir):
    from .common import table

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)
