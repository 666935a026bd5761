"""SimHash near-duplicate groups with a bit-sliced comparison.

Fingerprints of word shingles are made once per document and compared once per distinct value.  Any
two fingerprints that differ in at most RADIUS bits agree on at least two of five bit ranges, so each is
listed under the ten pairs of ranges.  Within a list, bit planes are stored vertically: word j of plane p
holds bit p of 64 fingerprints, and the distances of all of them to their d-th next neighbour come out of
carry-save counters, 64 to a word.  Stretches in which every distance is past the radius are abandoned.
A list hands on only the edges of a spanning forest, so a group of n copies costs n - 1 edges.

Defined cases: null, empty and blank text have fingerprint 0 and link like any other; repeated rows each
get their row; a null id keeps its row and counts as no id when the smallest is sought (a group of null
ids only has a null component); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .bitslice import lanes_of, near, planes, positions
from .common import checkpoint, internal, lower_ascii
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: The five bit ranges of a fingerprint, as (shift, width).
RANGES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one list compared in one go; longer lists are compared part by part.
PART = 1 << 15
#: Shingles hashed at a time.
CHUNK = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a text whose A-Z are lower-cased already."""
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0
    words = data.split()  # of bytes, so at space and 0x09 to 0x0D only
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    joined = b" ".join(words)
    del words
    ones = np.zeros(64, "int64")
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), ends[at : min(n, at + CHUNK)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, _fp): the fingerprint of every document as a signed long."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = np.array([fingerprint(x.as_py()) for x in frame.column(1)], dtype="u8")
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(found.view("i8"))], [key, "_fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, lower_ascii(F.col(text)).alias("_text")).mapInArrow(run, f"`{key}` {kind}, _fp long")


def forest(lists: np.ndarray, values: np.ndarray, radius: int = RADIUS, cross: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of the links within each list; equal lists must stand together.

    cross: if over 0, only links from the first cross positions to later ones are sought.
    """
    n = len(values)
    plane = planes(values)
    plane = np.concatenate([plane, np.zeros((64, 1), "u8")], axis=1)
    ends = np.flatnonzero(np.append(lists[1:] != lists[:-1], True)) + 1
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)  # members from here to the end of the list
    if cross:
        left[cross:] = 0
    root = np.arange(n)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    words = plane.shape[1] - 1
    for d in range(1, int(left.max(initial=1))):
        lanes = np.flatnonzero(left > d)
        i = positions(near(plane, lanes_of(lanes[lanes >= cross - d] if cross else lanes, words), d, radius))
        if not len(i):
            continue
        j = i + d
        while True:  # hook larger roots on smaller ones until nothing is left to join
            a, z = root[i], root[j]
            apart = a != z
            if not apart.any():
                break
            i, j, a, z = i[apart], j[apart], a[apart], z[apart]
            high, low = np.maximum(a, z), np.minimum(a, z)
            _, first = np.unique(high, return_index=True)
            edges.append((high[first], low[first]))
            root[high[first]] = low[first]
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    if not edges:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])


def _lists(frames: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole lists, or of lists cut after each multiple of most, from rows sorted by list."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for frame in frames:
        held.append((frame.column(0).to_numpy(zero_copy_only=False), frame.column(1).to_numpy(zero_copy_only=False)))
        size += frame.num_rows
        if size < most:
            continue
        lists, values = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        cut = int(np.searchsorted(lists, lists[-1], "left"))
        if cut:
            yield lists[:cut], values[:cut]
        held, size = [(lists[cut:], values[cut:])], len(lists) - cut
    if held:
        yield tuple(np.concatenate([h[k] for h in held]) for k in (0, 1))


def links(prints: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints _fp of prints as all links within the radius do.

    Lists of more than part members are cut into parts; every pair of parts is compared as a list of its own.
    """
    unsigned = [F.shiftrightunsigned("_fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in RANGES]
    listed = prints.select(
        "_fp",
        F.explode(
            F.array(
                *[
                    F.lit(k << 32) + F.shiftleft(unsigned[i], 13) + unsigned[j]
                    for k, (i, j) in enumerate(combinations(range(5), 2))
                ]
            )
        ).alias("_list"),
    )
    # Lists of one member hold no link; lists over part members are told apart by the counts.
    counts = listed.groupBy("_list").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    some = listed.join(counts, "_list")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists, values in _lists(frames, part):
            if len(lists) < 2:
                continue
            a, b = forest(lists, values.view("u8"), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], ["a", "b"])

    short = some.filter(F.col("_n") <= part).select("_list", "_fp")
    near_short = short.repartition("_list").sortWithinPartitions("_list").mapInArrow(run, "a long, b long")

    # A long list: member x lies in part hash(x) mod m; the pair (p, q) of parts, p <= q, is a task of its own.
    m = F.ceil(F.col("_n") * 2 / part).cast("int")
    pairs = (
        some.filter(F.col("_n") > part)
        .withColumn("_m", m)
        .withColumn("_p", F.pmod(F.xxhash64("_fp", "_list"), F.col("_m")).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .select("_list", F.least("_p", "_q").alias("_x"), F.greatest("_p", "_q").alias("_y"), "_fp")
        .select(F.xxhash64("_list", "_x", "_y").alias("_list"), "_fp")
    )
    near_long = pairs.repartition("_list").sortWithinPartitions("_list").mapInArrow(run, "a long, b long")
    return near_short.unionByName(near_long)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for every row of docs."""
    prints = checkpoint(fingerprints(docs, text, key))
    unique = checkpoint(prints.groupBy("_fp").agg(F.min(key).alias("_rep")))
    nodes = components(links(unique, radius))
    grouped = unique.join(nodes.withColumnRenamed("node", "_fp"), "_fp")
    least = grouped.groupBy("root").agg(F.min("_rep").alias("_least"))
    linked = grouped.join(least, "root").select("_fp", "_least")
    named = checkpoint(unique.join(linked, "_fp", "left").select("_fp", F.coalesce("_least", "_rep").alias("component_id")))
    return prints.join(named, "_fp").select(
        F.col(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, width: int = similar.SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of the smallest id (null ids last), of equal ids one.

    Two rows are linked if the sets of shingles of width words of their texts (A-Z lower-cased) have a Jaccard
    similarity of 0.8 or more; texts without a word are one group, texts of fewer words are one shingle.  A radius
    that is exact for bit ranges, as near_duplicates has, would miss most of these, so fingerprints of 128 bits are
    compared at a wide radius within the lists of similar.links, and what they let through is compared as sets.
    Rows are numbered in a checkpoint first, so docs may be any plan, whatever order its rows come in.
    """
    uid = internal(docs, "_row")
    rows = checkpoint(docs.withColumn(uid, F.monotonically_increasing_id()))
    one = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(uid).alias("u")).alias("_one")
    texts = rows.select(F.col(uid).alias("_id"), one, lower_ascii(F.col(text)).alias("_text"))
    found = checkpoint(similar.digests(texts, width))
    least = checkpoint(found.groupBy("_digest").agg(F.min("_one").alias("_one")).select("_one", F.col("_one.u").alias("_id")))
    copies = checkpoint(found.select(F.col("_one.u").alias("_id")).join(least, "_id", "left_anti"))
    unique = similar.without(texts.select("_id", "_text"), copies, "_id")
    nodes = checkpoint(components(similar.links(unique, least.count(), width)))
    grouped = nodes.withColumnRenamed("node", "_id").join(least, "_id")
    heads = grouped.groupBy("root").agg(F.min("_one").alias("_one")).select(F.col("_one.u").alias("_id"))
    gone = checkpoint(copies.unionByName(grouped.select("_id").join(heads, "_id", "left_anti")))
    whole = rows.select(F.col(uid).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return similar.without(whole, gone, "_id").select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op8_simhash(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
