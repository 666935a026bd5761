"""Links between texts whose sets of word shingles have a Jaccard similarity of 4/5 or more, and no others.

Every text is listed under the first shingles of its set (see shingles.prefixes), so two that are alike share a
list whatever the order of the shingles; the order puts those that a bounded sample holds often last, which
changes the cost only.  Within a list, SimHash fingerprints of the sets are compared bit-sliced (bitslice.py),
and pairs within the radius whose sizes and positions allow it are compared with whole sets.  The radius lies
8 standard deviations beyond the distance that sets of similarity 4/5 have on average (6 for sets of under ten
shingles), so it spares the comparison of whole texts and loses a link with a probability under 1e-8.

Lists are dealt out by ranges of their members, so one that many texts share is spread over tasks.  What a range
may hold only a part of, and lists of over PART members, are dealt out again as pairs of parts: the members of
the list's largest group against parts of the others, so that a group already known to be connected is not
compared with itself.  Groups of near copies are connected beforehand: among texts that share one of FIRST minima
of their sets, each is compared with its neighbour and with the one in the middle of them all, which are two
comparisons for each listing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitslice
from .common import checkpoint, lean, shuffle_partitions
from .components import components
from .shingles import DOWN, SHINGLE, UP, alike, groups, minima, prefixes, sketches

#: Bits of a fingerprint, over 64, and how many may differ.
COLUMNS, RADIUS = 2, 52
#: Minima of a set under which a text is listed beforehand.
FIRST = 4
#: Texts in the sample that orders the shingles, about; shingles it can put last; least texts of the sample that hold one.
SAMPLE, HEAVY, OFTEN = 2_000, 200_000, 3
#: Bits of the filter that spares most rows a shuffle.
BITS = 1 << 24
#: Ids that are broadcast at most; partners that a text is sent to in one go, about.
FEW, AT_ONCE = 100_000, 256
#: Members of lists that are compared in one go.
PART = 1 << 15
LISTS = "s long, _id long, _root long, n int, at int, x long, y long"
NAMES = [c.split()[0] for c in LISTS.split(", ")]
FOUND = f"kind int, {LISTS}"


def maybe(rows: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a column name that is true for every row whose key is in ids, and for few others while ids are few.

    It is read from a filter of BITS bits, which is all that is broadcast, however many ids there are.
    """
    spot = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BITS))
    spots = ids.select(F.explode(F.array(spot(1), spot(2))).alias("p"))
    words = checkpoint(spots.groupBy(F.shiftright("p", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_b")))
    hit = F.lit(True)
    for n, seed in enumerate((1, 2)):
        word = F.broadcast(words.select(F.col("_w").alias(f"_w{n}"), F.col("_b").alias(f"_b{n}")))  # at most BITS / 64 rows
        rows = rows.join(word, F.shiftright(spot(seed), 6) == F.col(f"_w{n}"), "left")
        hit = hit & F.coalesce(F.call_function("getbit", F.col(f"_b{n}"), spot(seed).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return rows.withColumn(name, hit).drop("_w0", "_b0", "_w1", "_b1")


def _sent(ids: DataFrame) -> DataFrame:
    """ids, checkpointed, marked for broadcast if they are few; else the join shuffles."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _wrong(marked: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The keys that the filter let through though they are not in ids: few while ids are few, so that no text need be shuffled."""
    return _sent(marked.filter("_hit").select(key).join(ids, key, "left_anti"))


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    marked = maybe(rows, ids, key, "_hit")
    return marked.filter("_hit").join(_wrong(marked, ids, key), key, "left_anti").drop("_hit")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    marked = maybe(rows, ids, key, "_hit")
    return marked.filter("not _hit").unionByName(marked.filter("_hit").join(_wrong(marked, ids, key), key, "left_semi")).drop("_hit")


def digests(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(_one, _digest): the digest of the set of each row of texts (_one, _text)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for frame in frames:
            found = [
                xxhash.xxh128_digest(hashes[offsets[i] : offsets[i + 1]].tobytes())
                for _, hashes, offsets in groups(frame.column(1).to_pylist(), width)
                for i in range(len(offsets) - 1)
            ]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(found, pa.binary())], ["_one", "_digest"])

    return texts.select("_one", "_text").mapInArrow(run, f"_one {texts.schema['_one'].dataType.simpleString()}, _digest binary")


def _heavy(texts: DataFrame, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample hold, sorted, and in how many; HEAVY at most."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for _, hashes, _ in groups(frame.column(0).to_pylist(), width):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view("i8"))], ["s"])

    some = texts.filter(F.pmod(F.xxhash64("_id"), F.lit(max(1, -(-rows // SAMPLE)))) == 0).select("_text")
    counts = some.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    got = counts.orderBy(F.desc("n"), "s").limit(HEAVY).toArrow()
    heavy, n = got.column(0).to_numpy().view("u8"), got.column(1).to_numpy()
    order = np.argsort(heavy)
    return heavy[order], n[order]


def _listed(texts: DataFrame, keys: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """LISTS: each text (_id, _root, _text) under its keys, by set, key and position, with its fingerprint."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            key, root = (frame.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for which, hashes, offsets in groups(frame.column(2).to_pylist(), width):
                own, s, at = keys(hashes, offsets)
                prints = sketches(hashes, offsets, COLUMNS).view("i8")
                columns = [s.view("i8"), key[which][own], root[which][own], np.diff(offsets)[own].astype("i4"), at.astype("i4"), *prints[own].T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES)

    return texts.select("_id", "_root", "_text").mapInArrow(lean(run), LISTS)


def by_prefix(texts: DataFrame, most: tuple, width: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(most)  # at most HEAVY shingles
    return _listed(texts, lambda hashes, offsets: prefixes(hashes, offsets, *sent.value), width)


def by_minima(texts: DataFrame, width: int) -> DataFrame:
    def keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, s = minima(hashes, offsets, FIRST)
        return own, s, np.zeros(len(own), "i4")

    return _listed(texts, keys, width)


def near_pairs(s: np.ndarray, ids: np.ndarray, roots: np.ndarray, n: np.ndarray, at: np.ndarray, prints: np.ndarray, reach: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of one list, of different roots, that may be alike; rows are sorted by list and n.

    reach: only neighbours up to so far, whatever their sizes' order.
    """
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    several = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
    kept = np.repeat(several, np.diff(starts, append=len(s)))  # a list of one group holds no pair
    if not kept.any():
        return
    s, ids, roots, n, at, prints = s[kept], ids[kept], roots[kept], n[kept].astype("i8"), at[kept].astype("i8"), prints[kept]
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True)) + 1
    end = np.repeat(ends, np.diff(ends, prepend=0))
    plane = bitslice.planes(prints.view("u8"))
    words = plane.shape[1] - 1
    plane = np.concatenate([plane, np.zeros((len(plane), 1), "u8")], axis=1)
    live, d = np.arange(len(s)), 0
    while reach is None or d < reach:
        d += 1
        live = live[live + d < end[live]]
        size, larger = np.minimum(n[live], n[live + d]), np.maximum(n[live], n[live + d])
        lanes = live[larger * UP <= size * DOWN]
        if reach is None:  # sizes only grow from here on
            live = lanes
        if not len(live):
            return
        other = lanes + d
        # In the list of the first shingle that both hold, neither holds another of theirs before it; a pair may fail in later lists.
        held = np.minimum(n[lanes] - at[lanes], n[other] - at[other])
        lanes = lanes[(roots[lanes] != roots[other]) & ((UP + DOWN) * held >= UP * (n[lanes] + n[other]))]
        if len(lanes):
            i = bitslice.positions(bitslice.near_wide(plane, bitslice.lanes_of(lanes, words), d, RADIUS))
            if len(i):
                yield np.minimum(ids[i], ids[i + d]), np.maximum(ids[i], ids[i + d])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    zero = pa.array(np.zeros(len(a), "i8"))
    small = pa.array(np.zeros(len(a), "i4"))
    return pa.RecordBatch.from_arrays([small, pa.array(a), pa.array(b), zero, small, small, zero, zero], ["kind", *NAMES])


def _again(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(columns[0]), "i4")), *map(pa.array, columns)], ["kind", *NAMES])


def compared(lists: DataFrame, whole: bool = False) -> DataFrame:
    """FOUND of LISTS sorted by list and size: rows of kind 0 have a pair in s and _id; of kind 1 are members to deal out again.

    whole: whether a partition holds whole lists.  If not, its first and last list are dealt out again.
    """

    def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        made = list(near_pairs(*columns[:5], np.stack(columns[5:], axis=1))) if len(columns[0]) > 1 else []
        if made:
            a, b = (np.concatenate(x) for x in zip(*made, strict=True))
            both = np.unique(np.stack([a, b], axis=1), axis=0)
            yield _pairs(both[:, 0], both[:, 1])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        begun, back = False, None  # back: the list that is handed back just now
        for frame in frames:
            now = [c.to_numpy(zero_copy_only=False) for c in frame.columns]
            if len(now[0]) and not begun:
                begun, back = True, None if whole else now[0][0]
            if back is not None:
                cut = int(np.searchsorted(now[0], back, "right"))
                if cut:
                    yield _again([c[:cut] for c in now])
                now = [c[cut:] for c in now]
                back = None if len(now[0]) else back
            held.append(now)
            if sum(len(h[0]) for h in held) < PART:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
            yield from out([c[:cut] for c in columns])
            held = [[c[cut:] for c in columns]]
            if len(columns[0]) - cut >= PART and not whole:
                yield _again(held[0])
                held, back = [], columns[0][-1]
        if sum(len(h[0]) for h in held):
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = len(columns[0]) if whole else int(np.searchsorted(columns[0], columns[0][-1], "left"))
            yield from out([c[:last] for c in columns])
            if not whole:
                yield _again([c[last:] for c in columns])

    return lists.mapInArrow(lean(run), FOUND)


def candidates(lists: DataFrame) -> DataFrame:
    """(a, b): every pair of members of one list, of different roots, that may be alike."""
    ranges = lists.repartitionByRange(shuffle_partitions(lists.sparkSession), "s", "n", "_id").sortWithinPartitions("s", "n", "_id")
    found = checkpoint(compared(ranges))
    rows = found.filter("kind = 1").drop("kind")
    # The largest group of each of these lists, and how many parts its members and the others make.
    own = rows.groupBy("s", "_root").agg(F.count(F.lit(1)).alias("c"))
    top = own.groupBy("s").agg(F.max_by("_root", F.struct("c", "_root")).alias("_top"), F.max("c").alias("c"), F.sum("c").alias("_all")).filter("_all > c")
    parts = lambda c: F.ceil(c * 2 / PART).cast("int")
    top = top.select("s", "_top", parts(F.col("c")).alias("_g"), parts(F.col("_all") - F.col("c")).alias("_r"))
    dealt = rows.join(top, "s").withColumn("_p", F.pmod(F.xxhash64("_id", "s"), F.when(F.col("_root") == F.col("_top"), F.col("_g")).otherwise(F.col("_r"))))
    ours, theirs = F.sequence(F.lit(0), F.col("_g") - 1), F.sequence(F.lit(0), F.col("_r") - 1)
    cell = lambda kind, p, q: F.struct(F.lit(kind).alias("k"), p.cast("long").alias("p"), q.cast("long").alias("q"))
    mine = F.col("_p")
    cells = F.when(F.col("_root") == F.col("_top"), F.transform(theirs, lambda q: cell(0, mine, q))).otherwise(
        F.concat(F.transform(ours, lambda p: cell(0, p, mine)), F.transform(theirs, lambda q: cell(1, F.least(mine, q), F.greatest(mine, q))))
    )
    spread = dealt.withColumn("c", F.explode(cells)).withColumn("s", F.xxhash64("s", "c")).select(*NAMES)
    more = compared(spread.repartition("s").sortWithinPartitions("s", "n", "_id"), whole=True)
    pair = [F.col("s").alias("a"), F.col("_id").alias("b")]
    return found.filter("kind = 0").select(*pair).unionByName(more.select(*pair)).distinct()


def stars(s: np.ndarray, ids: np.ndarray, n: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the member of each list whose fingerprint is nearest to what most members have, and the members that may be like it."""
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    size = np.diff(starts, append=len(s))
    own = np.repeat(np.arange(len(starts)), size)
    words = np.ascontiguousarray(prints).view("u8")
    ones = np.add.reduceat(np.unpackbits(words.view("u1").reshape(len(s), -1), axis=1, bitorder="little"), starts, axis=0, dtype="int32")
    middle = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8")
    away = np.bitwise_count(words ^ middle[own]).sum(axis=1, dtype="int64")
    head = np.lexsort((ids, away, own))[starts][own]
    close = np.maximum(n, n[head]) * UP <= np.minimum(n, n[head]) * DOWN
    found = close & (ids != ids[head]) & (np.bitwise_count(words ^ words[head]).sum(axis=1, dtype="int64") <= RADIUS)
    return np.minimum(ids, ids[head])[found], np.maximum(ids, ids[head])[found]


def neighbours(lists: DataFrame) -> DataFrame:
    """(a, b): pairs that stand side by side in a list, by their fingerprints, or have its middle as one, and may be alike."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            columns = [c.to_numpy(zero_copy_only=False) for c in frame.columns]
            if len(columns[0]):
                prints = np.stack(columns[5:], axis=1)
                made = [*near_pairs(*columns[:5], prints, reach=1), stars(columns[0], columns[1], columns[3].astype("i8"), prints)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], ["a", "b"])

    order = ["s", "x", "_id"]  # what a cut between ranges or frames parts is found later
    return lists.repartitionByRange(shuffle_partitions(lists.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(lean(run), "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Those of pairs (a, b), a < b, whose whole sets are alike."""
    pairs = checkpoint(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    both = pairs.join(degree.select(F.col("_id").alias("a"), F.col("_n").alias("_na")), "a").join(degree.select(F.col("_id").alias("b"), F.col("_n").alias("_nb")), "b")
    first = F.col("_na") >= F.col("_nb")
    # The text of more pairs is sent once for each AT_ONCE or so of its pairs, with the other texts of these.
    turned = checkpoint(
        both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("o"), F.greatest("_na", "_nb").alias("_n")).select(
            "h", "o", F.pmod(F.xxhash64("o", "h"), F.ceil(F.col("_n") / AT_ONCE)).cast("int").alias("c")
        )
    )
    sides = turned.select("h", "c", F.lit(-1).cast("long").alias("o"), F.col("h").alias("_id")).distinct().unionByName(turned.select("h", "c", "o", F.col("o").alias("_id")))
    wanted = degree.select("_id")
    rows = sides.join(only(texts.select("_id", "_text"), wanted, "_id"), "_id").select("h", "c", "o", "_text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple = (None, np.zeros(0, "u8"))  # the text that the next rows are compared with, and its set
        for frame in frames:
            h, o = (frame.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            out = []
            for which, hashes, offsets in groups(frame.column(3).to_pylist(), width):
                for i, at in enumerate(range(which.start, which.stop)):
                    found = hashes[offsets[i] : offsets[i + 1]]
                    if o[at] < 0:
                        hub = (h[at], found)
                    elif hub[0] == h[at] and alike(hub[1], found):
                        out.append((min(h[at], o[at]), max(h[at], o[at])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return checkpoint(rows.repartition("h", "c").sortWithinPartitions("h", "c", "o").mapInArrow(lean(run), "a long, b long"))


def links(texts: DataFrame, rows: int, width: int = SHINGLE) -> DataFrame:
    """Edges (a, b) that connect the rows of texts (_id, _text), of different sets, as all pairs that are alike do."""
    most = _heavy(texts, rows, width)
    alone = texts.withColumn("_root", F.col("_id"))
    found = verified(neighbours(checkpoint(by_minima(alone, width))), texts, width)
    roots = components(found).select(F.col("node").alias("_id"), F.col("root").alias("_root"))
    roots = checkpoint(roots)
    marked = maybe(alone, roots.select("_id"), "_id", "_hit")
    known = marked.filter("_hit").drop("_root").join(_sent(roots), "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))
    named = marked.filter("not _hit").unionByName(known).drop("_hit")
    return found.unionByName(verified(candidates(by_prefix(named, most, width)), texts, width))
