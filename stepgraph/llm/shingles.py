"""Sets of word shingles as 48-bit hashes, made by array operations on the bytes of many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE = 5
#: Sets are alike from a Jaccard similarity of UP / DOWN on.
UP, DOWN = 4, 5
#: Bytes hashed at a time; a word of more bytes is hashed in one go.
CHUNK = 1 << 20
#: Bytes of the texts whose sets are made together, about; a longer text is a group of its own.
GROUP = 1 << 21
#: Bits of a hash; texts in a group at most, so that both fit a word.
HASH_BITS, MOST = 48, 1 << 16
#: Members of a set whose bits are counted in byte lanes.
LANE = 255
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2 ** 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, elementwise."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTE = mix(np.arange(1, 257, dtype="u8") * np.uint64(BASE))
_powers: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of BASE modulo 2 ** 64, and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(size, base, "u8")
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data starts, and its hash: a polynomial of its bytes, so equal words have equal ones."""
    starts, out, at = [], [], 0
    b = np.frombuffer(data, "u1")
    while at < len(b):
        stop = min(len(b), at + CHUNK)
        while stop < len(b) and not _SPACE[b[stop]]:  # no word is cut
            ahead = np.flatnonzero(_SPACE[b[stop : stop + CHUNK]])
            stop = stop + int(ahead[0]) if len(ahead) else min(len(b), stop + CHUNK)
        part = b[at:stop]
        edges = np.flatnonzero(np.diff(_SPACE[part].view("i1"), prepend=1, append=1))
        first, last = edges[::2], edges[1::2]
        if len(first):
            up, down = powers(len(part))
            sums = np.zeros(len(part) + 1, "u8")
            np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
            starts.append(first + at)
            out.append(mix((sums[last] - sums[first]) * down[first]))
        at = stop
    if not out:
        return np.zeros(0, "int64"), np.zeros(0, "u8")
    return np.concatenate(starts), np.concatenate(out)


def shingle_sets(texts: Sequence[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the set of text i, whose A-Z are lower-cased already, is hashes[offsets[i] : offsets[i + 1]], in order.

    A text of fewer words than width has one shingle, all its words; one without a word has none.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts, words = words_of(b"\n".join(parts))
    counts = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
    doc = np.repeat(np.arange(len(parts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the end of the text
    total = np.zeros(len(words), "u8")
    ahead = np.concatenate([words, np.zeros(width, "u8")])
    for k in range(width):
        total = np.where(left > k, mix(total * np.uint64(BASE) + ahead[k : k + len(words)] + np.uint64(k)), total)
    valid = (left >= width) | (left == np.repeat(counts, counts)) & (left < width)
    # the text's number above the hash, so that one sort makes all sets
    marked = np.sort(doc[valid].astype("u8") << np.uint64(HASH_BITS) | total[valid] >> np.uint64(64 - HASH_BITS))
    marked = marked[np.append(True, marked[1:] != marked[:-1])[: len(marked)]]
    sizes = np.bincount((marked >> np.uint64(HASH_BITS)).astype("int64"), minlength=len(parts))
    return marked & np.uint64((1 << HASH_BITS) - 1), np.append(0, np.cumsum(sizes))


def groups(texts: Sequence[str | None], width: int = SHINGLE) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(which texts, hashes, offsets) of the sets of all texts, a group of about GROUP bytes at a time."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP or i + 1 == len(texts) or i + 1 - first == MOST:
            yield (slice(first, i + 1), *shingle_sets(texts[first : i + 1], width))
            first, size = i + 1, 0


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * both >= UP * (len(a) + len(b) - both)


def sketches(hashes: np.ndarray, offsets: np.ndarray, columns: int) -> np.ndarray:
    """SimHash of each set in columns unsigned longs: a bit is 1 if it is set in over half the members."""
    n = np.diff(offsets)
    out = np.zeros((len(n), columns), "u8")
    if not len(hashes):
        return out
    blocks = -(-n // LANE)
    owner = np.repeat(np.arange(len(n)), blocks)
    starts = offsets[owner] + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    full = np.flatnonzero(n)
    first = np.searchsorted(owner, full)
    for c in range(columns):
        own = mix(hashes + np.uint64((c + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        bits = np.zeros((len(full), 8, 8), bool)
        for k in range(8):  # bits k, k + 8, ... in lanes of a byte each, which hold counts of LANE
            lanes = np.add.reduceat(own >> np.uint64(k) & np.uint64(0x0101010101010101), starts)
            ones = np.add.reduceat(lanes.astype("<u8").view("u1").reshape(-1, 8), first, axis=0, dtype="int64")
            bits[:, :, k] = 2 * ones > n[full, None]
        out[full, c] = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def prefixes(hashes: np.ndarray, offsets: np.ndarray, heavy: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, hash, position): the shingles each set is listed under, those that are in heavy (sorted) last, by their counts.

    Under any one order of the shingles, two sets that are alike share one of the first n - ceil(UP n / DOWN) + 1
    of each.
    """
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    weight = np.zeros(len(hashes), "int64")
    if len(heavy) and len(hashes):
        at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
        weight = np.where(heavy[at] == hashes, counts[at], 0)
    order = np.lexsort((hashes, weight, doc))
    place = np.arange(len(hashes)) - offsets[doc]
    kept = place < n[doc] + (-UP * n[doc]) // DOWN + 1
    return doc[kept], hashes[order][kept], place[kept]


def minima(hashes: np.ndarray, offsets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): the least of each set under each of count orders; two sets share a key with the probability of their similarity."""
    full = np.flatnonzero(np.diff(offsets))
    keys = [mix(hashes * np.uint64(BASE) + np.uint64(k + 1)) >> np.uint64(64 - HASH_BITS) for k in range(count)] if len(full) else []
    least = [np.minimum.reduceat(x, offsets[full]) | np.uint64(k << HASH_BITS) for k, x in enumerate(keys)]
    return np.tile(full, len(least)), np.concatenate([*least, np.zeros(0, "u8")])
