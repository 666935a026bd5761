"""Bit planes stored vertically and Hamming distances counted 64 at a time by carry-save counters.

Word j of plane p holds bit p of the fingerprints 64 j to 64 j + 63.  The distances of all fingerprints to their
d-th next neighbour are added up plane by plane in bitwise counters; words in which every distance is past the
radius are abandoned.
"""

from __future__ import annotations

import numpy as np

#: Planes counted between two looks at the radius, where it is wide.
GROUP = 32


def planes(values: np.ndarray) -> np.ndarray:
    """64 planes a column of ceil(n / 64) + 1 words; bit i % 64 of word i // 64 of plane p is bit p of values[i].

    values: n unsigned longs, or n rows of several.
    """
    values = values.reshape(len(values), -1)
    n, width = values.shape
    words = -(-n // 64)
    padded = np.zeros((words * 64, width), "u8")
    padded[:n] = values
    bits = np.unpackbits(padded.view("u1").reshape(-1, 8 * width), axis=1, bitorder="little")
    out = np.zeros((64 * width, words + 1), "u8")
    out[:, :words] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    return out


def lanes_of(at: np.ndarray, words: int) -> np.ndarray:
    """Words with the bits at set."""
    marks = np.zeros(words * 64, "u1")
    marks[at] = 1
    return np.packbits(marks, bitorder="little").view("<u8").copy()


def positions(found: np.ndarray) -> np.ndarray:
    """The bits that are set in the words found."""
    hit = np.flatnonzero(found)
    if not len(hit):
        return np.zeros(0, "int64")
    bits = np.unpackbits(found[hit].view("u1").reshape(-1, 8), axis=1, bitorder="little").reshape(len(hit), 64)
    w, b = np.nonzero(bits)
    return hit[w] * 64 + b


def _shifted(rows: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
    """Words at of each row, moved down by shift bits."""
    if not shift:
        return rows[..., at]
    return rows[..., at] >> np.uint64(shift) | rows[..., at + 1] << np.uint64(64 - shift)


def tally(bits: np.ndarray) -> list[np.ndarray]:
    """How many of the rows of bits are set, lane by lane: the binary digits of the counts, lowest first."""
    out = []
    while len(bits):
        carries = []
        while len(bits) > 1:
            if len(bits) == 2:
                carries.append(bits[:1] & bits[1:])
                bits = bits[:1] ^ bits[1:]
                break
            k = len(bits) // 3
            a, b, c = bits[:k], bits[k : 2 * k], bits[2 * k : 3 * k]
            half = a ^ b
            carries.append(a & b | half & c)
            bits = np.concatenate([half ^ c, bits[3 * k :]])
        out.append(bits[0])
        bits = np.concatenate(carries) if carries else bits[:0]
    return out


def _sum(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Digits of the sums of two counts."""
    zero = np.zeros_like(a[0])
    out, carry = [], zero
    for k in range(max(len(a), len(b))):
        x, y = a[k] if k < len(a) else zero, b[k] if k < len(b) else zero
        half = x ^ y
        out.append(half ^ carry)
        carry = x & y | half & carry
    return [*out, carry]


def _past(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose count is over radius."""
    over, equal = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for k in range(len(digits) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & digits[k]
        else:
            over = over | equal & digits[k]
            equal = equal & ~digits[k]
    return over if radius >> len(digits) == 0 else np.zeros_like(over)


def near_wide(plane: np.ndarray, wanted: np.ndarray, distance: int, radius: int) -> np.ndarray:
    """Of the lanes i set in the words wanted, those whose value differs from value i + distance in at most radius bits."""
    skip, shift = divmod(distance, 64)
    live = np.flatnonzero(wanted)
    out = np.zeros_like(wanted)
    digits: list[np.ndarray] = []
    at = 0
    while at < len(plane) and len(live):
        stop = min(len(plane), max(at + GROUP, radius + 1))
        rows = plane[at:stop]
        more = tally(rows[:, live] ^ _shifted(rows, live + skip, shift))
        digits = _sum(digits, more) if digits else more
        left = wanted[live] & ~_past(digits, radius)
        keep = left != 0
        if stop == len(plane):
            out[live[keep]] = left[keep]
        elif keep.mean() < 0.75:  # abandon the words in which every lane is past the radius
            live, digits = live[keep], [x[keep] for x in digits]
        at = stop
    return out


def near(plane: np.ndarray, wanted: np.ndarray, distance: int, radius: int) -> np.ndarray:
    """The same for a radius of at most 3: a two-bit counter and an overflow bit per lane, looked at every 8 planes."""
    skip, shift = divmod(distance, 64)
    live = np.flatnonzero(wanted)
    at = live + skip
    out = np.zeros_like(wanted)
    one = two = over = None
    for p in range(len(plane)):
        row = plane[p]
        bit = row[live] ^ _shifted(row, at, shift)
        if one is None:
            one, two, over = bit, np.zeros_like(bit), np.zeros_like(bit)
            continue
        carry = one & bit
        one = one ^ bit
        over = over | two & carry
        two = two ^ carry
        if p % 8 == 7:
            done = over
            if radius < 3:
                done = over | (two & one if radius == 2 else two if radius == 1 else two | one)
            left = wanted[live] & ~done
            keep = left != 0
            if not keep.any():
                return out
            if p == len(plane) - 1:
                out[live[keep]] = left[keep]
            elif keep.mean() < 0.75:
                live, at, one, two, over = live[keep], at[keep], one[keep], two[keep], over[keep]
    return out
