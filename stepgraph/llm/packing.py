"""Packing token sequences by best-fit decreasing.

Each task tokenises its documents, cuts every document into full windows and one remainder, and packs
the remainders of a bounded block of documents by best-fit decreasing: a segment tree over remaining
capacities finds the tightest open window.  A sequence is padded to the window unless its length is a
power of two, so the few windows that stay poorly filled are cut at powers of two instead of padded.
No shuffle is needed; a lost task is redone from its input split.

Defined cases: null text is empty text (one piece with the end token only); equal ids are separate
documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

WINDOW = 2048
END = 1
#: Remainders packed together.
BLOCK = 50_000
#: A window with more padding than this is cut at powers of two.
MAX_PADDING = 16
#: Encoded pieces in each of the two generations that a worker keeps.
CACHE = 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Counts of open windows by remaining capacity; tightest(n) is the least capacity of at least n."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        self._move(capacity, 1)

    def take(self, capacity: int) -> int:
        self._move(capacity, -1)
        return self.open[capacity].pop()

    def _move(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.count[node]:
            return least
        while node > 1:  # up to the first subtree on the right that holds an open window
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(lengths: Iterable[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of positions in lengths, by best-fit decreasing; each length is 1 to window."""
    lengths = list(lengths)
    tree, windows = CapacityTree(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        capacity = tree.tightest(lengths[i])
        if capacity is None:
            capacity, which = window, len(windows)
            windows.append([])
        else:
            which = tree.take(capacity)
        windows[which].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], which)
    return windows


def cut_at_powers(lengths: list[int], window: int, max_padding: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (position, start, length) that hold the given lengths in order with no padding over max_padding."""
    used = sum(lengths)
    parts = []
    if window - used > max_padding:
        left = used
        while left and window - left > max_padding:
            parts.append(1 << (left.bit_length() - 1))
            left -= parts[-1]
        parts += [left] * bool(left)
    else:
        parts = [used]
    out, at, done = [], 0, 0
    for size in parts:
        row = []
        while size:
            n = min(size, lengths[at] - done)
            row.append((at, done, n))
            size, done = size - n, done + n
            if done == lengths[at]:
                at, done = at + 1, 0
        out.append(row)
    return out


class Encoder:
    """ids of a text as little-endian 32-bit bytes, from those of its pieces, each distinct piece encoded once.

    That is exact for tokenizers that normalise characters to NFC and lower case, and then cut at PIECES and drop
    white space, as word_bpe_49k.json does; any other tokenizer encodes whole texts.  Texts with other characters than
    PLAIN ones are cut at white space only.
    """

    # What a tokenizer's file says of such a cut.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

    # The cut of word_bpe_49k.json; characters whose case and classes no Unicode version changes.
    # PLAIN leaves out the capitals up to U+024F whose lower case PIECES does not know as a letter.
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\s0-9a-z\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
    PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u0180\u0182-\u0185\u0187\u0188\u018b-\u018e\u0191\u0192\u0195\u0198-\u019b\u019e\u01a0-\u01a5\u01a7\u01a8\u01aa-\u01ad\u01af\u01b0\u01b3-\u01b6\u01b8-\u0239\u023b-\u023d\u023f-\u0243\u0246-\u024f]*")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(Path(path).read_text(encoding="utf-8"))
        cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        special = all(t["content"].startswith("<|") and not t["normalized"] for t in config.get("added_tokens") or [])
        self.in_pieces = config.get("normalizer") == self.NORMALIZER and cuts[0] == self.SPLIT and special and config["model"]["type"] == "BPE"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return self.PIECES.findall(text.lower())
        return [x for x in re.split(r"[ \t\r\n]+", text) if x]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.in_pieces:
            return [array("I", code.ids).tobytes() for code in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > CACHE:  # what the last generation used is carried over as it is met again
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [self._cut(t) for t in texts]
        fresh = list(set().union(*cut).difference(known))
        learn = []
        for piece in fresh:
            code = older.get(piece)
            if code is None:
                learn.append(piece)
            else:
                known[piece] = code
        for i in range(0, len(learn), 4096):
            part = learn[i : i + 4096]
            for piece, code in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[piece] = array("I", code.ids).tobytes()
        out = [b"".join([known[x] for x in pieces]) for pieces in cut]
        for piece in learn:
            if len(piece) > 256:
                del known[piece]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for the Python worker, whichever tasks it runs."""
    return Encoder(path)


def _batches(frames: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """Ids and texts in lists of at most about so many characters."""
    for frame in frames:
        ids, texts, size = [], [], 0
        for key, text in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
            word = text.as_py() or ""
            ids.append(key)
            texts.append(word)
            size += len(word)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end: int = END,
    block: int = BLOCK,
    max_padding: int = MAX_PADDING,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Pieces of the documents in padded sequences; columns as SCHEMA.  tokenizer: a file, on every executor.

    start counts the document's ids before the piece, offset those of the sequence.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 33
        last = np.array([end], dtype="<u4").tobytes()
        rows: list[tuple] = []
        rests: list[tuple] = []  # id, start, bytes, tokens of the document

        def flush() -> None:
            nonlocal number
            lengths = [len(r[2]) // 4 for r in rests]
            for members in best_fit(lengths, window):
                for row in cut_at_powers([lengths[i] for i in members], window, max_padding):
                    offset = 0
                    for at, begin, n in row:
                        doc, start, data, tokens = rests[members[at]]
                        crc = zlib.crc32(data[4 * begin : 4 * (begin + n)])
                        rows.append((doc, start + begin, n, crc, tokens, number, offset))
                        offset += n
                    number += 1
            rests.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        names[0] = key
        for ids, texts in _batches(frames):
            for doc, data in zip(ids, encode(texts), strict=True):
                data += last
                tokens = len(data) // 4
                whole = tokens // window * window
                for start in range(0, whole, window):
                    crc = zlib.crc32(data[4 * start : 4 * (start + window)])
                    rows.append((doc, start, window, crc, tokens, number, 0))
                    number += 1
                if whole < tokens:
                    rests.append((doc, whole, data[4 * whole :], tokens))
                if len(rests) >= block:
                    flush()
                if len(rows) >= 50_000:
                    yield out()
        if rests:
            flush()
        if rows:
            yield out()

    return docs.select(key, text).mapInArrow(lean(run), SCHEMA.replace("doc_id", key, 1))


def op10_packing(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
