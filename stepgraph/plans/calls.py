"""Nodes that run user code: a Python function for each active run, in Arrow batches.

The function gets the committed values by field and the number of the attempt, and gives ("ok", update), ("error",
reason) or ("interrupt", None).  What becomes of it is classified as follows: an error, an exception and a timeout may
be tried again; anything else that is given back, and a write to a field that the node does not declare, may not.
Only runs in which the node is active are called.  A call that is given up goes on in its thread, and its result is
dropped; a batch that is redone after a lost executor calls again, so calls should be idempotent.

Calls of a task run one after another, on one thread.  While one of them only waits, a second thread takes up the calls
after it, and so on, so that waits and timeouts pass beside each other and not in turn; so calls must bear others beside them.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: No attempt may take longer, whatever its node says.
HOST_TIMEOUT_MS = 60_000
TIMEOUT = ("error", True, "timeout", {})
#: Seconds for which a call may wait before the next one begins beside it, and calls of a task that run beside each other at most.
STALL, LIVE = 0.005, 64
#: Batches of a task that are read while a call in the first of them still waits.
OPEN = 16
PLAIN = [("status", T.StringType()), ("retryable", T.BooleanType()), ("reason", T.StringType())]


def outcome(call: Callable[..., Any], state: dict[str, Any], number: int, writes: frozenset[str]) -> tuple:
    """(status, whether it may be tried again, reason, update) of one call, however long it takes."""
    try:
        got = call(state, number)
    except BaseException as error:  # noqa: BLE001  user code may raise anything, and it is reported
        return "error", True, f"{type(error).__name__}: {error}", {}
    if not isinstance(got, tuple) or len(got) != 2 or got[0] not in ("ok", "error", "interrupt"):
        return "error", False, "invalid_return", {}
    if got[0] == "error":
        return "error", True, str(got[1]), {}
    if got[0] == "interrupt":
        return "interrupt", False, None, {}
    if not isinstance(got[1], dict):
        return "error", False, "invalid_return", {}
    if not got[1].keys() <= writes:
        return "error", False, "invalid_write", {}
    return "ok", False, None, got[1]


class Batch:
    """The results of a batch by row, None where nothing is called, and how many are not there yet."""

    def __init__(self, size: int) -> None:
        self.results: list[tuple | None] = [None] * size
        self.left = 0


class Calls:
    """The calls of one task, begun in the order in which they are added."""

    def __init__(self, call: Callable[..., Any], writes: tuple[str, ...], timeout_ms: int) -> None:
        self.call, self.writes, self.limit = call, frozenset(writes), min(timeout_ms, HOST_TIMEOUT_MS) / 1000
        self.todo: deque[tuple[Batch, int, dict[str, Any], int]] = deque()
        self.running: dict[object, tuple[float, Batch | None, int]] = {}  # since when, which row
        self.changed = threading.Condition()

    def add(self, batch: Batch, rows: list[tuple[int, dict[str, Any], int]]) -> None:
        """rows: (place in the batch, state, attempt)."""
        with self.changed:
            batch.left += len(rows)
            self.todo.extend((batch, *row) for row in rows)

    def _put(self, batch: Batch, at: int, result: tuple) -> None:
        batch.results[at] = result
        batch.left -= 1
        if not batch.left:
            self.changed.notify_all()

    def _work(self, me: object) -> None:
        """Calls until nothing is left to do, or until a call of this thread was given up."""
        result = None
        while True:
            with self.changed:
                if me not in self.running:
                    return
                if result is not None:
                    self._put(batch, at, result)
                if not self.todo:
                    del self.running[me]
                    self.changed.notify_all()
                    return
                batch, at, state, number = self.todo.popleft()
                began = time.monotonic()
                self.running[me] = (began, batch, at)
            result = outcome(self.call, state, number, self.writes)
            if time.monotonic() - began >= self.limit:
                result = TIMEOUT

    def go(self, until: Callable[[], bool]) -> None:
        """Gives up what is over its time and starts threads, until that holds."""
        with self.changed:
            wall, cpu = time.monotonic(), time.process_time()
            while not until():
                now = time.monotonic()
                for me, (began, batch, at) in list(self.running.items()):
                    if batch is not None and now - began >= self.limit:
                        del self.running[me]
                        self._put(batch, at, TIMEOUT)
                # Another thread helps only while the others wait; if they compute, it would slow them.
                if self.todo and len(self.running) < LIVE:
                    stalled = all(now - began >= STALL for began, _, _ in self.running.values())
                    if not self.running or (stalled and time.process_time() - cpu < (now - wall) / 2):
                        me = object()
                        self.running[me] = (now, None, 0)
                        threading.Thread(target=self._work, args=(me,), daemon=True).start()
                wall, cpu = now, time.process_time()
                if until():
                    return
                ends = min((began + self.limit - now for began, _, _ in self.running.values()), default=STALL)
                self.changed.wait(max(min(STALL, ends) if self.todo else ends, 0.0005))


def attempt(call: Callable[..., Any], state: dict[str, Any], number: int, writes: tuple[str, ...], timeout_ms: int) -> tuple:
    """The outcome of one call within its time."""
    calls, one = Calls(call, writes, timeout_ms), Batch(1)
    calls.add(one, [(0, state, number)])
    calls.go(lambda: not one.left)
    return one.results[0]


def result_type(kinds: dict[str, T.DataType]) -> T.StructType:
    """p_f: whether field f was written, v_f: what."""
    fields = [T.StructField(n, k) for n, k in PLAIN]
    for name, kind in kinds.items():
        fields += [T.StructField(f"p_{name}", T.BooleanType()), T.StructField(f"v_{name}", kind)]
    return T.StructType(fields)


def called(call: Callable[..., Any], state: dict[str, Column], active: Column, number: Column, kinds: dict[str, T.DataType], timeout_ms: int) -> Column:
    """The result of the call for each row that is active, else null throughout."""
    names, schema = list(state), result_type(kinds)

    def taken(frames: tuple[pd.Series, ...]) -> list[tuple[int, dict[str, Any], int]]:
        live, numbers, *values = frames
        at = [i for i, on in enumerate(live) if on]
        if len(at) < len(live):
            numbers, *values = (x.iloc[at] for x in (numbers, *values))
        given = [[None if v is None or isinstance(v, float) and v != v or v is pd.NA else v for v in x] for x in values]
        states = (dict(zip(names, row, strict=True)) for row in (zip(*given, strict=True) if given else [()] * len(at)))
        return [(i, state, int(n)) for i, state, n in zip(at, states, numbers, strict=True)]

    def frame(batch: Batch) -> pd.DataFrame:
        out = {c: [None] * len(batch.results) for c in schema.names}
        for i, got in enumerate(batch.results):
            if got is None:
                continue
            out["status"][i], out["retryable"][i], out["reason"][i], update = got
            for name in kinds:
                out[f"p_{name}"][i], out[f"v_{name}"][i] = name in update, update.get(name)
        return pd.DataFrame(out, columns=schema.names, dtype=object)

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        calls, held = Calls(call, tuple(kinds), timeout_ms), deque()
        for frames in batches:
            held.append(batch := Batch(len(frames[0])))
            calls.add(batch, taken(frames))
            calls.go(lambda: not calls.todo)
            while held and (not held[0].left or len(held) > OPEN):
                calls.go(lambda: not held[0].left)
                yield frame(held.popleft())
        while held:
            calls.go(lambda: not held[0].left)
            yield frame(held.popleft())

    return run.asNondeterministic()(active, number, *state.values())
