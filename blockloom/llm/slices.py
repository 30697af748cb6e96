"""Arrays too large for one row, built by tasks and added up slice by slice.

A task fills arrays of `size` entries (bits of filters, counts of buckets), and sends them as
rows: one for each slice of SLICE entries that isn't empty, its places and values where few
are set, else all values. Rows of a slice meet in one task, sorted, and are folded one by one,
so a task holds one slice, however many tasks have sent rows. What comes to the driver is the
folded array, whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of a slice.
SLICE = 1 << 17
SCHEMA = "slice int, at binary, x binary, y binary"
ARROW = pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])
GROUP = 32


def cut(x: np.ndarray, y: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The slices of x, and of y, which is 0 wherever x is, as batches of SCHEMA. A slice without places is whole."""
    both = [x] if y is None else [x, y]
    width = sum(a.itemsize for a in both)
    held: list[tuple[int, bytes, bytes, bytes]] = []
    for k, lo in enumerate(range(0, len(x), SLICE)):
        part = [a[lo : lo + SLICE] for a in both]
        at = np.flatnonzero(part[0]).astype(np.uint32)
        if not len(at):
            continue
        if len(at) * (4 + width) < len(part[0]) * width:
            part = [a[at] for a in part]
        else:
            at = at[:0]
        held.append((k, at.tobytes(), part[0].tobytes(), part[1].tobytes() if len(part) > 1 else b""))
        if len(held) == GROUP:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(held: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], kind) for i, kind in enumerate(ARROW.types)], schema=ARROW)


Fold = Callable[[np.ndarray, np.ndarray | slice, np.ndarray, np.ndarray], None]


def folded(parts: DataFrame, size: int, kind: np.dtype, wide: int, fold: Fold, result: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Folds rows of cut() and gathers result(slice) of every slice on the driver.

    A slice starts as zeros of shape (wide, SLICE) and type kind; fold(state, at, x, y) adds a row
    to it. result gives bytes, as many for every slice; slices without rows are zeros.
    """
    length = min(SLICE, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = -1, np.zeros((wide, length), kind)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([result(state).tobytes()], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for k, at, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k != now:
                    if now >= 0:
                        yield done()
                    now = k
                    state[:] = 0
                where = np.frombuffer(at, np.uint32) if at else slice(None)
                fold(state, where, np.frombuffer(x, kind), np.frombuffer(y, kind))
        if now >= 0:
            yield done()

    rows = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, bits binary").toArrow()
    each = len(result(np.zeros((wide, length), kind)))
    out = np.zeros(each * (-(-size // SLICE)), np.uint8)
    for k, raw in zip(rows["slice"].to_pylist(), rows["bits"].to_pylist()):
        out[k * each : (k + 1) * each] = np.frombuffer(raw, np.uint8)
    return out
