"""Sets and counts of fixed size over a whole table, gathered without a group that grows with the number of tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a slice, the unit in which tables travel; and parts that the slices of all tasks are first merged in.
SLICE = 1 << 16
PARTS = 64


def merged(slices: DataFrame, add: Callable[[np.ndarray | None, bytes], np.ndarray], pack: Callable[[np.ndarray], bytes]) -> DataFrame:
    """One row for each ``slice`` of the rows (slice, part, data), added up in two steps: parts of the tasks, then all.

    Rows of a slice stream by one at a time, so a task holds one slice, however many tasks have sent theirs.
    """

    def run(batches):
        at, total = None, None
        for b in batches:
            for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at is not None and s != at:
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "data": pa.array([pack(total)], pa.binary())})
                    total = None
                at, total = s, add(total, d)
        if at is not None:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "data": pa.array([pack(total)], pa.binary())})

    first = slices.repartition("slice", "part").sortWithinPartitions("slice", "part").select("slice", "data").mapInArrow(run, "slice int, data binary")
    return first.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, data binary")


class Shared(NamedTuple):
    """Slices on their way to the tasks. ``name`` tells two of them apart in a worker that is used again."""

    name: str
    slices: Broadcast


_OPEN: dict[str, np.ndarray] = {}


def opened(shared: Shared, size: int, dtype, unpack: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """The whole table; a worker opens it once."""
    if shared.name not in _OPEN:
        while len(_OPEN) > 2:  # those that a running query needs, and no more
            del _OPEN[next(iter(_OPEN))]
        table = np.zeros(size, dtype)
        for k, c in shared.slices.value.items():
            part = unpack(c)
            table[k * len(part) : (k + 1) * len(part)] = part
        _OPEN[shared.name] = table
    return _OPEN[shared.name]


def share(spark: SparkSession, rows: DataFrame) -> Shared:
    """``rows`` of ``merged``, whose number and size are fixed, as a broadcast."""
    return Shared(uuid.uuid4().hex, spark.sparkContext.broadcast({r["slice"]: bytes(r["data"]) for r in rows.collect()}))


def bitmap(rows: DataFrame, column: str, bits: int) -> Shared:
    """Which numbers occur in ``column``, in so many bits: some others pass too, none is missed."""
    from pyspark import TaskContext

    def run(batches):
        seen = np.zeros(bits, bool)
        for b in batches:
            seen[(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(bits)).astype(np.int64)] = True
        part = TaskContext.get().partitionId() % PARTS
        for k in range(0, bits, SLICE):
            if seen[k : k + SLICE].any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([np.packbits(seen[k : k + SLICE]).tobytes()], pa.binary())})

    sent = rows.select(F.col(column).cast("bigint")).where(F.col(column).isNotNull()).mapInArrow(run, "slice int, part int, data binary")
    return share(rows.sparkSession, merged(sent, lambda t, d: np.frombuffer(d, np.uint8) if t is None else t | np.frombuffer(d, np.uint8), lambda t: t.tobytes()))


def has(shared: Shared, bits: int, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers (64 bits) the bitmap lets pass."""
    table = opened(shared, bits // 8, np.uint8, lambda c: np.frombuffer(c, np.uint8))
    at = (numbers.view(np.uint64) % np.uint64(bits)).astype(np.int64)
    return (table[at >> 3] & (128 >> (at & 7)).astype(np.uint8)) != 0
