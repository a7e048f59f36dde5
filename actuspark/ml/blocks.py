"""Rows packed to blocks of arrays, and sums of arrays over all blocks: what iterative fits read once an iteration.

A block is one row of a stored table with a few thousand records in binary columns. A pass maps every block to partial sums of
fixed size, adds those of a task inside the task, and adds those of all tasks per key after one shuffle; only the sums, whose
size depends on the number of features and not of rows, reach the driver. The shuffle is left out while the sums of all tasks
together are no more than a megabyte. What takes thousands of passes gives :func:`total` a function that draws its few
numbers from the whole sums in the tasks, so that only these reach the driver, and reads blocks that the executors hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from actuspark.session import materialize

#: Records of a block, and of a task at least: below that a pass is nothing but the start of its tasks.
BLOCK, TASK_ROWS = 16384, 32768
#: Rows of a record that executors hold: the more, the fewer calls a pass makes.
HELD = 1 << 16
#: Bytes of sums that the driver takes from all tasks at once.
FETCH = 1 << 20
SUMS = "model int, part int, body binary"
Arrays = Mapping[str, np.ndarray]


def numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Columns as one (columns, rows) array of doubles, null as NaN."""
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]) if names else np.zeros(
        (0, batch.num_rows))


def packed(df: DataFrame, pack: Callable[[pa.RecordBatch], Arrays], names: list[str], label: str, rows: int,
           tasks: int | None = None) -> DataFrame:
    """A stored table of blocks: ``n`` and the bytes of the arrays ``names`` that ``pack`` makes of up to ``BLOCK`` of the ``rows``.

    Several ``tasks`` get as many rows each, however the rows lay before: a pass waits for the task that has most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                made = pack(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.num_rows], pa.int32()), *(pa.array([np.ascontiguousarray(made[c]).tobytes()]) for c in names)], ["n", *names])

    schema = ", ".join(["n int", *(f"{c} binary" for c in names)])
    even = df.repartition(tasks) if tasks and tasks > 1 else df.coalesce(tasks or rows // TASK_ROWS + 1)
    return materialize(even.mapInArrow(run, schema), label)


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def kept(blocks: DataFrame, joined: Callable[[list[dict]], dict]) -> RDD:
    """The blocks, made one record by ``joined`` up to ``HELD`` rows, as the executors hold them in memory or on disk between
    passes; what is lost is read from the stored table again."""
    names = blocks.columns

    def run(part: Iterator) -> Iterator[dict]:
        some: list[dict] = []
        for row in part:
            some.append(dict(zip(names, row)))
            if sum(r["n"] for r in some) >= HELD:
                yield joined(some)
                some = []
        if some:
            yield joined(some)

    return blocks.rdd.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)


def total(blocks: DataFrame | RDD, sums: Callable[[dict], Iterator[tuple[int, int, np.ndarray]]], rows: int,
          size: int, drawn: Callable[[int, int, np.ndarray], np.ndarray] | None = None, tasks: int = 1,
          keys: int = 1, sent: Callable[[int, int, np.ndarray], np.ndarray] | None = None) -> dict[tuple[int, int], np.ndarray]:
    """The arrays that ``sums`` gives for each (model, part) of a block, added up over all blocks.

    ``rows``: records of all blocks. ``size``: numbers in all arrays of one block. ``drawn``: what a task makes of the whole sums
    of a (model, part); then the blocks are :func:`kept` ones in ``tasks`` parts, and the sums of about ``keys`` (model, part) are
    shuffled if these are several. ``sent``: what a task makes of its own sums of a (model, part) before they are added across tasks.
    """

    def add(into: dict, key: tuple[int, int], body: np.ndarray) -> None:
        into[key] = into[key] + body if key in into else body

    def inside(part: Iterator[dict]) -> dict:
        found: dict = {}
        for record in part:
            for model, key, body in sums(record):
                add(found, (model, key), body)
        return {key: sent(*key, body) for key, body in found.items()} if sent else found

    if drawn is not None:  # thousands of passes: no plan for each
        def across(pairs: Iterable[tuple[tuple[int, int], np.ndarray]]) -> list[tuple[tuple[int, int], np.ndarray]]:
            found: dict = {}
            for key, body in pairs:
                add(found, key, body)
            return [(key, drawn(*key, body)) for key, body in found.items()]

        if tasks == 1:
            return dict(blocks.coalesce(1).mapPartitions(lambda part: across(inside(part).items())).collect())
        parts = min(keys // 8 + 1, tasks)
        added = blocks.mapPartitions(lambda part: inside(part).items()).partitionBy(parts, lambda key: (31 * key[0] + key[1]) % parts)
        return dict(added.mapPartitions(across).collect())

    def batch(found: dict) -> pa.RecordBatch:
        keys = list(zip(*found)) if found else [(), ()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(k, pa.int32()) for k in keys), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["model", "part", "body"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield batch(inside(records(batches)))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for r in records(batches):
            add(found, (r["model"], r["part"]), np.frombuffer(r["body"]))
        yield batch(found)

    added = blocks.mapInArrow(within, SUMS)
    if (rows // TASK_ROWS + 1) * size * 8 > FETCH:
        added = added.repartition("model", "part").mapInArrow(over, SUMS)
    found: dict = {}
    for r in added.toArrow().to_pylist():
        add(found, (r["model"], r["part"]), np.frombuffer(r["body"]))
    return found
