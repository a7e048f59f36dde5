"""What the document operators share: tables, Arrow batches in slices of bounded size, rolling hashes, sorted-hash exchange."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15  # 2^64 / golden ratio, an odd multiplier


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constants(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """A few rows of the configuration as a table (through Arrow, so that no Python worker is started for them)."""
    schema = pa.schema(list(columns.items()))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(columns, r)) for r in rows], schema))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def text_key(column: str) -> Column:
    """A 16-byte key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit(""))))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes of ``column``; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum(lengths(batch.column(column)))
        first, base = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(first, last - first)
            base, first = int(sizes[last - 1]), last


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with small batches: texts of a batch exist in the JVM, its Arrow buffers and the worker at once.

    Lowers the session's limit of bytes in an Arrow batch, and leaves a limit that is lower still.
    """
    conf = df.sparkSession.conf
    now = int("".join(c for c in conf.get(BATCH_KEY) if c.isdigit() or c == "-"))
    if not 0 < now <= BATCH_BYTES:
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), schema)


def tidy(run: Callable) -> Callable:
    """A task function that hands freed memory back when it ends: workers are reused and several may be kept idle."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return over_batches


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    return np.array([0 if n is None else n for n in pc.binary_length(column).to_pylist()], dtype=np.int64)


def texts(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by a zero byte; and where each text begins, with the end as last entry."""
    parts = texts(column)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\0".join([*parts, b""]), np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (two multiply-xorshift rounds)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Rolling:
    """Hashes of any substrings of one array of bytes or of 64-bit hashes, from prefix sums of b[i] * p^i modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        self._data, self._seed = data, seed
        multiplier = (_ODD * (2 * seed + 1)) % 2**64 | 1
        self._up, self._down = self._power(multiplier, len(data) + 1)
        if data.dtype == np.uint8:
            letters = mix(np.arange(1, 257, dtype=U64) * U64(_ODD) + U64(seed))[data]
        else:
            letters = mix(data * U64(_ODD) + U64(seed))
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum(letters * self._up[: len(data)], out=self._sums[1:])

    @classmethod
    def _power(cls, multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(multiplier)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            have = tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, m, U64)]))
                         for m in (multiplier, pow(multiplier, -1, 2**64)))
            cls._powers[multiplier] = have
        return have

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(U64))

    def every(self, length: int) -> np.ndarray:
        """The hash of the substring of ``length`` bytes at every start."""
        n = len(self._data) - length + 1
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n] + U64(length))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places the half-open intervals cover."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0
