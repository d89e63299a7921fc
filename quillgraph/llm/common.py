"""What the operators share: reading, scratch tables, and vectorised work on the words of a batch of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators.graph import checkpointed  # noqa: F401  (the operators take it from here)

#: Bytes of text that the vectorised helpers look at together; bounds their memory whatever the batch holds.
CHUNK_BYTES = 1 << 20

#: The separators of `[^\x20\x09-\x0D]+`.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


#: Bytes of rows that go to a Python worker at once. Spark's default is eight times as much, which each running task holds several times over.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks send rows to Python workers in batches of BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets go of finished steps' shuffles and checkpoints: Spark deletes their files once the driver has collected the objects that name them."""
    gc.collect()
    spark._jvm.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over a partition's batches, which gives freed memory back at the end: workers live on and run other stages' tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Splits a string column into runs of rows of about `limit` bytes.

    Yields (first row, bytes with a space after each text, offsets of the texts in them); null is empty.
    A single longer text is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        part = offsets[first : last + 1]
        k = last - first
        out = np.full(int(part[-1] - part[0]) + k, 0x20, dtype=np.uint8)
        starts = part[:-1] - part[0] + np.arange(k)
        keep = np.ones(len(out), dtype=bool)
        keep[starts + np.diff(part)] = False
        out[keep] = data[part[0] : part[-1]]
        yield first, out, np.append(starts, len(out))
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts at `offsets`: for each word its text's position, 64-bit hash of its A-Z lower-cased bytes, start and end."""
    space = IS_SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    length = ends - starts
    letters = np.flatnonzero(~space)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
    codes = _BYTE_CODE[_FOLD[data[letters]]]
    codes *= powers(int(length.max()))[place]
    hashes = mix(np.add.reduceat(codes, np.cumsum(length) - length) + length.astype(np.uint64))
    return np.searchsorted(offsets, starts, side="right") - 1, hashes, starts, ends


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
