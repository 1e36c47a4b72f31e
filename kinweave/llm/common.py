"""Shared pieces: table access, Arrow batching, and a vectorised word tokenizer and hasher."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once by the vectorised code; bounds the temporary arrays of a worker.
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes outside ASCII letters and digits, once A-Z are folded to a-z; what is not ASCII belongs to words.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[97:123] = NOT_WORD[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD1B54A32D192ED03)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def one_thread() -> None:
    """Let numpy's matrix products use one thread in this process: a Spark task has one core, and the other tasks the others."""
    global _single
    if not _single:
        _single = True
        for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
            library = ctypes.CDLL(str(path))
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)


_single = False


def trim() -> None:
    """Give free pages of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another libc
        pass


def release(spark: SparkSession) -> str:
    """Give back to the system what finished work left in the driver: garbage first (with it Spark drops broadcasts and shuffles that
    nobody reads any more), then the free pages that malloc keeps for each of the threads that query stages ran in, in the JVM and in Python.
    Returns what the JVM says of its pages; empty where it has no such command."""
    gc.collect()
    trim()
    jvm = spark._jvm
    jvm.System.gc()
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is closed to reflection
        (invoke,) = (m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(beans, args)
    except Py4JError:
        return ""


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept between calls."""
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = np.uint64(pow(key, -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.full(size, base, dtype=np.uint64)
            down = np.full(size, inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            have = _POWERS[key] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end], from one prefix sum."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, null counting as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts ``raw[offs[i]:offs[i+1]]``, for a few texts at once.

    start/end: byte ranges of the words in ``raw[base:]``; first[i]:first[i+1] are the words of text i.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, gaps: np.ndarray = WHITE, fold: np.ndarray | None = None):
        """gaps: bytes that are in no word; fold: what each byte is read as."""
        self.base = int(offs[0])
        self.bytes = raw[self.base : int(offs[-1])]
        if fold is not None:
            self.bytes = fold[self.bytes]
        rel = offs - self.base
        ink = ~gaps[self.bytes]
        n = len(ink)
        begin = ink.copy()
        begin[1:] &= ~ink[:-1]
        stop = ink.copy()
        stop[:-1] &= ~ink[1:]
        inner = rel[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] |= ink[inner]
        stop[inner - 1] |= ink[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, rel)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end, _P)

    def ngrams(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """A hash for each position with n words left in the whole chunk (positions may cross texts)."""
        count = len(hashes) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        begin = np.arange(count)
        return span_hashes(hashes, begin, begin + n, _Q)


def pieces(offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
