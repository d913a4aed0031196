"""Shared pieces of the corpus operators: zero-copy access to Arrow strings, bounded chunks, durable checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step looks at; small, so that its temporaries stay in a core's cache.
CHUNK_BYTES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where the session names none, as in tests, a folder of this machine is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return re.sub("^file:/(?!/)", "file:///", context._jsc.sc().getCheckpointDir().get())


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage into the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if where is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row is a range of its own."""
    n = len(offsets) - 1
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (as in splitmix64), in place where it can be."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits, underscore and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
WORD[95] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once: 64-bit hash, start and end byte of each, and the first word of each text (n + 1).

    A word is a run of ASCII letters, digits, underscores and bytes beyond ASCII; ASCII case is folded.
    No word spans two texts.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    inside = WORD[data]
    edge = np.empty(len(data), bool)
    edge[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=edge[1:])
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[begin] = inside[begin]
    start = np.flatnonzero(edge)
    if not len(start):
        return np.zeros(0, np.uint64), start, start, np.zeros(n + 1, np.int64)
    stop = np.empty(len(data), bool)
    stop[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=stop[:-1])
    last = begin[1:] - 1
    stop[last] = inside[last]
    end = np.flatnonzero(stop) + 1
    values = LOWER[data].astype(np.uint64) + np.uint64(1)
    values *= inside
    # position within the word, as the power of the polynomial
    place = np.arange(len(data), dtype=np.int64) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    values *= POWERS[np.minimum(place, len(POWERS) - 1)] if int((end - start).max()) <= len(POWERS) else _powers(int((end - start).max()))[np.minimum(place, int((end - start).max()) - 1)]
    hashes = mix(np.add.reduceat(values, start) + (end - start).astype(np.uint64))
    return hashes, start, end, np.searchsorted(start, offsets)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = _powers(256)
