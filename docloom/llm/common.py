"""Shared helpers: the working folder, checked broadcasts and Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Parquet, and rows, up to which a stored side may be broadcast; above either the join shuffles.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``.  Where none is named, a
    plain local session gets a temporary folder and any other session the
    warehouse, which all executors can reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        own = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(own)
        return own
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docloom"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This computes the plan once, cuts its lineage and survives the loss of any
    executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """The bytes of the files that a stored frame is read from."""
    hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return sum(p.getFileSystem(hadoop).getFileStatus(p).getLen() for p in paths)


def checked_broadcast(df: DataFrame, size: int = BROADCAST_BYTES, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` (a stored frame) is small in bytes and rows, else ``df`` itself."""
    return F.broadcast(df) if stored_bytes(df) <= size and df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = 512, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds few rows and a bounded amount of text.

    A row larger than ``size`` comes alone; no text is ever cut.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.zeros(n, np.int64)
        col = batch.column(batch.schema.get_field_index(column))
        raw = offsets_of(col)
        lengths[:] = np.diff(raw)
        at = 0
        while at < n:
            stop, held = at, 0
            while stop < n and stop - at < rows and (stop == at or held + lengths[stop] <= size):
                held += int(lengths[stop])
                stop += 1
            yield batch.slice(at, stop - at)
            at = stop
    # workers are used again by later tasks: what Arrow holds in reserve goes back
    pa.default_memory_pool().release_unused()


def offsets_of(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, relative to its data buffer."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if len(col) == 0 or col.buffers()[1] is None:
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the offsets of its values; null is empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    off = offsets_of(col)
    data = col.buffers()[2] if len(col.buffers()) > 2 else None
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


# Hashing of byte ranges: each byte becomes a random 64-bit value, a range is the
# polynomial of its values in an odd base, and prefix sums with the inverse base
# give any range of a batch without a loop.
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[i] = np.cumprod(full, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end)."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word [^\\x20\\x09-\\x0D]+, and the first and last-plus-one word of each text."""
    n = len(data)
    if not n:
        zero = np.zeros(len(offsets) - 1, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), zero, zero
    word = ~SPACE[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] |= word[edge]
    end[edge - 1] |= word[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    return starts, ends, first[:-1], first[1:]
