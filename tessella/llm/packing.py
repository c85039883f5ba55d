"""Small binary codecs and helpers for rows that carry many values to one bucket.

A row for each n-gram costs Spark tens of bytes; an array of sorted positions or hashes costs
a few bytes an entry. The operators therefore ship one row for each (producer, bucket) pair
that has entries.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_WIDTHS = (2, 4, 8, 16)


def pack_counts(values: np.ndarray) -> bytes:
    """Non-negative integers under 2**32: 2, 4, 8, 16 or 32 bits each, whichever is least in all, and 32 more for
    those that do not fit."""
    n = len(values)
    sizes = [n * bits + 32 * int((values >= (1 << bits) - 1).sum()) for bits in _WIDTHS] + [32 * n]
    bits = (*_WIDTHS, 32)[int(np.argmin(sizes))]
    start = n.to_bytes(4, "little") + bytes([bits])
    if bits == 32:
        return start + values.astype("<u4").tobytes()
    limit = (1 << bits) - 1
    large = values >= limit
    head = np.where(large, limit, values).astype(f"<u{max(1, bits // 8)}")
    if bits < 8:
        each = 8 // bits
        head = np.append(head, np.zeros(-n % each, np.uint8)).reshape(-1, each)
        head = np.bitwise_or.reduce(head << np.arange(0, 8, bits, dtype=np.uint8), axis=1)
    return start + head.tobytes() + values[large].astype("<u4").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    n, bits = int.from_bytes(raw[:4], "little"), raw[4]
    size = -(-n * bits // 8)
    out = np.frombuffer(raw, f"<u{max(1, bits // 8)}", size // max(1, bits // 8), 5)
    if bits < 8:
        out = ((out[:, None] >> np.arange(0, 8, bits, dtype=np.uint8)) & ((1 << bits) - 1)).ravel()[:n]
    out = out.astype(np.int64)
    if bits < 32:
        large = np.flatnonzero(out == (1 << bits) - 1)
        out[large] = np.frombuffer(raw, "<u4", len(large), 5 + size)
    return out


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending integers (gaps under 2**32), stored as gaps."""
    return pack_counts(np.diff(values, prepend=0)) if len(values) else pack_counts(values)


def unpack_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_counts(raw))


def pack_sorted(values: np.ndarray, bits: int) -> bytes:
    """Ascending integers under 2**bits: their low bits as they are, the rest as the marks of a bitmap, which
    takes about bits - log2(n) + 2 bits an entry."""
    n = len(values)
    low = max(0, bits - n.bit_length())
    marks = np.zeros((int(values[-1]) >> low) + n, np.uint8) if n else np.zeros(0, np.uint8)
    marks[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    whole, rest = divmod(low, 8)
    upper = np.packbits(marks).tobytes()
    parts = [n.to_bytes(4, "little"), bytes([low]), len(marks).to_bytes(6, "little"), upper, raw[:, :whole].tobytes()]
    if rest:
        parts.append(np.packbits(np.unpackbits(raw[:, whole : whole + 1], axis=1)[:, 8 - rest :]).tobytes())
    return b"".join(parts)


def unpack_sorted(raw: bytes) -> np.ndarray:
    n, low, size = int.from_bytes(raw[:4], "little"), raw[4], int.from_bytes(raw[5:11], "little")
    data = np.frombuffer(raw, np.uint8, offset=11)
    whole, rest = divmod(low, 8)
    at = -(-size // 8)
    high = np.flatnonzero(np.unpackbits(data[:at], count=size)) - np.arange(n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = data[at : at + n * whole].reshape(n, whole)
    if rest:
        bits = np.zeros((n, 8), np.uint8)
        bits[:, 8 - rest :] = np.unpackbits(data[at + n * whole :], count=n * rest).reshape(n, rest)
        out[:, whole] = np.packbits(bits, axis=1).ravel()
    return out.view("<u8").ravel().astype(np.uint64) | (high.astype(np.uint64) << np.uint64(low))


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; much faster here than numpy.unique."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def sorting_order(keys: np.ndarray, bits: int = 64) -> np.ndarray:
    """The order that sorts unsigned integers under 2**bits. The places go into the low bits of the keys, which
    are then sorted as numbers; neighbours that only the bits so lost tell apart are swapped afterwards. Much
    faster here than numpy.argsort."""
    n = len(keys)
    if n < 2:
        return np.zeros(n, np.int64)
    mask = np.uint64((1 << n.bit_length()) - 1)
    order = keys << np.uint64(64 - bits)
    order &= ~mask
    for a in range(0, n, 1 << 16):
        order[a : a + (1 << 16)] |= np.arange(a, min(n, a + (1 << 16)), dtype=np.uint64)
    order.sort()
    order &= mask
    order = order.view(np.int64)
    ordered = keys[order]
    while len(wrong := np.flatnonzero(ordered[1:] < ordered[:-1])):
        wrong = wrong[np.diff(wrong, prepend=-2) > 1]
        for x in (order, ordered):
            x[wrong], x[wrong + 1] = x[wrong + 1], x[wrong]
    return order


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in an ordered array."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def bucket_cuts(buckets: np.ndarray, count: int) -> np.ndarray:
    """Bounds of each bucket's slice in an array of ascending bucket numbers."""
    return np.searchsorted(buckets, np.arange(count + 1))


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[k] .. starts[k]+lengths[k]-1 of every k, end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def frames(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in all rows; one narrow aggregate."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def give_back() -> None:
    """Hands memory that this process has freed back to the system. Spark keeps workers for later tasks, and what they
    keep counts beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def column_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows; memory is given back after the last."""
    yield from (b for b in batches if b.num_rows)
    give_back()


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat `name type, ...` list, without a Spark session."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(","))])


_marked: set[str] = set()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share.

    Only a local session without that setting gets a temporary folder; on a cluster its lack is an
    error.
    """
    import tempfile

    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    if context.applicationId not in _marked:
        _marked.add(context.applicationId)
        delete(spark, context.getCheckpointDir(), at_exit=True)  # Spark's own folder of this session in it
    return folder


def delete(spark: SparkSession, folder: str, at_exit: bool = False) -> None:
    """Remove a folder of intermediate rows, now or when the session's driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(path) if at_exit else system.delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so lost executors lose nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles and checkpoints that nothing refers to any more: it does when the driver
    collects garbage, what one collection sets free at the next."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
