"""Exchanges of sorted keys between blocks of documents and buckets of keys.

A block is a hash share of the documents, one a shuffle partition; a bucket is a range of
64-bit keys. A block sends each bucket the sorted distinct keys it holds in that range, and
gets back one bit a key. So a key that a third of all documents hold costs one entry a block,
not one a document, and no bucket holds more than its range of the distinct keys of each
block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def block_keys(spark, n: int) -> list[int]:
    """One integer for each of ``n`` hash partitions, so that blocks fill partitions evenly."""
    found: dict[int, int] = {}
    most = 16 * n + 64
    while len(found) < n:
        rows = spark.range(most).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
        found, most = {r["p"]: r["id"] for r in rows}, 2 * most
    return [found[p] for p in range(n)]


def give_back() -> None:
    """Memory that a worker has freed, back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted 64-bit keys pass from one bucket to the next: buckets + 1 places."""
    edges = np.array([(r << 64) // buckets for r in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def joined_bits(replies: dict[int, bytes], at: np.ndarray) -> np.ndarray:
    """The bits of all buckets in the order of the block's keys."""
    parts = [unpack(replies[r], int(at[r + 1] - at[r])) for r in range(len(at) - 1) if at[r + 1] > at[r]]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def rows(**columns: tuple[list, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def texts(table: pa.Table, id_column: str = "doc_id", text_column: str = "text") -> Iterator[tuple[int | None, bytes]]:
    for doc, text in zip(table.column(id_column), table.column(text_column), strict=True):
        yield doc.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass")
