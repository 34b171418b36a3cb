"""Documents dealt into even blocks as compressed Arrow streams.

A block is a hash share of the documents, one a shuffle partition, or more where the input's size
asks for them. Each map task packs the
rows it has for a block into one zstd-compressed Arrow stream before the shuffle, which
moves less than half of what the rows would. Every step of one query reads the same exchange.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_keys
from .common import shuffle_partitions

BLOCK_BYTES = 16 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(1).to_numpy()
        order = np.argsort(block, kind="stable")
        ends = [*(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
        rest, names, streams, first = pa.RecordBatch.from_struct_array(batch.column(0)), [], [], 0
        for end in ends:
            part, out = rest.take(pa.array(order[first:end])), io.BytesIO()
            with pa.ipc.new_stream(out, part.schema, options=options) as to:
                to.write_batch(part)
            names.append(int(block[order[first]]))
            streams.append(out.getvalue())
            first = end
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(streams, pa.binary())], names=["block", "stream"])


def blocks_for(docs: DataFrame) -> int:
    """Blocks of some BLOCK_BYTES by the optimizer's figure for the input; 1 where it has none."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return -(-size // BLOCK_BYTES) if size < 1 << 57 else 1


def packed_blocks(docs: DataFrame, *key: Column | str) -> tuple[DataFrame, int]:
    """Rows of (block, stream), one block a partition, and the number of blocks."""
    spark = docs.sparkSession
    n = max(shuffle_partitions(spark), blocks_for(docs))
    names = F.array([F.lit(k) for k in block_keys(spark, n)])
    at = F.get(names, F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), at.alias("block"))
    return rows.mapInArrow(_packed, "block long, stream binary").repartition(n, "block"), n


def opened(table: pa.Table) -> pa.Table:
    """The documents of a block's streams."""
    streams = [pa.ipc.open_stream(s.as_buffer()).read_all() for s in table.column("stream")]
    return pa.concat_tables(streams)
