"""Python functions of columns, a piece of a batch at a time.

A worker gets batches of up to 10,000 rows or 64 MB. All their texts as Python strings, with all
results, would be many times that for each core. Here a batch stays packed as Arrow: its rows are
unpacked one by one, and results leave as soon as they make a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: A piece ends with the row that brings it to so many rows, or its texts to so many characters.
MOST_ROWS, MOST_CHARS = 500, 1 << 18


def results(batches: Iterable[tuple[pa.Array, ...]], f: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """``f`` of each row, in order."""
    for columns in batches:
        out, chars = [], 0
        for row in zip(*columns, strict=True):
            values = [x.as_py() for x in row]
            out.append(f(*values))
            chars += sum(len(x or "") for x in values)
            if len(out) == MOST_ROWS or chars >= MOST_CHARS:
                yield pa.array(out, kind)
                out, chars = [], 0
        if out:
            yield pa.array(out, kind)
        del columns


def by_row(f: Callable, kind: str, *texts: Column | str) -> Column:
    """``f`` of strings or nulls, as a column of the type ``kind``."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def of_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return results(((x,) for x in batches), f, arrow)

    def of_many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return results(batches, f, arrow)

    return F.arrow_udf(of_one if len(texts) == 1 else of_many, kind)(*texts)
