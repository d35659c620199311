"""Arrow batches in Python functions: of bounded size, and read into Python values column by column."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of an Arrow batch, about: long texts mustn't add up to more than a worker can hold.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of the session are bounded by bytes from here on, unless it has set a bound of its own."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def pieces(arrays: tuple[pa.Array, ...], most: int = BATCH_BYTES // 4) -> Iterator[tuple[pa.Array, ...]]:
    """Consecutive slices of arrays of one length, of about `most` bytes in all."""
    n = len(arrays[0])
    step = max(1, int(n * most / max(1, sum(a.nbytes for a in arrays))))
    for i in range(0, n, step):
        yield tuple(a.slice(i, step) for a in arrays)


def values(a: pa.Array) -> list:
    """The array's values as Python's: structs as dicts, lists as lists, maps as lists of pairs."""
    if pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        rows = [dict(zip(names, row, strict=True)) for row in zip(*map(values, a.flatten()), strict=True)]
        return rows if not a.null_count else [r if ok else None for r, ok in zip(rows, a.is_valid().to_pylist(), strict=True)]
    if pa.types.is_map(a.type) or pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        ends = a.offsets.to_pylist()
        if not ends:
            return []
        first, last = ends[0], ends[-1]
        if pa.types.is_map(a.type):
            flat = list(zip(values(a.keys.slice(first, last - first)), values(a.items.slice(first, last - first)), strict=True))
        else:
            flat = values(a.values.slice(first, last - first))
        rows = [flat[s - first : e - first] for s, e in zip(ends, ends[1:], strict=False)]
        return rows if not a.null_count else [r if ok else None for r, ok in zip(rows, a.is_valid().to_pylist(), strict=True)]
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) or pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type):
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def by_row(f: Callable, returns: DataType | str) -> Callable[..., Column]:
    """A function of rows' values as one of columns; its results may be nested as `values` gives them (maps as lists of pairs)."""
    kind = DataType.fromDDL(returns) if isinstance(returns, str) else returns
    arrow = to_arrow_type(kind)

    def made(f: Callable, rows: Iterator[tuple]) -> pa.Array:
        """Python's search for cycles, which costs a third of the time while objects pile up, waits for the end of the piece."""
        gc.disable()
        try:
            return pa.array([f(*x) for x in rows], arrow)
        finally:
            gc.enable()

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            for (part,) in pieces((a,)):
                yield made(f, zip(values(part), strict=True))

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            for part in pieces(arrays):
                yield made(f, zip(*map(values, part), strict=True))

    # Evaluated once, where it stands: else a filter that the optimizer infers from an explode would evaluate it again.
    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else many, kind, ArrowUDFType.SCALAR_ITER).asNondeterministic()(*columns)
