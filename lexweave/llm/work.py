"""Written tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import release


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI. Without that setting a local session gets a temporary folder of this process; a cluster,
    whose executors wouldn't share it, gets an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="lexweave-"))
        base = _OWN[0]
    return (base if "://" in base else "file://" + base).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexweave/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table of the shared folder and reads it back: its lineage ends there,
    and losing an executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._lexweave_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that `saved` wrote and that nothing reads any more."""
    path = getattr(df, "_lexweave_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch, about: rows of long texts mustn't add up to more than a worker can hold.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def pruned(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, by exact name where the case of several agrees; other columns, whatever
    they are called, play no part. Arrow batches of the session are bounded by bytes from here on, unless it has
    set a bound of its own."""
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))
    return _numbered(df).select(*[F.col(f"c{i}").alias(n) for n, i in zip(names, places(df, *names), strict=True)])


def places(df: DataFrame, *names: str) -> list[int]:
    """Where the columns of exactly these names stand (the first, where a name is there twice)."""
    for n in names:
        if n not in df.columns:
            raise ValueError(f"column {n!r} is missing; there are {df.columns}")
    return [df.columns.index(n) for n in names]


def _numbered(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def tidy(f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after which the worker gives freed memory back: it may wait idle while others need it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def through(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df with its rows replaced by those of f, which keeps the columns; their names may clash."""
    own = _numbered(df)
    return own.mapInArrow(tidy(f), own.schema).toDF(*df.columns)


def packed(df: DataFrame, **names: str) -> DataFrame:
    """All columns of df as the struct _d, whatever they are called, and beside it columns of their own: new name = name in df."""
    at = dict(zip(names, places(df, *names.values()), strict=True))
    each = F.struct(*[F.col(f"c{i}") for i in range(len(df.columns))])
    return _numbered(df).select(each.alias("_d"), *[F.col(f"c{i}").alias(n) for n, i in at.items()])


def unpacked(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The columns that `packed` put into _d, under their names, and more."""
    return df.select(*[F.col(f"_d.c{i}").alias(c) for i, c in enumerate(columns)], *more)


#: Rows of one identifier that are sent to every executor at most; beyond it both sides are shuffled.
MOST_SENT = 1_000_000


def sent_if_small(ids: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A narrow written table, marked for broadcast once it has been counted and found small."""
    return F.broadcast(ids) if ids.count() <= most else ids
