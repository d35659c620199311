"""Incremental ingestion: files arrive as a stream, are split, and their units upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import memory, segmentation


def documents(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def sentences(stream: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> DataFrame:
    """The stream of sentences (a stateless explode)."""
    rows = stream.withColumns({"id": F.col(id).cast("string"), "plain": F.col(text)})
    return segmentation.split_segments(rows, lang=lang).select(id, lang, "id", "part_no", "plain")


def once(stream: DataFrame, time: str, id: str = "doc_id", late: str = "10 minutes") -> DataFrame:
    """The stream without rows delivered again within `late` of each other; state is dropped behind the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id])


#: Parts of a stored memory, by its key; a batch rewrites those that it touches.
BUCKETS = 64


def upsert_into(table: str, units: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: units(batch) are stored into the versioned Parquet table below `table`.

    A batch writes the next version of the buckets that its keys fall into, as one folder that counts once its _SUCCESS is there;
    a batch that is repeated after a failure starts from the versions before it and writes its own again, so it counts
    once. What nobody can need any more (versions before the one a repeat would start from) is deleted."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*memory.KEY), F.lit(buckets)).cast("int")
        new = memory.prepared(units(batch)).withColumn("_bucket", bucket).persist()
        try:
            touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # `buckets` at most
            if not touched:
                return
            before = current(spark, table, batch_id, touched)
            merged = memory.upsert(new.drop("_bucket")) if before is None else memory.stored(before, new.drop("_bucket"))
            merged.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/v{batch_id:012d}")
            fs, path = _files(spark, table)
            for k, ids in _versions(spark, table).items():
                for old in [i for i in ids if i < batch_id][:-1]:
                    fs.delete(path(f"{table}/v{old:012d}/_bucket={k}"), True)
        finally:
            new.unpersist()

    return store


def _files(spark: SparkSession, table: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    return path(table).getFileSystem(conf), path


def _versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """Of each bucket the batches that wrote it, in order; unfinished ones don't count."""
    fs, path = _files(spark, table)
    out: dict[int, list[int]] = {}
    if fs.exists(path(table)):
        for name in sorted(s.getPath().getName() for s in fs.listStatus(path(table))):
            if name.startswith("v") and fs.exists(path(f"{table}/{name}/_SUCCESS")):
                for s in fs.listStatus(path(f"{table}/{name}")):
                    if s.getPath().getName().startswith("_bucket="):
                        out.setdefault(int(s.getPath().getName()[8:]), []).append(int(name[1:]))
    return out


def current(spark: SparkSession, table: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest version of each bucket (of the given ones; the newest before a batch); None if there is none."""
    newest = {}
    for k, ids in _versions(spark, table).items():
        ids = [i for i in ids if before is None or i < before]
        if ids and (buckets is None or k in buckets):
            newest[k] = ids[-1]
    return spark.read.parquet(*[f"{table}/v{i:012d}/_bucket={k}" for k, i in sorted(newest.items())]) if newest else None


def start(stream: DataFrame, table: str, units: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(upsert_into(table, units)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def write_back(stream: DataFrame) -> DataFrame:
    """Exact write-back in order of arrival: per languages and normalised source the first target given serves every later segment
    without one. `stream` has src_lang, tgt_lang, source_norm, seg_no (long), source_text, target_text."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        for b in batches:
            b = b.sort_values("seg_no")
            targets = []
            for t in b["target_text"]:
                known = known if known is not None else t
                targets.append(t if t is not None else known)
            yield pd.DataFrame({"src_lang": key[0], "tgt_lang": key[1], "source_norm": key[2], "seg_no": b["seg_no"], "target_text": targets})
        if known is not None:
            state.update((known,))

    out = "src_lang string, tgt_lang string, source_norm string, seg_no long, target_text string"
    return stream.groupBy("src_lang", "tgt_lang", "source_norm").applyInPandasWithState(step, out, "target string", "append", GroupStateTimeout.NoTimeout)


def issues_per_window(issues: DataFrame, time: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    return issues.withWatermark(time, late).groupBy(F.window(time, size), "check_id", "severity").agg(F.count("*").alias("n"))
