"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import packed, places, pruned, unpacked

#: Expected copies are whole multiples of 1/UNIT, so that prefix sums are exact; with explicit weights, whose shares may be
#: as small as they like, of 1/2**FINE, with decimal prefix sums.
UNIT = 65536
FINE = 48
#: Buckets of identifiers are as many as keep about PER_BUCKET rows in each, and BUCKETS at least; SPREAD spreads regular ones.
BUCKETS, PER_BUCKET, SPREAD = 1024, 65536, 1103515245


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17, buckets: int | None = None
) -> DataFrame:
    """All columns of docs(doc_id, source, text, ...) and copy_no, a row for each copy drawn.

    A source of weight w gets about w / sum(weights) * epochs * rows of the input; by default w is the square root of
    the source's rows (a flattened mixture). A document of the source expects e copies, e = share / rows. Rows of a
    source are ordered by (bucket of doc_id, doc_id, text); with the prefix sums of e and one random offset u per
    source, a row is emitted once for each whole number that its interval (S - e + u, S + u] holds, copy_no from 1.

    The prefix sum is distributed: rows per (source, bucket) are counted in a narrow scan, their running sums give
    each bucket its start, and positions inside a bucket come from a window over (source, bucket); so a hot source
    is spread over all buckets and texts are shuffled once. Null sources are one source of their own (with a weight
    only by default); a null doc_id counts as bucket 0, first; repeated rows are rows like others; no rows give none.
    A source that `weights` lacks has weight 0; negative, infinite and NaN weights or epochs raise ValueError. All columns of the input stay; where one is called copy_no already, the
    copy's number, always the last column, is called copy_no_2 (or the next that is free).
    """
    fine = weights is not None
    if not all(0 <= x < float("inf") for x in [epochs, *(weights or {}).values()]):
        raise ValueError("weights and epochs must be finite and not negative")
    unit = 1 << FINE if fine else UNIT
    buckets = buckets or max(BUCKETS, -(-docs.count() // PER_BUCKET))
    columns = docs.columns
    taken = {c.lower() for c in columns}
    number = next(n for n in ["copy_no", *(f"copy_no_{i}" for i in range(2, len(columns) + 3))] if n not in taken)
    spread = F.pmod(F.pmod(F.col("doc_id"), F.lit(1 << 31)) * F.lit(SPREAD), F.lit(1 << 31))
    bucket = F.coalesce(F.shiftright(spread * F.lit(buckets), 31), F.lit(0).cast("long"))
    counts = pruned(docs, "doc_id", "source").select(F.col("source").alias("s"), bucket.alias("b")).groupBy("s", "b").agg(F.count("*").alias("c"))
    per_source = counts.groupBy("s").agg(F.sum("c").alias("n"))
    if weights is None:
        weighed = per_source.withColumn("w", F.floor(F.sqrt(F.col("n").cast("double")) * 1e6).cast("double"))
    else:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else None
        w = F.coalesce(F.try_element_at(table, F.col("s")), F.lit(0.0)) if weights else F.lit(0.0)
        weighed = per_source.withColumn("w", F.coalesce(w, F.lit(0.0)))
    # A handful of rows, one per source: totals over them need no partitioning.
    every = weighed.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))
    expected = F.coalesce(F.try_divide("w", "w_all"), F.lit(0.0)) * F.col("n_all").cast("double") * F.lit(float(epochs)) / F.col("n").cast("double") * F.lit(float(unit))
    share = weighed.crossJoin(every).select(
        "s",
        expected.cast("decimal(25,0)").alias("e") if fine else F.floor(expected).cast("long").alias("e"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("s", F.lit("")))), 1, FINE // 4 if fine else 4), 16, 10).cast("long").alias("u"),
    )
    running = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("s", "b", F.coalesce(F.sum("c").over(running), F.lit(0)).alias("before"))
    plan = starts.join(share.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).select(
        F.struct(F.col("s"), F.col("b")).alias("_k"), "before", "e", "u"
    )
    text = F.col(f"_d.c{places(docs, 'text')[0]}")  # within the struct: a column of its own would be shuffled as well
    rows = packed(docs, doc_id="doc_id", source="source").select("_d", "doc_id", F.struct(F.col("source").alias("s"), bucket.alias("b")).alias("_k"))
    inside = Window.partitionBy("_k").orderBy(F.col("doc_id").asc_nulls_first(), text.asc_nulls_first())
    placed = rows.join(plan, "_k").withColumn("_n", F.row_number().over(inside) + F.col("before"))
    if fine:
        whole = lambda c, k: c.cast(f"decimal({k},0)")
        shifted = lambda n: F.call_function("div", whole(n, 12) * F.col("e") + whole(F.col("u"), 15), whole(F.lit(unit), 15))
    else:
        shifted = lambda n: F.shiftright(n * F.col("e") + F.col("u"), 16)
    copies = (shifted(F.col("_n")) - shifted(F.col("_n") - 1)).cast("int")
    drawn = placed.withColumn("_copies", copies).where("_copies > 0")
    each = drawn.select("_d", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_no"))
    return unpacked(each, columns, F.col("_no").alias(number))


def mix_sources_sql(table: str = "documents", seed: int = 17, epochs: float = 1.0) -> str:
    """The same rows, as DuckDB SQL, for the default weights."""
    half = 1 << 31
    bucket = f"coalesce((((doc_id % {half} + {half}) % {half}) * {SPREAD} % {half}) * (SELECT b FROM buckets) >> 31, 0)"
    return f"""
WITH buckets AS (SELECT greatest({BUCKETS}, (count(*) + {PER_BUCKET - 1}) // {PER_BUCKET}) AS b FROM {table}),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY {bucket}, doc_id NULLS FIRST, text NULLS FIRST) AS k FROM {table}),
per_source AS (SELECT source AS s, count(*) AS n FROM {table} GROUP BY 1),
weighed AS (SELECT s, n, floor(sqrt(CAST(n AS DOUBLE)) * 1e6) AS w FROM per_source),
every AS (SELECT sum(w) AS w_all, CAST(sum(n) AS DOUBLE) AS n_all FROM weighed),
share AS (SELECT s, CAST(floor(w / w_all * n_all * CAST({float(epochs)} AS DOUBLE) / CAST(n AS DOUBLE) * CAST({UNIT} AS DOUBLE)) AS BIGINT) AS e,
  CAST('0x' || substr(md5('{seed}|' || coalesce(s, '')), 1, 4) AS BIGINT) AS u FROM weighed, every),
drawn AS (
  SELECT p.* EXCLUDE (k), (k * e + u) // {UNIT} - ((k - 1) * e + u) // {UNIT} AS copies
  FROM placed p JOIN share ON p.source IS NOT DISTINCT FROM share.s)
SELECT * EXCLUDE (copies), CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy_no FROM drawn WHERE copies > 0"""
