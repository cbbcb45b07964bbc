"""Balanced contiguous shards by global byte-size prefix sums, in DataFrame functions only.

Rows are ordered by (id, text checksum, size) and dealt into ranges of that order; each range's
total size and row count are summed, the totals' running sums give each range's offset, and a
running sum within the range gives each row's bytes before it.  A row's shard is the equal
part of the whole in which its middle byte falls; slots count the shard's rows from 0.

Defined results: a null text has no bytes, size 1 and the checksum 0 of nothing; null ids come
first; rows that are equal in all three columns share a range and may swap slots among
themselves, which gives the same table; an empty table gives an empty result; extra columns
are ignored by ``shards`` and kept by ``write_shards``, but for one named ``shard``, which is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, scratch
from .order import partitions

SHARDS = 16


def _keys() -> list[Column]:
    """The columns of the order, of a row with a text."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text).cast("long") + 1).alias("size")]


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    with scratch():
        return _shards(docs, n).keep().df


def _shards(docs: DataFrame, n: int) -> Stored:
    sizes = Stored(docs.select(*_keys()), "sizes").df  # texts are read once, for three numbers a row
    ranges = sizes.repartitionByRange(partitions(docs), "doc_id", "text_crc32", "size").withColumn("bucket", F.spark_partition_id())
    rows = Stored(ranges, "ranges").df
    totals = rows.groupBy("bucket").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c"))  # a row for each range
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "bucket", F.coalesce(F.sum("b").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("c").over(order), F.lit(0)).alias("rows_before"), F.sum("b").over(Window.partitionBy()).alias("whole")
    )
    within = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.join(F.broadcast(totals), "bucket")  # as many rows as ranges
    start = F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.select("doc_id", "size", "text_crc32", "whole", start.alias("start"), (F.col("rows_before") + F.row_number().over(within) - 1).alias("rank"))
    shard = F.expr(f"least({n - 1}, (2 * start + size) * {n} div (2 * whole))").cast("int")
    rows = Stored(rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), "rank"), "places").df
    first = rows.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    rows = rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
    return Stored(rows, "shards")


def write_shards(docs: DataFrame, path: str, n: int = SHARDS) -> None:
    """Writes every row of ``docs`` once, with its columns, as Parquet under ``path``/shard=k.  A row finds
    its shard by the least (id, checksum, size) of each shard, ``n`` rows at the driver, so that texts
    are not joined; of rows equal in all three that lie on both sides of a cut, all are in the later shard."""
    if "shard" in docs.columns:
        raise ValueError("a column is named shard")
    key = F.struct("doc_id", "text_crc32", "size")
    with scratch():
        cuts = _shards(docs, n).df.groupBy("shard").agg(F.min(key).alias("k")).orderBy("shard").collect()
    own = F.struct(*_keys())
    shard = F.lit(0)
    for r in cuts:  # a later shard wins
        least = F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(r.k, (docs.schema["doc_id"].dataType, "long", "long"), ("doc_id", "text_crc32", "size"), strict=True)))
        shard = F.when(own >= least, F.lit(r.shard)).otherwise(shard)
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
