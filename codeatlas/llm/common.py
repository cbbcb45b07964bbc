"""Shared pieces: tables in the cluster's shared folder, Arrow mapping, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Largest id list, in rows, that is broadcast; above it the same join is shuffled.
BROADCAST_IDS = 2_000_000
#: Bytes of rows that a Python worker holds as lists at once.
AT_ONCE = 1 << 22
#: Arrow batches while a table is stored.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}
#: A key is hot above this number of rows, and above one in HOT_SHARE of all: so hot keys are at most HOT_SHARE.
HOT_ROWS, HOT_SHARE = 1000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a local temporary
    folder only where that is unset and the master is a single local JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="codeatlas-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: The tables of each open ``scratch``, the innermost last.
_scratches: list[list[Stored]] = []


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches for the jobs inside; the session's settings are as before at the end."""
    before = {k: spark.conf.get(k) for k in ARROW}
    for k, v in ARROW.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Stored:
    """A DataFrame written once as Parquet in the shared folder, so that lost
    executors cost a re-read and not a re-run; ``drop`` deletes the files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/codeatlas/{name}-{uuid.uuid4().hex}"
        with small_batches(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _scratches:
            _scratches[-1].append(self)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        for tables in _scratches:
            if self in tables:
                tables.remove(self)

    def keep(self) -> Stored:
        """Leaves the table to whoever opened the scratch around the innermost one."""
        if _scratches and self in _scratches[-1]:
            _scratches[-1].remove(self)
            if len(_scratches) > 1:
                _scratches[-2].append(self)
        return self


@contextmanager
def scratch() -> Iterator[None]:
    """Drops the tables stored inside it at its end, but those that were kept: the rows that a caller
    gets must come from a kept table."""
    _scratches.append([])
    try:
        yield
    finally:
        for table in list(_scratches[-1]):
            table.drop()
        _scratches.pop()


def release() -> None:
    """Gives a Python worker's free memory back: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def releasing(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over a task's batches; free memory is given back before them, when the functions of the
    task before are gone, and after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes, or of a single row."""
    if batch.nbytes <= most or batch.num_rows <= 1:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from parts(batch.slice(0, half), most)
        yield from parts(batch.slice(half), most)


def map_columns(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str, most: int = AT_ONCE) -> DataFrame:
    """``mapInArrow`` for ``fn``, a function from an iterator of {column: list} to
    an iterator of {column: list or array}; the lists hold at most about ``most`` bytes, or a single
    row.  Spark bounds the batches it sends by spark.sql.execution.arrow.maxBytesPerBatch."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(n).to_pylist() for n in b.schema.names} for whole in batches for b in parts(whole, most))
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(releasing(run), schema)


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of wide rows with the ids in ``ids[key]``.  The ids are broadcast
    if they are at most BROADCAST_IDS rows (8 bytes each), which spares a shuffle of the
    wide rows; else both sides are shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def hot_above(rows: DataFrame) -> int:
    """A key of ``rows``, a stored table, is hot if it has more rows than this."""
    return max(HOT_ROWS, rows.count() // HOT_SHARE)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key) of the hot keys of ``rows``, a stored table: at most HOT_SHARE, whatever its size."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_above(rows)).select(key)


def look_up(rows: DataFrame, table: DataFrame, key: str, how: str, hot: DataFrame | None = None) -> DataFrame:
    """``rows.join(table, key, how)``, inner, left or left_semi, for a ``table`` with a row a key, without a
    task that gets all rows of a hot key: the hot keys' rows of ``table`` are broadcast, only the
    others' are shuffled.  ``rows`` is a stored table, read twice."""
    hot = F.broadcast(hot_keys(rows, key) if hot is None else hot)
    some = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(some, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))


def components(links: DataFrame, a: str = "a", b: str = "b") -> Stored:
    """Connected components of undirected ``links``: a stored table (v, c) for every linked vertex,
    c the smallest vertex reachable.  Labels take the least label among neighbours and
    then jump to their label's label, so that the rounds grow with the logarithm of the
    longest chain; they end when every vertex has its neighbours' label.  Every round is a table in the
    shared folder.  Vertices of many links and labels of many vertices are looked up by broadcast."""
    with scratch():
        edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        edges = Stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges").df
        stored = Stored(edges.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")).select("v", F.least("v", "m").alias("c"), "n"), "labels")
        hubs = Stored(stored.df.filter(F.col("n") > hot_above(edges)).select("v"), "hubs").df
        while True:
            stored.df = stored.df.select("v", "c")
            near = look_up(edges, stored.df, "v", "inner", hubs).groupBy("u").agg(F.min("c").alias("n"))
            new = stored.df.join(near, F.col("v") == F.col("u")).select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
            least = Stored(new, "least")
            if not least.df.filter("c <> old").limit(1).count():
                return stored.keep()
            jump = stored.df.select(F.col("v").alias("c"), F.col("c").alias("to"))
            new = look_up(least.df, jump, "c", "left").select("v", F.least("c", F.coalesce("to", "c")).alias("c"))
            after = Stored(new, "labels")
            stored.drop()
            least.drop()
            stored = after


def keep_rows(df: DataFrame, decide: Callable[[list], list[bool]], key: str = "text", chars: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` that ``decide`` keeps by their texts, asked in turns of about
    ``chars`` characters.  Rows pass through Arrow as they are, whatever their columns."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in parts(whole, AT_ONCE)):
            texts, keep, lo, size = batch.column(key).to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= chars or i == len(texts) - 1:
                    keep += decide(texts[lo : i + 1])
                    lo, size = i + 1, 0
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return df.mapInArrow(releasing(run), df.schema)
