"""What a session needs before Python code runs on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python
    workers can import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="codeatlas-code-"), "codeatlas.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith((".py", ".json")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("codeatlas", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a temporary one only in a local session
    without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeatlas-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df):
    """Cuts a DataFrame's lineage with a checkpoint in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: While a table is stored: its shuffle files go when it is written, and joins hash sides that are small in
#: every partition; larger ones are sorted, which can spill.
STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


class Table:
    """A DataFrame written once as Parquet in the folder that the cluster shares, and deleted by ``drop``; the
    session's settings are as before afterwards."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in STORING}
        try:
            for k, v in STORING.items():
                conf.set(k, v)
            df.write.parquet(self.path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
