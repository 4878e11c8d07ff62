"""Tables in shared storage that end a lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext
    if not app.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if app.applicationId not in _OWN:
        _OWN[app.applicationId] = "file://" + tempfile.mkdtemp(prefix="rillflow-")
    return _OWN[app.applicationId]


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`df` as a written table, and its path."""
    path = f"{shared_root(df.sparkSession).rstrip('/')}/rillflow/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Take a written table away once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """The written state of an iteration: a new round takes the one before away."""

    def __init__(self, first: DataFrame, label: str):
        self.label = label
        self.now, self.path = written(first, label)

    def step(self, df: DataFrame) -> None:
        before = self.path
        self.now, self.path = written(df, self.label)
        delete(df.sparkSession, before)
