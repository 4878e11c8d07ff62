"""Shared-storage, ordering and caching helpers of the corpus operators."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.lineage import shared_root


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder that the cluster names in spark.checkpoint.dir."""
    root = shared_root(spark)
    # a name without a scheme is one of the cluster's default store, for Spark and Arrow alike
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file://"):
        full = "file://" + full[len("file:") :]
    return f"{full.rstrip('/')}/rillflow/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to shared storage and read it back: the lineage ends at files all executors see."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch; a text longer than `size` is a batch of its own.

    A plan reads this when it runs, so the session keeps it; results don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slices(batch: pa.RecordBatch, place: int, size: int = 1 << 20):
    """`batch` in slices of about `size` bytes of the string column at `place`, so that work on a slice has a bounded memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """A memo bounded by bytes: computes a missing value, starts again when about `limit` bytes are held.

    An entry counts 150 bytes and 8 for each character; a key of more than LONG is computed each time.
    """

    LONG = 4096

    def __init__(self, compute, limit: int = 80_000_000):
        super().__init__()
        self.compute, self.limit, self.held = compute, limit, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.LONG:
            if self.held >= self.limit:
                self.clear()
            self.held += 150 + 8 * len(key)
            self[key] = value
        return value

    def clear(self):
        super().clear()
        self.held = 0


#: Most id ranges of a table: the driver and every task hold a bound of each.
MOST_RANGES = 10_000


def ranges_for(size: int, per_range: int, most: int = MOST_RANGES) -> int:
    """How many ranges a table of `size` bytes is dealt to."""
    return max(1, min(most, -(-size // per_range)))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that `df` reads, as Catalyst knows them without a scan; a sum over the rows' texts where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if known < 1 << 52:
        return known
    texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind == "string"]
    return sum(n or 0 for n in df.agg(*texts).first()) if texts else 0


@dataclass
class IdRanges:
    """Ranges in ascending order of id, null first; a null or repeated id with many rows has several, by a hash of the text."""

    bounds: np.ndarray
    #: Of each stretch between bounds (0: null): its first range and how many it has.
    first: np.ndarray
    parts: np.ndarray

    @property
    def count(self) -> int:
        return int(self.first[-1] + self.parts[-1])

    def of(self, ids: pa.Array, texts: list[bytes]) -> np.ndarray:
        """The range of each row."""
        known = np.asarray(ids.is_valid())
        values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.where(known, np.searchsorted(self.bounds, values, side="right") + 1, 0)
        out = self.first[at].astype(np.int32)
        for k in np.flatnonzero(self.parts[at] > 1).tolist():
            out[k] += int.from_bytes(tie(texts[k])[:8], "big") * int(self.parts[at[k]]) >> 64
        return out


def tie(text: bytes) -> bytes:
    """What orders rows of equal ids."""
    return hashlib.sha256(text).digest()


def id_ranges(df: DataFrame, id_col: str, ranges: int) -> IdRanges:
    """About `ranges` ranges of an integer column, near its quantiles."""
    marks: list[int] = []
    if ranges > 1:
        marks = [int(np.ceil(m)) for m in df.select(F.col(id_col).cast("double").alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.2 / ranges)]
    many = [x for x, n in Counter(marks).items() if n > 1]  # a range of its own
    bounds = np.array(sorted({*marks, *(x + 1 for x in many)}), np.int64)
    parts = np.ones(len(bounds) + 2, np.int64)
    if ranges > 1:
        kind = F.when(F.col(id_col).isNull() | F.col(id_col).isin(many), F.struct(id_col))
        rows = df.groupBy(kind.alias("own")).agg(F.count("*").alias("n")).collect()
        share = sum(r["n"] for r in rows) / ranges
        for r in rows:
            if r["own"] is not None:
                at = 0 if r["own"][0] is None else int(np.searchsorted(bounds, r["own"][0], side="right")) + 1
                parts[at] = max(1, round(r["n"] / share))
    return IdRanges(bounds, np.cumsum(parts) - parts, parts)


def create_file(uri: str):
    """A stream that writes a file of any store that Arrow can open."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # the bytes as they are, whatever the name ends with


def read_file(uri: str) -> bytes:
    """Contents of a file that `create_file` wrote."""
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()
