"""Task tables: option products, batches of sites, searches."""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def option_product(spark: SparkSession, **options) -> DataFrame:
    """taskid and a column for each option: all combinations, the last option running fastest."""
    lists = {k: [v] if isinstance(v, (str, int, float)) else list(v) for k, v in options.items()}
    kinds = ", ".join(f"{k} {({str: 'string', bool: 'boolean', int: 'long'}).get(type(v[0]), 'double')}" for k, v in lists.items())
    return spark.createDataFrame([(i, *row) for i, row in enumerate(product(*lists.values()))], f"taskid long, {kinds}")


def batches(df: DataFrame, key: str, n: int) -> DataFrame:
    """`df` with `batch` 0..n-1 in order of the key: sizes differ by one at most, the first ones larger."""
    return df.withColumn("batch", F.ntile(n).over(Window.orderBy(key)) - 1)


def get_batch(nelements: int, nbatch: int, ibatch: int) -> range:
    """Places of one batch by the same rule."""
    if not 0 <= ibatch < nbatch <= nelements:
        raise ValueError("expected 0 <= ibatch < nbatch <= nelements")
    small, more = divmod(nelements, nbatch)
    start = ibatch * small + min(ibatch, more)
    return range(start, start + small + (ibatch < more))


def search(tasks: DataFrame, exact: bool = False, **patterns: str) -> DataFrame:
    """Tasks whose options match regular expressions, anywhere or as a whole."""
    for k, p in patterns.items():
        tasks = tasks.where(F.col(k).cast("string").rlike(f"^(?:{p})$" if exact else p))
    return tasks


def match(tasks: DataFrame, task: dict, exclude: list[str] = ()) -> DataFrame:
    """Tasks with the same options as `task`, but for the excluded ones."""
    for k, v in task.items():
        if k not in exclude and k != "taskid":
            tasks = tasks.where(F.col(k) == v)
    return tasks


def to_json(tasks: DataFrame) -> str:
    return json.dumps([r.asDict() for r in tasks.orderBy("taskid").collect()])


def from_json(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(json.loads(text))
