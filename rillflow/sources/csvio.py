"""Commented CSV: `#` header lines with key: value pairs, then column names and rows."""

from __future__ import annotations

import csv
import io
import itertools
import os
import re
import uuid
import zipfile
from collections.abc import Iterable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.lineage import shared_root


def header_comments(lines: list[str]) -> dict[str, str]:
    """key -> value of comment lines; lines without a colon in their first 30 characters are numbered."""
    out: dict[str, str] = {}
    for line in lines:
        text = re.sub(r"^#+\s*", "", line).strip()
        if not text or re.fullmatch(r"[-#\s]*", text):
            continue
        if ":" in text[:30]:
            key, _, value = text.partition(":")
            key, value = re.sub(r"\s+", "_", key.strip().lower()), value.strip()
        else:
            key, value = f"comment_{sum(k.startswith('comment_') for k in out) + 1:02d}", text
        if value:
            out[key] = value
    return out


def clean_name(name: str) -> str:
    """Column names without dots; ('a', 'b') becomes a-b."""
    name = name.strip().strip('"')
    if re.fullmatch(r"\(.*\)", name):
        name = "-".join(p.strip().strip("'\"") for p in name[1:-1].split(","))
    return name.replace(".", "_")


def find_file(path: str) -> str:
    """The file, or its stem with .gz, .zip, .csv or .csv.gz."""
    if os.path.exists(path):
        return path
    for end in (".gz", ".zip", ".csv", ".csv.gz"):
        if os.path.exists(found := re.sub(r"\.[^./]*$", "", path) + end):
            return found
    raise ValueError(f"no file {path}")


def _members(spark: SparkSession, path: str, member: str | None) -> DataFrame:
    """Lines (n, value) of a member of a zip file."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member or z.namelist()[0]) as f:
                    lines, n = io.TextIOWrapper(f, "utf-8", "replace"), 0
                    while part := [line.rstrip("\r\n") for line in itertools.islice(lines, 10_000)]:
                        yield pd.DataFrame({"n": range(n, n + len(part)), "value": part})
                        n += len(part)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "n long, value string")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, names: list[str] | None = None, has_names: bool = True, member: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The table and its comments, of a plain, gzip or zip file. `schema` is recommended for large files."""
    zipped = path.endswith(".zip") or member is not None
    lines = _members(spark, path, member) if zipped else spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    comment = F.col("value").startswith("#")
    rows = lines.where(~comment & (F.length(F.trim("value")) > 0))
    first = rows.agg(F.min(F.struct("n", "value"))).first()[0]
    # only what stands before the first row is the head
    head = lines.where(comment if first is None else comment & (F.col("n") < first["n"]))
    comments = header_comments([r["value"] for r in head.orderBy("n").collect()])
    reader = spark.read.option("header", has_names and not zipped).option("comment", "#")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    if zipped:
        if has_names and first is not None:
            rows = rows.where(F.col("n") != first["n"])
            names = names or next(csv.reader([first["value"]]))
        # the member's rows as a text table, which the reader of plain files then takes
        extracted = f"{shared_root(spark).rstrip('/')}/rillflow/csv-{uuid.uuid4().hex}"
        rows.select("value").write.text(extracted)
        df = reader.csv(extracted)
    else:
        df = reader.csv(path)
    return df.toDF(*[clean_name(c) for c in (names or df.columns)]), comments


def csv_head(nrow: int, ncol: int, comment, source_file: str, author: str | None = None) -> list[str]:
    """Comment lines of a file: its size, the comments in order of their keys, time, author and source."""
    if isinstance(comment, str):
        comment = {"comment": comment}
    elif not isinstance(comment, dict):
        comment = {f"comment_{i + 1:02d}": c for i, c in enumerate(comment)}
    rows = {"nrow": nrow, "ncol": ncol, **dict(sorted(comment.items())), "time_generated": datetime.now().isoformat(timespec="seconds"), "author": author or "unknown", "source_file": source_file}
    return ["# " + "-" * 50, *(f"# {k} : {v}" for k, v in rows.items()), "# " + "-" * 50]


def write_csv(df: DataFrame, path: str, comment, source_file: str, author: str | None = None, compress: bool = True, digits: int = 5, archive: zipfile.ZipFile | None = None) -> None:
    """A result as one commented file, zipped by default, or as a member of an archive.

    The rows come to the driver a partition at a time and are written as they come.
    """
    import pandas as pd

    if not os.path.exists(source_file):
        raise ValueError(f"no source file {source_file}")
    df = df.persist(StorageLevel.DISK_ONLY)
    head = "\n".join(csv_head(df.count(), len(df.columns), comment, source_file, author)) + "\n"

    def parts():
        yield head + pd.DataFrame(columns=df.columns).to_csv(index=False)
        rows = df.toLocalIterator(prefetchPartitions=True)
        while part := list(itertools.islice(rows, 10_000)):
            yield pd.DataFrame(part, columns=df.columns).to_csv(index=False, header=False, float_format=f"%0.{digits}f")

    if archive is not None:
        write_member(archive, os.path.basename(path), parts())
    elif compress:
        with zipfile.ZipFile(re.sub(r"\.csv$", "", path) + ".zip", "w", zipfile.ZIP_DEFLATED) as z:
            write_member(z, os.path.basename(path), parts())
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(parts())
    df.unpersist()


def write_member(archive: zipfile.ZipFile, name: str, text: str | Iterable[str]) -> None:
    """A member of the archive from a text or its parts."""
    if name in archive.namelist():
        raise ValueError(f"the archive already has {name}")
    info = zipfile.ZipInfo(name)
    info.external_attr, info.compress_type = 0o777 << 16, archive.compression
    with archive.open(info, "w", force_zip64=True) as f:
        for part in [text] if isinstance(text, str) else text:
            f.write(part.encode())


def write_html(df: DataFrame, path: str, title: str, comment: str = "", author: str = "", limit: int = 1000) -> None:
    """The first `limit` rows, which a page can show, as an HTML report."""
    table = df.limit(limit).toPandas().to_html(index=False)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>{comment}</p><p>{author}</p>{table}</body></html>")
