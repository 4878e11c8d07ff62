"""WARC archives of web pages, and a reader that salvages what damage leaves.

Writing: one record a page, each a gzip member of its own. Of pages with an equal payload of at
least `least` bytes the one with the largest id is the response; the others are revisit records
that name it.

Reading: each member is decompressed and its record checked (CRC, version line, header, length,
block digest). When a check fails, the reader searches for the next valid member (or, in an archive
that isn't compressed, the next valid version line), goes on from there, and logs the gap as
quarantined: file, first and last byte, reason. Files have a bounded size, and one is read at a time.
`read_archives` writes the gaps of its pass to the folder's quarantine table, with the number of records
that the manifest has and the archive hasn't; an archive that only lost its end has a row there too.

Defined results: a null html is an empty payload; repeated rows give a record each
(responses all, if theirs is the largest id); rows with a null id are written, and count below all
others; an empty table gives no archive and no rows;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import MOST_RANGES, create_file, materialize, read_file, scratch, small_batches, texts_of

ARCHIVE_BYTES = 8_000_000
VERSION = b"WARC/1.1"
#: Of a revisit, as the payload isn't there: the length of the full one.
FULL_LENGTH = "X-Full-Payload-Length"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GAPS = "path string, start long, stop long, reason string, missing long"
KINDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record; of a revisit the block has the HTTP header only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(page),
        "WARC-Date": date,
        "WARC-Target-URI": "".join(c for c in url or "" if c >= " "),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to), FULL_LENGTH: str(len(payload))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Damaged(ValueError):
    pass


def _parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at `at`, with its end; raises Damaged."""
    stop = data.find(b"\r\n\r\n", at)
    if not data.startswith(b"WARC/1.", at) or stop < 0:
        raise Damaged("no version line")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("a header line without colon")
        head[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    try:
        size = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no content length") from None
    block = data[stop + 4 : stop + 4 + size]
    if size < 0 or len(block) < size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
        raise Damaged("the block's length is wrong")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise Damaged("the block's digest is wrong")
    return head | {"block": block}, stop + 8 + size


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member that begins at `at` yields, its end, and why it is damaged ("" if it isn't)."""
    d, raw, begin = zlib.decompressobj(31), [], at
    while not d.eof:
        part = data[at : at + (1 << 16)]
        if not part:
            return b"".join(raw), at, "gzip: the member is cut off"
        try:
            raw.append(d.decompress(part))
        except zlib.error as e:
            return _until_error(data, begin, at, len(part)), at, f"gzip: {e}"[:80]
        at += len(part)
    return b"".join(raw), at - len(d.unused_data), ""


def _until_error(data: bytes, begin: int, at: int, size: int) -> bytes:
    """The member's bytes before the error, which a failing call of zlib doesn't return."""
    d = zlib.decompressobj(31)
    raw = [d.decompress(data[begin:at])]
    try:
        for k in range(at, at + size):
            raw.append(d.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(raw)


def _records(data: bytes, digested: bool = False) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Records of inflated bytes and the gaps between them; if `digested`, only those with a block digest."""
    records, gaps, at, bad, why = [], [], 0, None, ""
    while at < len(data):
        try:
            one, after = _parse(data, at)
            if digested and "warc-block-digest" not in one:
                raise Damaged("no block digest in a damaged member")
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            at = data.find(VERSION[:7], at + 1)
            if at < 0:
                break
            continue
        if bad is not None:
            gaps.append((bad, at, why))
            bad = None
        records.append(one)
        at = after
    if bad is not None:
        gaps.append((bad, len(data), why))
    return records, gaps


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Records of an archive's bytes, and its quarantined gaps (first byte, byte after, reason).

    A gap within an intact gzip member is given as the member, with the inflated bytes in the reason.
    """
    magic = b"\x1f\x8b\x08"
    if not (data[:2] == magic[:2] or VERSION[:7] not in data[:1024] and magic in data):
        return _records(data)
    records, gaps, at, bad, why = [], [], 0, None, ""
    while at < len(data):
        raw, after, error = _inflate(data, at)
        found, holes = _records(raw, bool(error))
        records += found
        if error or not raw:
            if bad is None:
                bad, why = at, error or "an empty member"
            at = data.find(magic, at + 1)
            if at < 0:
                break
            continue
        if bad is not None:
            gaps.append((bad, at, why))
            bad = None
        gaps += [(at, after, f"{reason} (inflated bytes {a} to {b})") for a, b, reason in holes]
        at = after
    if bad is not None:
        gaps.append((bad, len(data), why))
    return records, gaps


def write_archives(df: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write a record for each row of `df`; returns the archives' folder."""
    spark = df.sparkSession
    small_batches(spark)
    folder = scratch(spark, "warc")
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # one row for each payload, merged on the map side
    winners = pages.groupBy("sha", "size").agg(F.max("page_id").alias("first"))
    # a table of its own, so that adaptive execution can split the rows of a common payload
    winners = materialize(winners, "winners")
    response = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("size") < least)
    told = pages.join(winners, ["sha", "size"]).select("page_id", "url", "payload", response.alias("response"), "first")

    def run(batches):
        done, out, size = [], [], 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.gz"
            with create_file(f"{folder}/archives/{name}") as f:
                for part in out:
                    f.write(part)
            done.append((name, len(out), size))

        for b in batches:
            urls = b.column(1).to_pylist()
            for page, url, payload, response, first in zip(b.column(0).to_pylist(), urls, b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                out.append(member(record(page, url, payload) if response else record(page, url, payload, first, True)))
                size += len(out[-1])
                if size > ARCHIVE_BYTES:
                    close()
                    out, size = [], 0
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["name", "records", "bytes"])

    told.mapInArrow(run, "name string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return folder


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each archive that a finished task wrote."""
    return spark.read.schema("name string, records long, bytes long").parquet(f"{folder}/manifest")


def _quarantine(folder: str, path: str, gaps: list[tuple[int, int, str]], size: int, missing: int) -> None:
    """Write an archive's gaps; a repeated task writes the same file again."""
    rows = [(path, *gap, missing) for gap in gaps or [(size, size, "the manifest has another count, and no gap is seen")]]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    with create_file(f"{folder}/quarantine/{path.rpartition('/')[2]}.parquet") as f:
        pq.write_table(pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in GAPS.split(", ")]), f)


def _read(archives: DataFrame, with_payload: bool, folder: str) -> DataFrame:
    """Records of the archives of a manifest (name, records); a task opens an archive at a time."""

    def run(batches):
        for b in batches:
            for name, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                body, rows = read_file(f"{folder}/archives/{name}"), []
                records, gaps = salvage(body)
                missing = count - len(records)
                if gaps or missing:
                    _quarantine(folder, f"{folder}/archives/{name}", gaps, len(body), missing)
                for r in records:
                    payload = r["block"].partition(b"\r\n\r\n")[2]
                    kind = r.get("warc-type", "")
                    size = len(payload) if kind == "response" else int(r.get(FULL_LENGTH.lower(), 0))
                    bare = r.get("warc-payload-digest", "").rpartition(":")[2]
                    to = _page(r["warc-refers-to"]) if kind == "revisit" and "warc-refers-to" in r else None
                    rows.append((_page(r.get("warc-record-id", "")), r.get("warc-target-uri"), payload if with_payload else None, size, bare, kind, to))
                    if kind == "response" and bare != digest(payload):
                        raise ValueError("a payload doesn't match its digest")
                for k in range(0, len(rows), 500):
                    part = rows[k : k + 500]
                    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], t) for i, t in enumerate(types)], names=[c.split()[0] for c in KINDS.split(", ")])

    return archives.select("name", "records").mapInArrow(run, KINDS)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every record.

    What can't be read is in `quarantine(spark, folder)` once the rows have been computed.
    """
    small_batches(spark)
    archives = _manifest(spark, folder)
    spark.createDataFrame([], GAPS).write.mode("overwrite").parquet(f"{folder}/quarantine")
    # dealt by name: an archive or a few are one task's work
    return _read(archives.repartition(max(1, min(archives.count(), MOST_RANGES)), "name"), with_payload, folder)


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """path, start, stop, reason, missing (records that the archive lacks by the manifest) of the last read's gaps."""
    return spark.read.schema(GAPS).parquet(f"{folder}/quarantine")


def quarantined(files: DataFrame) -> DataFrame:
    """path, start, stop, reason of every byte gap; `files` has (path, content)."""

    def run(batches):
        for b in batches:
            rows = [(path, *gap) for path, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for gap in salvage(body)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "start", "stop", "reason"])

    return files.select("path", "content").mapInArrow(run, "path string, start long, stop long, reason string")
