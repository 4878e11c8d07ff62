"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when identical after deleting white space. Each task first merges its own copies
(so a text that fills a third of the table is sent once per task), then sends one candidate per
distinct text to the owner of its key range. An owner inserts the candidates of its range into an
extendible-hash index: a directory of 2^depth slots over buckets of bounded size; an overfull bucket
splits, and the directory doubles when that bucket was as deep as the directory. Entries with an
equal key form a chain, in which the bytes of the texts are compared. Buckets are written to the
shared folder; an owner that is lost is run again and writes under another name.

Of equal texts the row with the most code points stays, then the least id (null ids last).

Defined results: null counts as empty text, equal to all white space; repeated rows come back as
often as they came; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import create_file, input_bytes, materialize, ranges_for, scratch, small_batches, texts_of

#: Deleted before texts are compared: \x20 and \x09-\x0D.
WHITE = b" \t\n\v\f\r"
#: Distinct texts that a task merges at once before it sends what it has.
MERGED = 50_000
#: Most owners: at 100 TB each holds about 1 GB of the tables' bytes.
MOST_OWNERS = 100_000


class ExtendibleHash:
    """An extendible-hash index of 64-bit keys with chained entries.

    `same(a, b)` tells whether two payloads are equal. Only what a bucket holds is compared.
    """

    def __init__(self, same, capacity: int = 64):
        self.same, self.capacity, self.depth = same, capacity, 0
        #: slot -> bucket; a bucket is [its depth, {key: chain of [payload, value]}].
        self.directory = [[0, {}]]

    def add(self, key: int, payload, value, merge) -> None:
        while True:
            bucket = self.directory[key & (1 << self.depth) - 1]
            chains = bucket[1]
            if key in chains:
                for entry in chains[key]:
                    if self.same(entry[0], payload):
                        entry[1] = merge(entry[1], value)
                        return
                chains[key].append([payload, value])
                return
            if len(chains) < self.capacity or bucket[0] == 63:
                chains[key] = [[payload, value]]
                return
            self._split(bucket)

    def _split(self, bucket: list) -> None:
        if bucket[0] == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit = 1 << bucket[0]
        bucket[0] += 1
        moved = [bucket[0], {k: c for k, c in bucket[1].items() if k & bit}]
        bucket[1] = {k: c for k, c in bucket[1].items() if not k & bit}
        for slot in range(next(s for s, b in enumerate(self.directory) if b is bucket), len(self.directory)):
            if self.directory[slot] is bucket and slot & bit:
                self.directory[slot] = moved

    def buckets(self) -> list:
        return list({id(b): b for b in self.directory}.values())


def normalised(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def _best(a: tuple, b: tuple) -> tuple:
    """(code points, id, rows) of two groups of equal texts, merged."""
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return (*min(a, b, key=order)[:2], a[2] + b[2])


def _candidates(docs: DataFrame) -> DataFrame:
    def run(batches):
        pack = zstandard.ZstdCompressor(3)
        merged: dict[bytes, tuple] = {}
        texts: dict[bytes, bytes] = {}

        def flush():
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(list(merged), pa.binary()),
                    pa.array([struct.unpack(">q", d[:8])[0] for d in merged], pa.int64()),
                    *(pa.array([v[k] for v in merged.values()], pa.int64()) for k in range(3)),
                    pa.array([texts[d] for d in merged], pa.binary()),
                ],
                names=["sha", "key", "points", "doc_id", "rows", "packed"],
            )
            merged.clear(), texts.clear()
            return out

        held = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                norm = normalised(text)
                sha, packed = hashlib.sha256(norm).digest(), pack.compress(norm)
                one = (len(text.decode("utf-8", "replace")), doc, 1)
                if sha in merged and texts[sha] != packed:  # the same digest, other bytes
                    yield flush()
                if sha in merged:
                    merged[sha] = _best(merged[sha], one)
                else:
                    merged[sha], texts[sha] = one, packed
                    held += len(packed)
            if len(merged) >= MERGED or held > 32_000_000:
                yield flush()
                held = 0
        if merged:
            yield flush()

    return docs.mapInArrow(run, "sha binary, key long, points long, doc_id long, rows long, packed binary")


_HEAD, _BUCKET, _ENTRY = struct.Struct("<4sIIQ"), struct.Struct("<II"), struct.Struct("<Q32sqq?qQI")


def write_index(index: ExtendibleHash, uri: str) -> int:
    """Write one owner's index; returns its entries.

    "EXTH", depth, buckets, bytes of the index; the directory (a bucket's place for each slot);
    buckets: depth, entries, and of each key, digest, points, id (and whether it is null), rows,
    place and bytes of the text; then the texts, packed by zstd.
    """
    buckets, texts, at, out = index.buckets(), [], 0, []
    place = {id(b): i for i, b in enumerate(buckets)}
    out += [struct.pack("<I", place[id(b)]) for b in index.directory]
    entries = 0
    for depth, chains in buckets:
        out.append(_BUCKET.pack(depth, sum(map(len, chains.values()))))
        for key, chain in chains.items():
            for (sha, packed), (points, doc, rows) in chain:
                out.append(_ENTRY.pack(key, sha, points, doc or 0, doc is None, rows, at, len(packed)))
                texts.append(packed)
                at, entries = at + len(packed), entries + 1
    body = b"".join(out)
    with create_file(uri) as f:
        f.write(_HEAD.pack(b"EXTH", index.depth, len(buckets), len(body)) + body)
        for t in texts:
            f.write(t)
    return entries


def _open(uri: str):
    """depth, directory, buckets of an index file as lists of entries, and a reader of its texts."""
    store, path = pafs.FileSystem.from_uri(uri)
    f = store.open_input_file(path)
    magic, depth, buckets, size = _HEAD.unpack(f.read(_HEAD.size))
    if magic != b"EXTH":
        raise ValueError(f"{uri} is no index file")
    body = f.read(size)
    directory = struct.unpack_from(f"<{1 << depth}I", body)
    at, found = 4 << depth, []
    for _ in range(buckets):
        _, n = _BUCKET.unpack_from(body, at)
        at += _BUCKET.size
        found.append([_ENTRY.unpack_from(body, at + k * _ENTRY.size) for k in range(n)])
        at += n * _ENTRY.size

    def text(place: int, length: int) -> bytes:
        f.seek(_HEAD.size + size + place)
        return f.read(length)

    return depth, directory, found, text


def find(uri: str, text: bytes) -> tuple | None:
    """points, id, rows of a text's group in an index file: by its slot, its bucket and its bytes."""
    norm = normalised(text)
    sha = hashlib.sha256(norm).digest()
    key = struct.unpack(">Q", sha[:8])[0]
    depth, directory, buckets, read = _open(uri)
    for own, other, points, doc, null, rows, at, size in buckets[directory[key & (1 << depth) - 1]]:
        if own == key and other == sha and zstandard.ZstdDecompressor().decompress(read(at, size)) == norm:
            return points, None if null else doc, rows
    return None


def write_owners(df: DataFrame, id_col: str, text_col: str, owner_bytes: int) -> tuple[DataFrame, str]:
    """Write the index of all texts, a file for each range of keys; its manifest (name, entries) and folder."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    owners = ranges_for(input_bytes(docs), owner_bytes, MOST_OWNERS)
    folder = scratch(spark, "exact-index")

    def own(batches):
        unpack = zstandard.ZstdDecompressor()

        def same(a, b):
            return a[0] == b[0] and (a[1] == b[1] or unpack.decompress(a[1]) == unpack.decompress(b[1]))

        index = ExtendibleHash(same)
        for b in batches:
            for sha, key, points, doc, rows, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index.add(key & (1 << 64) - 1, (sha, packed), (points, doc, rows), _best)
        if not any(chains for _, chains in index.buckets()):
            return
        name = f"{uuid.uuid4().hex}.exth"
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_index(index, f"{folder}/{name}")], pa.int64())], names=["name", "entries"])

    # owners take ranges of the key: its top bits
    ranged = _candidates(docs).withColumn("owner", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * owners).cast("int"))
    files = ranged.repartitionById(owners, F.col("owner")).select("sha", "key", "points", "doc_id", "rows", "packed").mapInArrow(own, "name string, entries long")
    return materialize(files, "exact-manifest"), folder


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `df`, by the groups of the written index."""
    small_batches(df.sparkSession)
    manifest, folder = write_owners(df, id_col, text_col, owner_bytes)

    def read(batches):
        for b in batches:
            for name, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                entries = [e for bucket in _open(f"{folder}/{name}")[2] for e in bucket]
                if len(entries) != count:
                    raise ValueError(f"{folder}/{name} doesn't match the manifest")
                for k in range(0, count, 10_000):
                    part = entries[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([e[1] for e in part], pa.binary()), pa.array([None if e[4] else e[3] for e in part], pa.int64()), pa.array([e[5] for e in part], pa.int64())], names=["sha", "keep_id", "group_size"])

    groups = manifest.repartition(max(1, manifest.count()), "name").mapInArrow(read, "sha binary, keep_id long, group_size long")
    white = "[ \\t\\n\\x0B\\f\\r]"
    norm = F.encode(F.regexp_replace(F.coalesce(text_col, F.lit("")), white, ""), "UTF-8")
    facts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    # Catalyst only knows the manifest's size, and would broadcast all groups
    out = facts.join(groups.hint("merge"), "sha")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
