"""Token ids in a content-addressed store of shared files.

A rolling hash over a window of ids cuts each document's id stream into chunks, so equal passages
give equal chunks wherever they stand. A chunk is stored once, under the SHA-256 of its ids, in a
pack file; a document is a recipe: its chunks' digests in order, and the Merkle root over them.
Recipes are written in ascending id order, one file for each id range, that ends with the Merkle
root over its documents' roots; a manifest lists the files that finished tasks wrote, with a root
of each, and the file `root` holds the Merkle root over the ranges in order.

Pack file: "CPK1", then for each chunk digest (32 bytes), ids (u32), size (u32), and that many
bytes: zstd of the ids as little-endian u16, or as u32 if one is larger. Recipe file: "CRC1", then for each
document its id (i64, with a null flag), ids (u64), chunks (u32), Merkle root and digests; at last
0xFFFFFFFF-marked the range's root.

Reading checks every chunk against its digest, every document against its root and every file
against its manifest row, and raises on a mismatch. `document_digests` joins recipes with what
reading found of each chunk (count and CRC); CRCs of a document's chunks combine to that of its
whole stream, so ids are not moved a second time. `read_documents` gives the ids themselves.

Defined results: null or empty text has the end id alone; ids ascend with null first, repeated ids
in an order that their texts alone fix; an empty table gives an empty store and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import MOST_RANGES, create_file, id_ranges, input_bytes, ranges_for, read_file, scratch, slices, small_batches, texts_of
from rillflow.llm.wordbpe import ID, word_ids

#: Ids in the rolling window; least, mean (beyond the least) and most ids of a chunk.
WINDOW, LEAST, MEAN, MOST = 4, 256, 1024, 8192
PACK_BYTES = 8_000_000


def chunk_marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: the hash of the WINDOW ids before has its high bits all 0."""
    n = len(ids)
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    rolled = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        rolled[k:] += h[: n - k] << np.uint32(k) | h[: n - k] >> np.uint32(32 - k if k else 31)
    rolled *= np.uint32(0x85EBCA6B)
    return np.flatnonzero(rolled >> np.uint32(32 - MEAN.bit_length() + 1) == 0) + 1


def chunk_ends(marks: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of one document, whose ids stand from `start` to `stop`, by the marks of a whole batch.

    LEAST is over WINDOW, so no mark that counts depends on the document before.
    """
    ends = []
    while stop - start > LEAST:
        at = bisect_left(marks, start + LEAST)
        start = min(marks[at] if at < len(marks) else stop, start + MOST, stop)
        ends.append(start)
    if start < stop:
        ends.append(stop)
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over 32-byte digests; an odd one moves up as it is; of no leaves, the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


#: An id below 65,536 as it is packed.
SHORT = np.dtype("<u2")


def pack_ids(ids: np.ndarray, packer) -> bytes:
    """zstd of the ids, in two bytes each if they fit."""
    short = not len(ids) or ids.max() < 1 << 16
    return packer.compress(ids.astype(SHORT if short else ID).tobytes())


def unpack_ids(packed: bytes, n: int, unpacker) -> bytes:
    raw = unpacker.decompress(packed)
    return np.frombuffer(raw, SHORT).astype(ID).tobytes() if len(raw) == n * SHORT.itemsize else raw


def _times(matrix, vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


@lru_cache(maxsize=4096)
def _zeros(size: int) -> tuple:
    """The linear map of a CRC-32 that is followed by `size` zero bytes."""
    if size == 1:
        one = [0xEDB88320, *(1 << k for k in range(31))]  # a zero bit
        for _ in range(3):
            one = [_times(one, x) for x in one]
        return tuple(one)
    half = _zeros(size // 2)
    whole = tuple(_times(half, x) for x in half)
    return tuple(_times(_zeros(1), x) for x in whole) if size % 2 else whole


def crc_of(parts) -> int:
    """CRC-32 of joined byte strings from (size, CRC-32) of each."""
    total = 0
    for size, crc in parts:
        total = (_times(_zeros(size), total) ^ crc) if size else total
    return total


def write_store(df: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", owner_bytes: int = 16_000_000) -> str:
    """Write the store of all texts of `df`; returns its folder.

    Chunks that a task has already seen are sent once (a bounded memory of digests). One shuffle
    brings chunks to the owner of their digest range and recipes to that of their id range.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = scratch(spark, "token-store")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    owners = ranges_for(input_bytes(docs), owner_bytes)
    ranges = id_ranges(docs, "doc_id", owners)

    def cut(batches):
        own, packer, seen = word_ids(tokenizer_path), zstandard.ZstdCompressor(3), set()
        for b in (part for batch in batches for part in slices(batch, 1)):
            buckets = ranges.of(b.column(0), texts_of(b.column(1)) if ranges.parts.max() > 1 else []).tolist()
            ids, offsets = own.encode(b.column(1), end_id)
            marks, places, raw = chunk_marks(ids).tolist(), offsets.tolist(), memoryview(ids).cast("B")
            rows = []
            for k, (doc, bucket) in enumerate(zip(b.column(0).to_pylist(), buckets, strict=True)):
                start, digests = places[k], []
                for stop in chunk_ends(marks, start, places[k + 1]):
                    part = raw[start * ID.itemsize : stop * ID.itemsize]
                    digest = hashlib.sha256(part).digest()
                    digests.append(digest)
                    if digest not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(digest)
                        rows.append((int.from_bytes(digest[:4], "big") * owners >> 32, 1, None, digest, stop - start, pack_ids(ids[start:stop], packer)))
                    start = stop
                rows.append((bucket, 0, doc, None, start - places[k], b"".join(digests)))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["owner", "chunk", "doc_id", "digest", "n", "body"])

    def own_files(batches):
        """Pack files of chunks, recipe files of id ranges; a row for each finished file."""
        names = ["kind", "bucket", "name", "entries", "ids", "root"]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        done: list[tuple] = []
        out = {"at": None}

        def close():
            if out["at"] is None:
                return
            kind, bucket = out["at"]
            root = merkle_root(out["roots"])
            if kind == "recipes":
                out["body"].append(struct.pack("<I", 0xFFFFFFFF) + root)
            name = f"{kind}/{uuid.uuid4().hex}.bin"
            with create_file(f"{folder}/{name}") as f:
                f.write((b"CRC1" if kind == "recipes" else b"CPK1") + b"".join(out["body"]))
            done.append((kind, bucket, name, len(out["roots"]), out["ids"], root))
            out["at"] = None

        last = None
        for b in batches:
            for owner, chunk, doc, digest, n, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk and digest == last:
                    continue
                at = ("packs" if chunk else "recipes", owner)
                if out["at"] != at or out["size"] > PACK_BYTES and chunk:
                    close()
                    out |= {"at": at, "body": [], "size": 0, "roots": [], "ids": 0}
                if chunk:
                    last = digest
                    entry = digest + struct.pack("<II", n, len(body)) + body
                    out["roots"].append(digest)
                else:
                    root = merkle_root([body[k : k + 32] for k in range(0, len(body), 32)])
                    entry = struct.pack("<I?qQ", len(body) // 32, doc is None, doc or 0, n) + root + body
                    out["roots"].append(root)
                out["body"].append(entry)
                out["size"] += len(entry)
                out["ids"] += n
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=names)

    dealt = docs.mapInArrow(cut, "owner int, chunk int, doc_id long, digest binary, n long, body binary")
    # even places: id ranges, odd ones: digest ranges; repeated ids are ordered by their recipes
    placed = dealt.repartitionById(2 * max(owners, ranges.count), F.col("owner") * 2 + F.col("chunk")).sortWithinPartitions("owner", "chunk", "doc_id", "digest", "body")
    files = placed.mapInArrow(own_files, "kind string, bucket int, name string, entries long, ids long, root binary")
    files.write.option("compression", "zstd").parquet(f"{folder}/manifest")
    with create_file(f"{folder}/root") as f:
        f.write(merkle_root([bytes(r["root"]) for r in _ranges(spark, folder)]))
    return folder


def _manifest(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A row for each file of a kind."""
    return spark.read.schema("kind string, bucket int, name string, entries long, ids long, root binary").parquet(f"{folder}/manifest").where(F.col("kind") == kind)


def _ranges(spark: SparkSession, folder: str) -> list:
    """The rows of the recipe files in order: as many as id ranges, a bounded number."""
    return sorted(_manifest(spark, folder, "recipes").collect(), key=lambda r: r["bucket"])


def _each(files: DataFrame) -> DataFrame:
    """The manifest's rows, dealt to tasks so that a file or a few are one task's work."""
    return files.repartition(max(1, min(files.count(), MOST_RANGES)), "name")


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """order, doc_id, start, n_tokens, digests of every document, in its place of the whole stream."""
    before, ids, docs, rows = {}, 0, 0, _ranges(spark, folder)
    if read_file(f"{folder}/root") != merkle_root([bytes(r["root"]) for r in rows]):
        raise ValueError(f"{folder}: the root doesn't match the manifest")
    for r in rows:
        before[r["name"]] = (ids, docs)
        ids, docs = ids + r["ids"], docs + r["entries"]

    def run(batches):
        for b in batches:
            for name, entries, root in zip(*(b.column(c).to_pylist() for c in ("name", "entries", "root")), strict=True):
                body, path = read_file(f"{folder}/{name}"), f"{folder}/{name}"
                start, place = before[name]
                if body[:4] != b"CRC1":
                    raise ValueError(f"{path} is no recipe file")
                at, out, roots = 4, [], []
                while True:
                    chunks = struct.unpack_from("<I", body, at)[0]
                    if chunks == 0xFFFFFFFF:
                        break
                    chunks, null, doc, n = struct.unpack_from("<I?qQ", body, at)
                    at += struct.calcsize("<I?qQ")
                    own = body[at : at + 32]
                    digests = [body[at + 32 + 32 * k : at + 64 + 32 * k] for k in range(chunks)]
                    at += 32 + 32 * chunks
                    if merkle_root(digests) != own:
                        raise ValueError(f"{path}: a document's root doesn't match its recipe")
                    roots.append(own)
                    out.append((place, None if null else doc, start, n, digests))
                    start, place = start + n, place + 1
                if body[at + 4 :] != merkle_root(roots) or body[at + 4 :] != root or len(roots) != entries:
                    raise ValueError(f"{path} doesn't match the manifest")
                for k in range(0, len(out), 2000):
                    part = out[k : k + 2000]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)], names=["position", "doc_id", "start", "n_tokens", "digests"])

    return _each(_manifest(spark, folder, "recipes")).mapInArrow(run, "position long, doc_id long, start long, n_tokens long, digests array<binary>")


def read_chunks(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """digest, n, crc (and ids as bytes) of every stored chunk, each checked against its digest."""
    kind = "digest binary, n long, crc long" + ", ids binary" * with_ids

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            for name, entries, root in zip(*(b.column(c).to_pylist() for c in ("name", "entries", "root")), strict=True):
                body, path = io.BytesIO(read_file(f"{folder}/{name}")), f"{folder}/{name}"
                out, leaves = [], []
                if body.read(4) != b"CPK1":
                    raise ValueError(f"{path} is no pack file")
                while head := body.read(40):
                    digest, n, size = struct.unpack("<32sII", head)
                    ids = unpack_ids(body.read(size), n, unpacker)
                    if hashlib.sha256(ids).digest() != digest:
                        raise ValueError(f"{path}: a chunk doesn't match its digest")
                    leaves.append(digest)
                    out.append((digest, n, zlib.crc32(ids), ids if with_ids else None))
                if len(out) != entries or merkle_root(leaves) != root:
                    raise ValueError(f"{path} doesn't match the manifest")
                for k in range(0, len(out), 2000):
                    part = out[k : k + 2000]
                    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())[: 3 + with_ids]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)], names=["digest", "n", "crc", "ids"][: 3 + with_ids])

    return _each(_manifest(spark, folder, "packs")).mapInArrow(run, kind)


def _joined(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    recipes = read_recipes(spark, folder)
    parts = recipes.select("position", "doc_id", "start", "n_tokens", F.posexplode("digests").alias("k", "digest"))
    wanted = ["k", "n", "crc", *(["ids"] if with_ids else [])]
    # Catalyst only knows the manifest's size, and would broadcast all chunks
    return parts.join(read_chunks(spark, folder, with_ids).hint("merge"), "digest", "left").groupBy("position", "doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct(*wanted))).alias("parts"))


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of the store."""

    def run(batches):
        for b in batches:
            crcs = []
            for n, parts in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if any(p["n"] is None for p in parts) or sum(p["n"] for p in parts) != n:
                    raise ValueError("a document's chunks don't add up to its ids")
                crcs.append(crc_of((p["n"] * ID.itemsize, p["crc"]) for p in parts))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _joined(spark, folder, False).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (little-endian u32 bytes) of every document, put together from its chunks."""
    return _joined(spark, folder, True).select("doc_id", "start", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("hex")).select("doc_id", "start", F.unhex("hex").alias("ids"))
