"""Best-fit packing of token pieces into fixed-size sequences by the sum-of-squares rule.

An open sequence with room g is counted in N(g). A piece goes where the sum of N(g)^2 over all
residual rooms becomes smallest: into an open sequence, or a new one. Pieces are dealt by hash into
groups of bounded size that are packed independently, so the work per task is bounded; within a
group the largest pieces come first.

Defined results: null or empty text is one piece of the end id alone; repeated rows are packed as
often as they occur; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import materialize, slices, small_batches
from rillflow.llm.wordbpe import ID, word_ids


def sum_of_squares(lengths, capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the place in it of every length, in the order given; each length is 1..capacity.

    Ties go to the tightest room, and among bins of equal room to the one opened first.
    """
    # count[g]: open bins with room g. Index `capacity` stands for a new bin and stays 0; so does 0.
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = [], [], 0
    for n in lengths:
        # change of the sum when the piece goes into room g: a bin leaves g and enters g - n
        rooms = n + np.flatnonzero(count[n:capacity])
        change = -2 * count[rooms] + 1 + np.where(rooms > n, 2 * count[rooms - n] + 1, 0)
        fresh = 2 * int(count[capacity - n]) + 1 if n < capacity else 0
        k = int(change.argmin()) if len(rooms) else -1
        if k >= 0 and change[k] <= fresh:
            room = int(rooms[k])
            b = heapq.heappop(open_[room])
            count[room] -= 1
        else:
            room, b = capacity, made
            made += 1
        bins.append(b)
        offsets.append(capacity - room)
        if room > n:
            heapq.heappush(open_[room - n], b)
            count[room - n] += 1
    return bins, offsets


def pieces(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", memo: int = 100_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut only where longer than `capacity`.

    A Python worker remembers ids of pre-tokens in about `memo` bytes; the rows don't depend on it.
    """
    small_batches(df.sparkSession)

    def run(batches):
        own = word_ids(tokenizer_path, memo)
        for b in (part for batch in batches for part in slices(batch, 1)):
            ids, offsets = own.encode(b.column(1), end_id)
            of = np.repeat(np.arange(len(b)), -(-np.diff(offsets) // capacity))
            piece = np.arange(len(of)) - np.searchsorted(of, of)
            at = offsets[of] + piece * capacity
            stop = np.minimum(at + capacity, offsets[of + 1])
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[i:j]) for i, j in zip((at * ID.itemsize).tolist(), (stop * ID.itemsize).tolist(), strict=True)]
            columns = [b.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(stop - at, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, capacity: int = 4096, group: int = 250_000) -> DataFrame:
    """`df` of `pieces` with sequence_id and offset; about `group` pieces are packed by one task."""
    cut = materialize(df, "pieces")
    groups = max(1, -(-cut.count() // group))
    small_batches(df.sparkSession)

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_pylist(), capacity)
        first = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    # the place in the written table deals repeated rows to all groups as well
    dealt = cut.withColumn("place", F.monotonically_increasing_id()).repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32", "place")).drop("place")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", memo: int = 100_000_000) -> DataFrame:
    """Every piece of every text with its place: see `pieces` and `pack`."""
    return pack(pieces(df, tokenizer_path, end_id, capacity, id_col, text_col, memo), capacity)
