"""Document fingerprints from prefix polynomial hashes.

With prefix hashes H[i] = sum of c[j] * B^j mod P over j < i, kept in an array, the hash of any
span follows from two of them: two spans are equal when (H[r] - H[l]) * B^(top - l) agree. The
longest common extension of two positions is found by binary search over such comparisons.

A text's fingerprint holds the hash and length of the whole and a sample of its spans: the spans of
SPAN code points whose mixed hashes are the SAMPLE smallest, repeated spans counted. From the samples of two texts
follows the Jaccard similarity J of their span sets (over the smallest hashes of the union); their
likeness is 2J / (1 + J), the share of spans they have in common: an estimate, exact for texts of at
most SAMPLE spans. A text of fewer than SPAN code points is one span. Fingerprints have a bounded
size for any text. How far a text and its edited or next text agree from the start is exact, by the
longest common extension.

Defined results: null counts as empty text; two empty texts have likeness 1, an empty and another
text 0; equal texts have likeness 1; ids are ordered with null first, equal ids by a hash of
the text; a single
row is its own next document; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import id_ranges, input_bytes, ranges_for, small_batches, texts_of, tie
from rillflow.llm.minhash import mix
from rillflow.llm.ordered import in_order

P = (1 << 31) - 1
BASES = (911_382_323, 1_700_000_011)
SPAN, SAMPLE = 12, 64
#: Code points hashed at once; longer texts go on from the prefix so far.
STEP = 1 << 16

_U = np.uint64


@lru_cache(maxsize=4)
def _powers(base: int) -> np.ndarray:
    """base^0 .. base^STEP mod P."""
    out = np.empty(STEP + 1, _U)
    out[0] = 1
    n = 1
    while n <= STEP:
        m = min(n, STEP + 1 - n)
        out[n : n + m] = out[:m] * _U(pow(base, n, P)) % _U(P)
        n += m
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of a text for both bases."""

    def __init__(self, text: str):
        self.points = code_points(text)
        self.prefix = [self._prefix(b) for b in BASES]

    def _prefix(self, base: int) -> np.ndarray:
        n, powers = len(self.points), _powers(base)
        out = np.zeros(n + 1, _U)
        for k in range(0, n, STEP):
            c = self.points[k : k + STEP].astype(_U) + _U(1)
            terms = np.cumsum(c * powers[: len(c)] % _U(P))
            out[k + 1 : k + 1 + len(c)] = (int(out[k]) + terms % _U(P) * _U(pow(base, k, P))) % _U(P)
        return out

    def span(self, start: int, stop: int) -> tuple[int, ...]:
        """A hash of the span that doesn't depend on its place."""
        return tuple((int(h[stop]) - int(h[start])) * pow(base, -start, P) % P for h, base in zip(self.prefix, BASES, strict=True))

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common extension from `start` here and `at` there."""
        low, high = 0, min(len(self.points) - start, len(other.points) - at)
        while low < high:
            half = (low + high + 1) // 2
            if self.equal(start, other, at, half):
                low = half
            else:
                high = half - 1
        return low

    def spans(self, width: int) -> np.ndarray:
        """Mixed hashes of all spans of `width`, by the first base; the k-th of equal spans has a hash of its own."""
        h, n = self.prefix[0], len(self.points) - width + 1
        if n < 1:
            return np.empty(0, _U)
        inverse = pow(BASES[0], -1, P)
        down, out = _powers(inverse), []
        for k in range(0, n, STEP):
            m = min(STEP, n - k)
            d = (h[k + width : k + width + m] + _U(P) - h[k : k + m]) % _U(P)
            d = d * down[:m] % _U(P) * _U(pow(inverse, k, P)) % _U(P)
            out.append(d)
        d = np.sort(np.concatenate(out))
        again = np.flatnonzero(d[1:] == d[:-1]) + 1
        if len(again):
            first = np.arange(n)
            first[again] = 0
            d[again] += (again - np.maximum.accumulate(first)[again]).astype(_U) << _U(32)
        return mix(d + _U(1))


def sample_of(own: PrefixHash) -> tuple[tuple, np.ndarray]:
    """Whole-text hash with length, and the smallest mixed span hashes, ascending."""
    n = len(own.points)
    whole = (n, *own.span(0, n))
    if not n:
        return whole, np.empty(0, _U)
    s = own.spans(min(SPAN, n))
    few = s
    if len(s) > 16 * SAMPLE:  # hashes are distinct but for chance
        few = s[s <= np.partition(s, 4 * SAMPLE)[4 * SAMPLE]]
    return whole, np.unique(few)[:SAMPLE]


def render(whole: tuple, sample: np.ndarray) -> str:
    return f"{whole[0]:x}-{whole[1]:08x}{whole[2]:08x}-" + sample.astype(">u8").tobytes().hex()


def parse(fingerprint: str) -> tuple[str, np.ndarray]:
    whole, _, tail = fingerprint.rpartition("-")
    return whole, np.frombuffer(bytes.fromhex(tail), ">u8").astype(_U)


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans of two texts, from their fingerprints alone; 1 for equal ones."""
    if a == b:
        return 1.0
    return _likeness(parse(a)[1], parse(b)[1])


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate([x, y])
    both.sort()
    twice = both[1:] == both[:-1]
    union = both[np.r_[True, ~twice]][:SAMPLE]
    common = both[1:][twice]
    j = float(np.searchsorted(common, union[-1], side="right")) / len(union)
    return 2 * j / (1 + j)


def edited(text: str, after: str) -> str:
    """`text` with its last quarter replaced by as many code points of the beginning of `after`."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_prefix, next_prefix.

    Texts are sent once, compressed, to the task of their id range; each range also gets a copy of
    the first row of the range after it, the last one that of the first.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = id_ranges(docs, "doc_id", ranges_for(input_bytes(docs), range_bytes))

    def deal(batches, packed=True):
        pack = zstandard.ZstdCompressor(3)
        for b in batches:
            texts = texts_of(b.column(1))
            columns = [pa.array(ranges.of(b.column(0), texts)), b.column(0), pa.array([tie(t) for t in texts], pa.binary())]
            names = ["bucket", "doc_id", "tie"]
            if packed:
                columns.append(pa.array([pack.compress(t) for t in texts], pa.binary()))
                names.append("packed")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # the first row of each range, by id (null first) and hash of the text: one row for each range
    marks = docs.mapInArrow(lambda batches: deal(batches, False), "bucket int, doc_id long, tie binary")
    heads = {r["bucket"]: (r["head"]["doc_id"], bytes(r["head"]["tie"])) for r in marks.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("head")).collect()}
    ring = sorted(heads)
    before = {heads[b]: ring[i - 1] for i, b in enumerate(ring)}

    def copies(batches):
        """Every row, and once more for the range before if it is the first of its own."""
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([False] * len(b), pa.bool_())], names=[*b.schema.names, "borrowed"])
            at = [i for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) if key in before]
            if at:
                c = b.take(pa.array(at))
                to = [before[key] for key in zip(c.column(1).to_pylist(), c.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *c.columns[1:], pa.array([True] * len(c), pa.bool_())], names=[*b.schema.names, "borrowed"])

    def dealt(batches):
        return copies(deal(batches))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        last = None  # (bucket, doc_id, text, fingerprint parts, prefix arrays) still without its next document

        def row(one, after):
            changed = edited(one[2], after[2])
            prefix = PrefixHash(changed)
            whole, sample = sample_of(prefix)
            mine, other = render(*one[3]), render(whole, sample)
            near = 1.0 if mine == other else _likeness(one[3][1], sample)
            following = 1.0 if one[3][0] == after[3][0] and (one[3][1] == after[3][1]).all() else _likeness(one[3][1], after[3][1])
            return one[1], len(one[2]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), mine, other, near, following, one[4].extension(0, prefix, 0), one[4].extension(0, after[4], 0)

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_prefix", "next_prefix"]
        for b in batches:
            out = []
            for bucket, doc, packed, borrowed in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "packed", "borrowed")), strict=True):
                if borrowed and (last is None or last[0] != bucket):
                    continue  # a further copy of a head that occurs more than once
                text = unpack.decompress(packed).decode("utf-8", "replace") if packed else ""
                own = PrefixHash(text)
                now = (bucket, doc, text, sample_of(own), own)
                if last is not None and last[0] == bucket:
                    out.append(row(last, now))
                last = None if borrowed else now
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    sent = docs.mapInArrow(dealt, "bucket int, doc_id long, tie binary, packed binary, borrowed boolean")
    placed = in_order(sent, ranges.count, "borrowed", "doc_id", "tie")
    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_prefix long, next_prefix long")
