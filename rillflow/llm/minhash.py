"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct word shingles. The sketch has 128
coordinates. In round i every element falls into a hashed bin with a value that begins with i; a
bin keeps its least value, so bins filled in an earlier round stay. Rounds go on until every bin is
full; after 128 of them, round 128 + k fills bin k for certain. Equality of coordinates is then an
estimate of the Jaccard similarity with Chernoff-like concentration.

32 bands of 4 coordinates make candidates: two sets of similarity 0.75 miss all bands with a
probability of 5e-6. Links are confirmed on the full sets. No bucket is capped, and no bucket's
pairs are all written out:

1. documents with equal sets are one class from the start;
2. in each bucket every class is compared with the bucket's least class (a star);
3. components are built, and classes that share a bucket but are still apart are compared block by
   block: pairs whose sketches agree in NEAR coordinates (6e-8 below 0.75's spread) are verified in
   falling order of agreement while their components are apart. Only links leave the task.

Defined results: null or wordless text has 0 shingles and is its own component; repeated rows come
back as often as they came; texts that share an id are classes of their own, linked only by what
they say; rows with a null id take part, and their component is the least non-null id, if there is
one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import Memo, materialize, small_batches, texts_of
from rillflow.llm.components import components

COORDINATES, BANDS = 128, 32
ROWS = COORDINATES // BANDS
#: Coordinates that must agree before a pair of step 3 is verified.
NEAR = 70
#: Classes and shingles of a block of a large bucket, and partners of one copy of a star's hub.
BLOCK, BLOCK_SHINGLES, PARTNERS = 2_000, 2_000_000, 256

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Seeds of rounds, odd factors of words in a shingle and of coordinates in a band.
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FACTORS = mix(np.arange(1001, 1065, dtype=_U)) | _U(1)
_BAND_SALT = mix(np.arange(5001, 5001 + BANDS, dtype=_U))

#: Word hashes of the running task: emptied when it ends, so idle Python workers hold little memory.
_words = Memo(xxhash.xxh3_64_intdigest, 40_000_000)


#: Bytes of a text whose words are listed at once.
PART = 1 << 22
_WHITE = re.compile(rb"[ \t-\r]")


def _word_hashes(text: bytes) -> np.ndarray:
    found, at = [], 0
    while at < len(text):
        end = _WHITE.search(text, at + PART)
        stop = end.start() if end else len(text)
        words = text[at:stop].lower().split()  # of bytes: A-Z, and \x20 \x09-\x0D
        found.append(np.fromiter(map(_words.__getitem__, words), _U, len(words)))
        at = stop + 1
    return np.concatenate(found) if found else np.empty(0, _U)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one for all words of a shorter text."""
    h = _word_hashes(text)
    n = len(h)
    if not n:
        return np.empty(0, _U)
    if n < width:
        return mix(np.atleast_1d((h * _FACTORS[width : width + n]).sum(dtype=_U) + _U(n)))
    s = h[: n - width + 1] * _FACTORS[0]
    for k in range(1, width):
        s += h[k : n - width + 1 + k] * _FACTORS[k]
    return np.unique(mix(s))


def sketch(s: np.ndarray) -> np.ndarray:
    """The coordinates of a set: for each bin the hash, in its round, of the element that won it."""
    out, empty = np.zeros(COORDINATES, _U), np.ones(COORDINATES, bool)
    step = max(1, min(16, 2048 // len(s)))
    for i in range(0, COORDINATES, step):
        h = mix(s[None, :] ^ _SEEDS[i : i + step, None])
        rounds = np.arange(h.shape[0], dtype=_U)[:, None]
        # bin (7 bits), round (4 bits), value
        order = ((h >> _U(57)) << _U(57) | rounds << _U(53) | (h << _U(7)) >> _U(11)).ravel()
        at = np.argsort(order)
        bins = (order[at] >> _U(57)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        bins, at = bins[first], at[first]
        new = empty[bins]
        out[bins[new]] = h.ravel()[at[new]]
        empty[bins] = False
        if not empty.any():
            return out
    for k in np.flatnonzero(empty):
        out[k] = mix(s ^ _SEEDS[COORDINATES + k]).min()
    return out


def bands_of(coordinates: np.ndarray) -> np.ndarray:
    return mix((coordinates.reshape(BANDS, ROWS) * _FACTORS[10 : 10 + ROWS]).sum(axis=1, dtype=_U) ^ _BAND_SALT).view(np.int64)


def _facts(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            n, key, bands = [], [], []
            for t in texts_of(b.column(2)):
                s = shingles(t, width)
                n.append(len(s))
                if len(s):
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(bands_of(sketch(s)))
                else:
                    key.append(None), bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n_shingles", "set_key", "bands"],
            )
        _words.clear()

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n_shingles long, set_key binary, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def verify(pairs: DataFrame, texts: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The rows (a, b) of `pairs` whose full sets reach the similarity; `texts` has (node, text).

    An `a` with many partners is copied once for every PARTNERS of them, so none of its partners
    wait for one task. Each text is read where its key is sorted, one hub in memory at a time.
    """
    pairs = materialize(pairs, "pairs")
    salts = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(PARTNERS))).alias("salts")), "salts")
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    partners = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    hubs = hubs.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")

    def run(batches):
        at, sets = None, []
        for batch in batches:
            found = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(3)), strict=True)
            for a, salt, b, text in rows:
                if at != (a, salt):
                    at, sets = (a, salt), []
                s = shingles(text, width)
                if b is None:
                    sets.append(s)
                elif any(similar(x, s, percent) for x in sets):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
        _words.clear()

    return hubs.union(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "b").mapInArrow(run, "a long, b long")


def _links_across(group: list[tuple], percent: int, width: int) -> list[tuple[int, int]]:
    """Links that join different components of a block pair; `group` has (node, comp, block, text).

    Pairs whose sketches agree are verified in falling order of agreement, and only while their
    components are still apart.
    """
    sets = [shingles(text, width) for *_, text in group]
    node, comp, block = (np.array([r[k] for r in group], np.int64) for k in range(3))
    s = np.stack([(sketch(x) & _U(255)).astype(np.uint8) for x in sets])
    two = block.min() != block.max()
    # a byte for each pair: how many coordinates agree, 0 where the pair doesn't count
    agree = np.empty((len(group), len(group)), np.uint8)
    step = max(1, 8_000_000 // (COORDINATES * len(group)))
    for i in range(0, len(group), step):
        j = slice(i, i + step)
        near = (s[j, None, :] == s[None, :, :]).sum(axis=2, dtype=np.uint8)
        near[(node[j, None] >= node[None, :]) | ((block[j, None] == block[None, :]) if two else False)] = 0
        agree[j] = near
    links = []
    for level in range(COORDINATES, NEAR - 1, -1):
        for i in range(0, len(group), 256):
            x, y = np.nonzero(agree[i : i + 256] == level)
            apart = comp[x + i] != comp[y]
            for a, b in zip((x[apart] + i).tolist(), y[apart].tolist(), strict=True):
                if comp[a] != comp[b] and similar(sets[a], sets[b], percent):
                    comp[comp == max(comp[a], comp[b])] = min(comp[a], comp[b])
                    links.append((int(node[a]), int(node[b])))
    return links


def _across(buckets: DataFrame, first: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    Classes are grouped by the hub of their buckets. Those in the hub's own component form core
    blocks, the others outer blocks, of bounded rows and shingles. Each outer block meets each core
    block and each outer block in a task of its own; core blocks don't meet, as they are linked.
    """
    members = buckets.select("hub", "node", "n").distinct().join(first, "node", "left").select("hub", "node", "n", F.coalesce("component", "node").alias("comp"))
    own = members.where("node = hub").select("hub", F.col("comp").alias("hub_comp"))
    # tables of their own: adaptive execution splits a hub's rows only where both sides are plain shuffles
    rest = materialize(members.where("node <> hub").join(own, "hub").withColumn("outer", F.col("comp") != F.col("hub_comp")), "members")

    def blocks(which):
        rows, volume = F.count(F.when(which, 1)), F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
        return F.ceil(F.greatest(rows / F.lit(float(BLOCK)), volume / F.lit(float(BLOCK_SHINGLES)))).cast("int")

    sizes = rest.groupBy("hub").agg(blocks(~F.col("outer")).alias("cores"), blocks(F.col("outer")).alias("outers"), F.count("*").alias("rows")).where("outers > 0 and rows > 1")
    placed = rest.join(materialize(sizes, "sizes"), "hub").withColumn("block", F.when(F.col("outer"), F.col("cores") + F.pmod(F.xxhash64("node"), "outers")).otherwise(F.pmod(F.xxhash64("node"), F.greatest("cores", F.lit(1)))).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.when(F.col("outer"), 0).otherwise(F.col("cores")), F.col("cores") + F.col("outers") - 1)))
    placed = placed.select("node", "hub", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "comp", "block")
    dealt = placed.join(texts, "node").select("hub", "x", "y", "node", "comp", "block", "text")

    def run(batches):
        at, group = None, []

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            links: list = []
            for hub, x, y, *row in zip(*(c.to_pylist() for c in batch.columns[:6]), texts_of(batch.column(6)), strict=True):
                if at != (hub, x, y):
                    if len(group) > 1:
                        links += _links_across(group, percent, width)
                    at, group = (hub, x, y), []
                group.append(row)
            yield out(links)
        yield out(_links_across(group, percent, width) if len(group) > 1 else [])
        _words.clear()

    return dealt.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y").mapInArrow(run, "a long, b long")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and th, a hash of the text: a row is told by its id and text, as ids may be null or repeat."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the rows of `wanted` (node, doc_id, th).

    Rows that repeat an id and text are one before they are sent. The join's keys are plain columns,
    those of the grouping, so every text is sent once: a null-safe comparison would deal the texts anew.
    """
    key = ["th", "id", "none"]
    told = ["th", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    once = docs.select(*told, "text").groupBy(*key).agg(F.first("text").alias("text"))
    return once.join(wanted.select("node", *told), key).select("node", "text")


def _components(df: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, th, n_shingles, set_key of every row; set_key, component, least (id of the class) of every set."""
    small_batches(df.sparkSession)
    docs = _documents(df, id_col, text_col)
    facts = materialize(_facts(docs, width), "facts")
    of_set = facts.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("own"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # a class is a node of its own number, fixed by writing it
    classes = materialize(of_set.select("set_key", "own.doc_id", "own.th", "n", "bands").withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).where("hub.node <> last")
    hubs = materialize(hubs.select("band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    buckets = materialize(banded.join(hubs, "band"), "buckets")
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi")
    texts = materialize(_texts(docs, wanted), "texts")

    star = buckets.where("node <> hub").where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = materialize(verify(star, texts, percent, width), "links")
    first = components(edges)

    more = materialize(_across(buckets, first, texts, percent, width), "links")
    linked = components(edges.union(more)) if more.take(1) else first
    return facts, classes.join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"), F.col("doc_id").alias("least"))


def near_duplicates(df: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `df`."""
    facts, reach = _components(df, percent, width, id_col, text_col)
    least = materialize(reach.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    reach = reach.join(least, "component").select("set_key", "component_id")
    out = facts.select("doc_id", "n_shingles", "set_key").join(reach, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, of which one stays in each component: that of the least id (null last), then text hash.

    Of rows that repeat that id and text one stays, the least by a hash of its columns. Rows without
    words all stay.
    """
    facts, reach = _components(df, percent, width, id_col, text_col)
    reach = materialize(reach, "reach")
    rows = facts.where("n_shingles > 0").groupBy("set_key", "doc_id", "th").agg(F.count("*").alias("copies"))
    placed = materialize(rows.join(reach.select("set_key", "component"), "set_key"), "placed")
    best = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("best"))
    told = placed.join(materialize(best, "best"), "component")
    stays = told.where(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))
    gone = told.where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))).select(F.col("doc_id").alias("id"), "th")
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"))

    def met(other, how):
        return own.join(other, (own.th == other.th) & own.id.eqNullSafe(other.id), how)

    gone, again = materialize(gone, "gone"), materialize(stays.where("copies > 1").select(F.col("doc_id").alias("id"), "th"), "again")
    if again.isEmpty():
        return met(gone, "left_anti").select("row.*")
    single = met(gone.union(again), "left_anti").select("row")
    one = met(again, "left_semi").groupBy("id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return single.union(one).select("row.*")
