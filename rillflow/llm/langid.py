"""Language identification by nearest centroid.

A text's vector holds hashed character 1- to 3-grams of its lower-cased letters (runs of anything
else count as one space), weighted by (1 + ln tf) * idf and scaled to length 1. Each language has
several centroids, found by spherical k-means on a bounded sample of labelled rows; a text takes
the language of the centroid with the largest cosine. A text farther from all centroids than the
learnt floor of the winning language is rejected. A text of few n-grams cannot come near to a
centroid, so below FULL different n-grams the floor shrinks with the root of their number.

Defined results: null text, or text without a letter, is `und` with score 0, rejected; rows are
independent; without labelled rows every text is `und`; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import small_batches, texts_of

DIMENSIONS = 1 << 14
#: Code points of a text that are counted at once; longer texts are counted piece by piece.
PIECE = 1 << 20
#: Different n-grams from which on the floor of a language holds in full.
FULL = 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> np.ndarray | None:
    """Hashed 1-, 2- and 3-gram counts of a whole text; None if it has no letter."""
    total, seen, tail = np.zeros(DIMENSIONS), False, np.array([32], np.uint32)
    for k in range(0, len(text), PIECE):
        c = np.frombuffer(text[k : k + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        seen = seen or bool(letter.any())
        c = np.where(letter, c, np.uint32(32))
        start = len(tail)
        c = np.concatenate([tail, c])
        space = c == 32
        c = c[~(space & np.r_[False, space[:-1]])]
        start = min(start, len(c))
        a = c * np.uint32(0x9E3779B1)
        grams = [a[start:]]
        if len(c) > 1:
            b = (a[:-1] ^ a[1:] >> np.uint32(7)) * np.uint32(0x85EBCA6B) + a[1:]
            grams.append(b[max(start - 1, 0) :])
            if len(c) > 2:
                t = (b[:-1] ^ b[1:] >> np.uint32(9)) * np.uint32(0xC2B2AE35) + b[1:]
                grams.append(t[max(start - 2, 0) :])
        g = np.concatenate(grams)
        total += np.bincount((g ^ g >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(18), minlength=DIMENSIONS)
        tail = c[-2:]
    return total if seen else None


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Indices and values of a text's unit vector."""
    counts = gram_counts(text)
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    w = (1 + np.log(counts[at])) * idf[at]
    return at, w / max(np.sqrt(w @ w), 1e-12)


@dataclass
class Centroids:
    languages: list[str]
    #: Of each centroid: its language's place, its vector; of each language: the least cosine that is accepted.
    of: np.ndarray
    matrix: np.ndarray
    floor: np.ndarray
    idf: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, cosine in 0..1, rejected."""
        got = vector(text, self.idf) if self.languages else None
        if got is None:
            return "und", 0.0, True
        at, w = got
        cosines = self.matrix[at].T @ w
        k = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[k])))
        return self.languages[self.of[k]], score, score < self.floor[self.of[k]] * min(1.0, np.sqrt(len(at) / FULL))


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the farthest points; deterministic."""
    centres = [x.mean(axis=0)]
    near = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(labelled: DataFrame, per_language: int = 400, centroids: int = 4, strictness: float = 0.5, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Centroids:
    """Centroids from at most `per_language` different texts of each language, chosen by a hash of key and text.

    `strictness` times the first percentile of a language's own cosines is its floor. The driver
    receives n-gram counts of the sample only, whose size is bounded by these parameters.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col, text_col, F.lit(17)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Centroids([], np.empty(0, int), np.empty((DIMENSIONS, 0)), np.empty(0), np.ones(DIMENSIONS))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 2 * per_language / max(n, 1)))])
    # a row for each text, and of each language the first by hash: the limit is pushed below the shuffle
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) <= share[F.col("lang")] * (1 << 20)).groupBy("lang", "h").agg(F.first("text").alias("text"))
    sample = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= per_language).select("lang", "text", "h")

    def run(batches):
        for b in batches:
            lang, h, at, n = [], [], [], []
            for name, key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts_of(b.column(1)), strict=True):
                counts = gram_counts(text.decode("utf-8", "replace"))
                if counts is not None:
                    k = np.flatnonzero(counts)
                    lang.append(name), h.append(key), at.append(k.astype(np.int32)), n.append(counts[k].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(h, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["lang", "h", "at", "n"])

    got = sorted(sample.mapInArrow(run, "lang string, h long, at array<int>, n array<int>").collect(), key=lambda r: (r["lang"], r["h"], len(r["at"])))
    by: dict[str, list] = {}
    for r in got:
        if len(by.setdefault(r["lang"], [])) < per_language:
            by[r["lang"]].append((np.array(r["at"]), np.array(r["n"])))
    seen, total = np.zeros(DIMENSIONS), sum(map(len, by.values()))
    for at, _ in (v for rows_ in by.values() for v in rows_):
        seen[at] += 1
    idf = np.log((1 + total) / (1 + seen)) + 1
    of, parts, floors = [], [], []
    for i, lang in enumerate(languages := sorted(by)):
        x = np.zeros((len(by[lang]), DIMENSIONS), np.float32)
        for row, (at, n) in zip(x, by[lang], strict=True):
            row[at] = (1 + np.log(n)) * idf[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = _clusters(x, centroids)
        floors.append(strictness * float(np.quantile((x @ c.T).max(axis=1), 0.01)))
        of += [i] * len(c)
        parts.append(c)
    return Centroids(languages, np.array(of), np.concatenate(parts).T.astype(np.float64), np.array(floors), idf)


def predict(df: DataFrame, model: Centroids, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`key_col`, lang_pred, score, rejected of every whole text; the key is only carried along."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a size set by DIMENSIONS, languages and centroids

    def run(batches):
        own = shared.value
        for b in batches:
            got = [own.predict(t.decode("utf-8", "replace")) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([bool(x[2]) for x in got], pa.bool_())],
                names=["key", "lang_pred", "score", "rejected"],
            )

    kind = df.select(key_col).schema[0].dataType.simpleString()
    return df.select(key_col, text_col).mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key_col)


def keep_identified(df: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose text the model doesn't reject."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches):
        own = shared.value
        for b in batches:
            yield b.filter(pa.array([not own.predict(t.decode("utf-8", "replace"))[2] for t in texts_of(b.column(place))], pa.bool_()))

    return df.mapInArrow(run, df.schema)
