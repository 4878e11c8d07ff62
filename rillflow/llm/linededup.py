"""Line deduplication within an edit bound, by a deletion-neighbourhood join in native operators.

A line is dropped when an earlier line of the corpus (by document id, then line number), dropped
itself or not, is within one edit: equal, or one character inserted, deleted or substituted. Lines
are compared without white space at their ends. Lines of fewer than `min_chars` characters, of which
one edit is a large share, go only as exact copies; those of fewer than `exact_chars` (1: only blank
lines) always stay.

Two lines are within one edit exactly when a deletion variant of one, without the character at
position p, equals the other line, or equals the other's variant without its character at p.
Emitting every variant of every line would cost the square of a line's length, so they are
emitted where an equal partner is still possible, in three joins on hashed keys:

1. ends: one edit leaves the first or the last 2^k characters alone (2^k: a quarter to a half of the
   line), so only lines that share an end with another line go on;
2. segments: the neighbourhood by runs. The line without its j-th segment of SEGMENT characters, for
   the longer line's length M; only lines that share such a variant go on;
3. characters: all deletion variants of that segment, hashed together with the rest of the line.

Groups of equal variants are reduced by aggregation to their earliest lines; pairs within a group
are never written out. The distance to the earliest partner is verified on the texts.

Defined results: a null text has no lines; an empty text is one empty line; ids ascend with null
first; rows that repeat an id and text share the fate of their lines; an empty table gives an empty
table; all other columns pass through `dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import materialize

SEGMENT = 48
MIN_CHARS = 24
#: Characters up to which Spark's own edit distance verifies a pair.
LONG = 1000
_NULL_ID = -(1 << 63)
_ORDER = "decimal(38,0)"


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n").alias("lines"))


def _lines(keyed: DataFrame, least_chars: int) -> DataFrame:
    """k, th, line_no, o (place in the corpus), form, size, h1, h2 of every line that is compared."""
    one = keyed.select("k", "th", F.posexplode("lines").alias("line_no", "line"))
    one = one.select("k", "th", "line_no", F.btrim("line", F.lit(" \t\r")).alias("form")).where(F.char_length("form") >= max(least_chars, 1))
    place = (F.col("k").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("line_no")).cast(_ORDER)
    return one.select("k", "th", "line_no", place.alias("o"), "form", F.char_length("form").alias("size"), F.xxhash64("form").alias("h1"), F.xxhash64(F.lit(1), "form").alias("h2"))


def _ends(lines: DataFrame, min_chars: int) -> DataFrame:
    """One row for each distinct line: h1, h2, o (the earliest), n, and the hashed ends, null below `min_chars`."""
    out = lines.withColumn("p", F.expr("shiftleft(1, length(bin(size)) - 2)")).withColumn("q", F.expr("shiftleft(1, length(bin(size + 1)) - 2)"))
    ends = [F.xxhash64(F.lit(side), F.col(w), F.left("form", F.col(w)) if side == "first" else F.right("form", F.col(w))) for w in ("p", "q") for side in ("first", "last")]
    # at the size before a power of two the line has ends of both widths
    keys = F.when(F.col("p") == F.col("q"), F.array(*ends[:2])).otherwise(F.array(*ends))
    return out.withColumn("ends", F.when(F.col("size") >= min_chars, keys)).groupBy("h1", "h2").agg(F.min("o").alias("o"), F.count("*").alias("n"), F.first("ends").alias("ends"))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that rows of two different lines have.

    A table of its own, so that adaptive execution can broadcast it or split a hot key's rows.
    """
    return materialize(rows.groupBy(*keys).agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select(*keys), "shared")


def _segments(lines: DataFrame) -> DataFrame:
    """(line, longer size M, segment j): hashes of what stands before and after, and the middle.

    The line is cut into runs of SEGMENT characters once. What stands before or after a segment is
    the exclusive or of the hashes of its runs with their places, summed up along the line; so a
    line costs its length, not its square. In the shorter line (size M - 1) the runs after a segment
    begin one character earlier.
    """
    runs = F.regexp_extract_all("form", F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
    last = F.element_at("runs", -1)
    longer = F.struct(F.col("size").alias("m"), F.col("runs").alias("left"), F.col("runs").alias("right"), F.col("runs").alias("middle"))
    # the shorter line has one more, empty, run where its own are all full
    padded = F.when(F.char_length(last) == SEGMENT, F.concat("runs", F.array(F.lit("")))).otherwise(F.col("runs"))
    cut = F.transform("padded", lambda x: F.left(x, F.lit(SEGMENT - 1)))
    moved = F.transform("padded", lambda x, i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.right(F.get("padded", i - 1), F.lit(1)), F.left(x, F.lit(SEGMENT - 1)))))
    shorter = F.struct((F.col("size") + 1).alias("m"), F.col("padded").alias("left"), moved.alias("right"), cut.alias("middle"))
    out = lines.select("h1", "h2", "o", "size", runs.alias("runs")).withColumn("padded", padded).select("h1", "h2", "o", "size", F.explode(F.array(longer, shorter)).alias("x"))
    out = out.select("h1", "h2", "o", "size", "x.m", F.posexplode(F.arrays_zip("x.left", "x.right", "x.middle")).alias("j", "y"))
    keys = [F.xxhash64(F.lit(seed), "j", "m", f"y.{side}").alias(f"{side[0]}{seed}") for side in ("left", "right") for seed in (1, 2)]
    out = out.select("h1", "h2", "o", "size", "m", "j", F.col("y.middle").alias("middle"), *keys)
    whole = Window.partitionBy("h1", "h2", "m")
    along = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    # exclusive or with the own run takes it out of a running one
    before = [F.bit_xor(f"l{k}").over(along).bitwiseXOR(F.col(f"l{k}")).alias(f"s{k}") for k in (1, 2)]
    after = [F.bit_xor(f"r{k}").over(whole).bitwiseXOR(F.bit_xor(f"r{k}").over(along)).alias(f"t{k}") for k in (1, 2)]
    out = out.select("h1", "h2", "o", "size", "m", "j", "middle", *before, *after)
    return out.select("h1", "h2", "o", "size", "m", F.xxhash64("m", "j", "s1", "t1").alias("s1"), F.xxhash64("j", "s2", "m", "t2").alias("s2"), "middle")


def _variants(segments: DataFrame) -> DataFrame:
    """Deletion variants of the middle of the longer line, p the position; p = -1: the shorter line as it is."""
    at = F.when(F.col("size") == F.col("m"), F.sequence(F.lit(0), F.char_length("middle") - 1)).otherwise(F.array(F.lit(-1)))
    rows = segments.where("size < m or middle <> ''").withColumn("p", F.explode(at))
    variant = F.when(F.col("p") < 0, F.col("middle")).otherwise(F.concat(F.left("middle", F.col("p")), F.expr("substring(middle, p + 2)")))
    return rows.select("h1", "h2", "o", "p", F.xxhash64("s1", "s2", variant).alias("v1"), F.xxhash64("s2", variant, "s1").alias("v2"))


def _within_one(a: str, b: str) -> Column:
    """Whether two lines are within one edit.

    Spark's edit distance walks the whole line for each character, so long lines are compared by
    their longest common prefix, found by binary search, and what follows it.
    """
    la, lb = F.char_length(a), F.char_length(b)
    start = F.struct(F.lit(0).alias("low"), F.least(la, lb).alias("high"))

    def halve(s, _):
        half = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.left(F.col(a), half) == F.left(F.col(b), half)
        return F.struct(F.when(same, half).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(half - 1).alias("high"))

    k = F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.greatest(la, lb)))), start, halve, lambda s: s["low"])
    after = lambda x, skip: F.substring(F.col(x), k + skip, F.lit((1 << 31) - 1))
    long = (F.abs(la - lb) <= 1) & (after(a, F.when(la >= lb, 2).otherwise(1)) == after(b, F.when(lb >= la, 2).otherwise(1)))
    return F.when(F.greatest(la, lb) <= LONG, F.levenshtein(a, b, 1).between(0, 1)).otherwise(long)


def earliest(lines: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, t: of every line that has an earlier copy or neighbour, the earliest place of one."""
    distinct = materialize(_ends(lines.select("o", "form", "size", "h1", "h2"), min_chars), "lines")
    ends = distinct.select("h1", "h2", F.explode("ends").alias("end"))
    with_partner = ends.join(_shared(ends, "end"), "end").select("h1", "h2").distinct()
    chosen = distinct.select("h1", "h2", "o").join(with_partner, ["h1", "h2"])
    texts = materialize(lines.select("h1", "h2", "o", "form", "size").join(chosen, ["h1", "h2", "o"], "left_semi").dropDuplicates(["h1", "h2"]), "line-texts")
    segments = _segments(texts)
    close = segments.join(_shared(segments.select("h1", "s1", "s2"), "s1", "s2"), ["s1", "s2"])
    variants = materialize(_variants(close), "variants")
    equal = variants.join(_shared(variants, "v1", "v2"), ["v1", "v2"])
    # of each group of equal variants: its earliest line as it is, its earliest variant, and that at each position
    by_place = equal.groupBy("v1", "v2", "p").agg(F.min("o").alias("least"))
    of_group = by_place.groupBy("v1", "v2").agg(F.min(F.when(F.col("p") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("p") >= 0, F.col("least"))).alias("cut"))
    partner = F.when(F.col("p") < 0, F.col("cut")).otherwise(F.least("whole", "least"))
    near = equal.join(by_place, ["v1", "v2", "p"]).join(of_group, ["v1", "v2"]).groupBy("h1", "h2", "o").agg(F.min(partner).alias("t")).where("t < o")
    near = near.join(texts.select("h1", "h2", "form"), ["h1", "h2"]).join(texts.select(F.col("o").alias("t"), F.col("form").alias("other")), "t")
    near = near.where(_within_one("form", "other")).groupBy("h1", "h2").agg(F.min("t").alias("t"))
    return distinct.select("h1", "h2", "o", "n").join(near, ["h1", "h2"], "left").where("n > 1 or t is not null").select("h1", "h2", F.least("o", "t").alias("t"))


def _dropped(keyed: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """k, th, dropped: the ascending line numbers that go, of each text that loses a line."""
    lines = _lines(keyed, min(exact_chars, min_chars))
    # written first: a very common line's rows then need not meet in one task
    known = materialize(earliest(lines, min_chars), "earliest")
    gone = lines.select("k", "th", "line_no", "o", "h1", "h2").join(known, ["h1", "h2"]).where("o > t")
    return gone.select("k", "th", "line_no").groupBy("k", "th").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def line_report(df: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", exact_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_lines (comma-joined numbers from 0) of every row of `df`."""
    keyed = _keyed(df, id_col, text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), F.xxhash64(text_col).alias("th"), F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(_dropped(keyed, min_chars, exact_chars), ["k", "th"], "left")
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped_lines"))


def dedup_lines(df: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, exact_chars: int = 1) -> DataFrame:
    """`df` with repeated lines taken out of its texts; rows all of whose filled lines went are left out.

    `size_col`, if given, gets the code points of the new text.
    """
    # the rows travel as one struct, so that no column of theirs can clash with a name of ours
    dropped = _dropped(_keyed(df, id_col, text_col), min_chars, exact_chars)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), F.xxhash64(text_col).alias("th"))
    rows = rows.join(dropped, ["k", "th"], "left")
    text = F.col("row").getField(text_col)
    lines = F.split(text, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "dropped"), lambda i: F.get(lines, i))
    rows = rows.withColumn("left", F.when(F.col("dropped").isNotNull(), F.array_join(left, "\n")))
    rows = rows.where(F.col("left").isNull() | (F.btrim("left", F.lit(" \t\r\n")) != ""))
    new = {text_col: F.coalesce("left", text)}
    if size_col:
        new[size_col] = F.when(F.col("left").isNotNull(), F.char_length("left")).otherwise(F.col("row").getField(size_col)).cast(df.schema[size_col].dataType)
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns])
