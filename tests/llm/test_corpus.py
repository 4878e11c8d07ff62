"""Corpus operators against libraries, brute force and SQL, with odd rows."""

import base64
import hashlib
import math
import os
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillflow.llm import bytebpe, exactdedup, fingerprint, langid, linededup, minhash, packing, queries, tokencount, tokenstore, warc
from rillflow.llm.common import id_ranges, tie
from rillflow.llm.wordbpe import ID, WordIds

ODD = ["", " ", "a", "  a  b\n\n c ", "▁▁x ▁", "<s> a </s>", "日本語 漢字", "\x1c a\x85b\xa0 c　d", "😀 é é", "x" * 5000, "it's I'LL we've", "<|endoftext|>foo <|STARTOFTEXT|>", "Éa É² ½x a_b A1B2 x×y ª", "a--b...C!? #1,234.5", "word " * 6000]
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, bands int, node string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(ODD)] + [(100, None, None, None, None), (None, "null id text of more than five words here", "fr", 2, "y"), (3, ODD[3], "en", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_token_counts(odd, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokencount.count_tokens(odd, path).collect())
    assert got == sorted((str(i), len(sp.encode(t))) for i, t in texts(odd))
    assert tokencount.count_tokens(empty, path).count() == 0


def test_byte_bpe(odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bytebpe.read_ranks(path))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids := library.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in texts(odd))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in bytebpe.encode_digests(odd, path, P.PATTERN).collect()) == want
    assert bytebpe.encode_ids(empty, path, P.PATTERN).count() == 0


def test_word_ids_equal_the_library():
    rng = np.random.default_rng(5)
    alphabet = list("aAbBéÉÿß×÷ªµ 1 23 \t\n\x0b\x1c\x85\u00a0İIẖH\u0331́'sS't<|>.,!$%中文ก😀Σς")
    drawn = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(3000)]
    rows = [*ODD, None, *drawn, "<", "|", "Éa" * 30, "<|ENDOFTEXT|> <|endoftext|>"]
    for limit in (160_000_000, 20_000):  # the second one empties the memo again and again
        own = WordIds(P.path("word_bpe_49k.json"), limit)
        want = [e.ids for e in own.library.encode_batch([t or "" for t in rows], add_special_tokens=False)]
        for end, tail in ((None, []), (1, [1])):
            for k in range(0, len(rows), 100):
                ids, at = own.encode(pa.array(rows[k : k + 100]), end)
                assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [w + tail for w in want[k : k + 100]]
    assert own.encode(pa.array([], pa.string()), 1)[0].tolist() == []


def test_id_ranges_split_a_hot_id(spark):
    """A null id, and an id of a third of all rows, are dealt to several ranges that keep the order."""
    rows = [(None, f"n{i}") for i in range(300)] + [(7, f"s{i}") for i in range(300)] + [(i, "t") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = id_ranges(df, "doc_id", 30)
    at = own.of(pa.array([r[0] for r in rows], pa.int64()), [r[1].encode() for r in rows])
    assert max(np.bincount(at)) < 60 and at.max() < own.count
    assert [r for _, r in sorted(zip(at.tolist(), rows, strict=True), key=lambda x: x[0])] != rows
    key = lambda r: (r[0] is not None, r[0] or 0, tie(r[1].encode()))
    order = sorted(range(len(rows)), key=lambda i: key(rows[i]))
    assert (np.diff(at[order]) >= 0).all()


def test_token_store_round_trip(spark, odd, empty):
    path = P.path("word_bpe_49k.json")
    library = WordIds(path).library
    rows = sorted(texts(odd), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [np.array(library.encode(t, add_special_tokens=False).ids + [1], ID) for _, t in rows]
    folder = tokenstore.write_store(odd, path)
    got = tokenstore.document_digests(spark, folder).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0] + [len(i) for i in ids[:-1]]).tolist()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(d, len(i), zlib.crc32(i.tobytes())) for (d, _), i in zip(rows, ids, strict=True)]
    assert [bytes(r["ids"]) for r in tokenstore.read_documents(spark, folder).orderBy("start").collect()] == [i.tobytes() for i in ids]
    assert tokenstore.document_digests(spark, tokenstore.write_store(empty, path)).count() == 0


def test_chunks_follow_content():
    ids = np.random.default_rng(1).integers(0, 49_000, 20_000).astype(ID)

    def cut(x):
        ends = tokenstore.chunk_ends(tokenstore.chunk_marks(x).tolist(), 0, len(x))
        return {hashlib.sha256(x[a:b].tobytes()).digest() for a, b in zip([0, *ends], ends, strict=False)}

    a, b = cut(ids), cut(np.concatenate([ids[:7], ids]))
    assert len(a & b) > 0.7 * len(a)
    parts = [b"abc", b"", b"x" * 1000]
    assert tokenstore.crc_of((len(p), zlib.crc32(p)) for p in parts) == zlib.crc32(b"".join(parts))


def test_packing(odd, empty):
    got = packing.pack_documents(odd, P.path("word_bpe_49k.json")).orderBy("sequence_id", "offset").collect()
    at = {}
    for r in got:
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 4096 and len({(r["doc_id"]) for r in got}) == len(ODD) + 2
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0
    lengths = np.random.default_rng(2).integers(1, 4097, 3000).tolist()
    bins, offsets = packing.sum_of_squares(sorted(lengths, reverse=True), 4096)
    assert len(set(bins)) <= 1.06 * sum(lengths) / 4096 + 1 and len(offsets) == 3000


def brute_components(rows):
    sets = [set(minhash.shingles((t or "").encode()).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def test_near_duplicates_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = rng.choice(words, 120).tolist()
        for k in range(12):
            one = list(base)
            for at in rng.choice(120, rng.integers(0, 7), replace=False):
                one[at] = f"e{g}x{k}x{at}"
            rows.append((len(rows), " ".join(one)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(df).collect())
    assert got == brute_components(rows)
    both = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(odd).collect())
    assert both == brute_components([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert minhash.near_duplicates(empty).count() == 0


A, B = "one two three four five six seven", "eight nine ten eleven twelve thirteen"


def test_texts_that_share_an_id_stay_apart(spark):
    df = spark.createDataFrame([(1, A), (1, B), (2, A), (3, B), (None, A), (None, "only here , with a null id")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in minhash.near_duplicates(df).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), ("None", "1"), ("None", "None")]
    unlike = spark.createDataFrame([(1, A), (1, B), (2, B)], "doc_id long, text string").union(spark.createDataFrame([(0, A)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(unlike).collect()) == [(0, 0), (1, 0), (1, 1), (2, 1)]


def test_every_text_is_sent_once(spark):
    from rillflow.llm.minhash import _documents, _texts

    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (0, "a b"), (None, None), (2, "d")], "doc_id long, text string")
    docs = _documents(df, "doc_id", "text")
    wanted = docs.where("text is null or text <> 'd'").select("doc_id", "th").distinct().withColumn("node", F.coalesce("doc_id", F.lit(-1)) * 10 + F.pmod("th", F.lit(10)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        out = _texts(docs, wanted)
        sent = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        got = sorted((r["text"] or "" for r in out.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # one for the texts, two for `wanted`: its own distinct and the join
    assert len([x for x in sent if "th#" in x]) <= 3 and got == ["", "a b", "a b", "a b", "c"]


def test_keep_one_of_each_component(spark, odd, empty):
    """Null ids, repeated rows and shared ids: one row of each group stays, and rows without words."""
    rows = [(1, A, "x"), (1, A, "y"), (1, B, "z"), (2, A, "x"), (None, B, "n"), (None, "a text of its own with null id", "n"), (None, "a text of its own with null id", "n"), (5, None, "e"), (6, " ", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = minhash.keep_one(df).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["text"] and r["text"].strip()) == sorted([("1", A), ("1", B), ("None", rows[5][1])])
    assert sorted(r["doc_id"] for r in got if not (r["text"] or "").strip()) == [5, 6]
    assert minhash.keep_one(empty).count() == 0 and minhash.keep_one(odd).columns == odd.columns


def test_sketch_fills_every_coordinate():
    for n in (1, 3, 100, 5000):
        s = minhash.mix(np.arange(1, n + 1, dtype=np.uint64))
        assert (minhash.sketch(s) != 0).all()


def test_extendible_hash_splits_and_chains():
    index = exactdedup.ExtendibleHash(lambda a, b: a == b, capacity=4)
    for k in range(500):
        index.add(k * 2654435761 % (1 << 64), f"t{k}", 1, lambda a, b: a + b)
        index.add(k * 2654435761 % (1 << 64), f"t{k}", 1, lambda a, b: a + b)
    index.add(0, "other text, same key", 1, lambda a, b: a + b)
    entries = [e for _, c in index.buckets() for chain in c.values() for e in chain]
    assert len(entries) == 501 and sum(e[1] for e in entries) == 1001 and index.depth > 5
    assert all(len(c) <= 4 for _, c in index.buckets())


def test_exact_duplicates(spark, odd, empty):
    got = exactdedup.exact_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert all(len(v) == v[0]["group_size"] and len({x["keep_id"] for x in v}) == 1 for v in by.values())
    assert by[hashlib.sha256(b"").hexdigest()][0]["keep_id"] == 1  # a blank has more code points than nothing
    assert exactdedup.exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL)))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    names = sorted(got.columns)
    at = [[d[0] for d in want.description].index(c) for c in names]
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def brute_lines(rows):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :] or a == b

    seen, out = [], {}
    for d, t in sorted(rows):
        for i, line in enumerate(t.split("\n")):
            form = line.strip(" \t\r")
            if form:
                long = min(len(form), linededup.MIN_CHARS) == linededup.MIN_CHARS
                if any(form == s or long and len(s) >= linededup.MIN_CHARS and near(form, s) for s in seen):
                    out.setdefault(d, []).append(str(i))
                seen.append(form)
    return {d: ",".join(v) for d, v in out.items()}


def test_line_dedup_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(4)
    lines = ["".join(rng.choice(list("abc é"), n)) + "z" for n in (1, 3, 22, 23, 24, 30, 31, 32, 46, 47, 48, 63, 64, 65, 95, 96, 97, 100, 127, 128, 200, 500)]
    rows = []
    for d in range(90):
        own = []
        for _ in range(5):
            x = list(lines[rng.integers(len(lines))])
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(len(x))
                x[at : at + rng.integers(0, 2)] = ["q"] * rng.integers(0, 2)
            own.append("".join(x))
        rows.append((d, "\n".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["dropped_lines"] for r in linededup.line_report(df).collect() if r["n_dropped"]}
    assert got == brute_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    for d, t in rows:
        gone = set(got.get(d, "").split(","))
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in gone)
        assert kept.get(d, "") == left
    assert linededup.line_report(odd).count() == odd.count() and linededup.dedup_lines(odd).columns == odd.columns
    assert linededup.line_report(empty).count() == 0


def test_short_lines_go_as_exact_copies(spark):
    import corpus_pipeline

    near = "a line of twenty-five char"
    rows = [(1, f"Les.\n\nx\n{near}"), (2, f" Les.\t\nLes\n\nx\n{near}s"), (3, "Les.\nx"), (4, "Les.\nLez.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    short = {r["doc_id"]: r["dropped_lines"] for r in linededup.line_report(df).collect()}
    assert short == {1: "", 2: "0,3,4", 3: "0,1", 4: "0"}
    assert {r["doc_id"]: r["dropped_lines"] for r in linededup.line_report(df, exact_chars=24).collect()} == {1: "", 2: "4", 3: "", 4: ""}
    # the pipeline's stage drops them; document 3 has nothing left
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, SF).collect()} == {1: rows[0][1], 2: "Les\n", 4: "Lez."}


def test_a_line_of_a_million_characters(spark):
    """Two near copies on one line each: the cost follows the length, not its square."""
    rng = np.random.default_rng(9)
    one = "".join(rng.choice(list("abcdefghij{}:,é"), 1_000_000))
    df = spark.createDataFrame([(1, one), (2, one[:700_000] + "#" + one[700_000:]), (3, one[::-1])], "doc_id long, text string")
    began = time.time()
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.line_report(df).collect()} == {1: 0, 2: 1, 3: 0}
    assert time.time() - began < 60


def test_line_dedup_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x\ny", 5, "a"), (2, "y\nz", 6, None)], "doc_id long, text string, k int, dropped string").withColumn("left", F.lit(1)).withColumn("th", F.lit("t"))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert got[1]["text"] == "x\ny" and got[2]["text"] == "z" and (got[2]["k"], got[2]["dropped"], got[2]["left"], got[2]["th"]) == (6, None, 1, "t")


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~queries.held_out()))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(queries.held_out() & F.col("lang").isNotNull()).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    out = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert out[100]["lang_pred"] == out[1]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in out.values())
    assert model.predict("日本語の文章はここでは学習されていない言語である" * 20)[2]
    assert langid.predict(empty, langid.fit(empty)).count() == 0 and langid.predict(odd, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_fingerprints(spark, odd, empty):
    rows = sorted(texts(odd), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).digest()))
    got = fingerprint.fingerprints(odd, range_bytes=2000).toPandas()
    want = [(str(d), len(t), hashlib.sha256(fingerprint.edited(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(rows)]
    key = lambda d: "None" if d != d or d is None else str(int(d))
    assert sorted((key(r.doc_id), r.n_chars, r.edited_sha256) for r in got.itertuples()) == sorted(want)
    assert got["near_edited"].between(0, 1).all() and fingerprint.fingerprints(empty).count() == 0
    a, b = fingerprint.PrefixHash("hello world foo"), fingerprint.PrefixHash("xxhello worle")
    assert a.extension(0, b, 2) == 10 and a.equal(0, b, 2, 10) and not a.equal(0, b, 2, 11)


def common_share(a, b):
    """Share of spans that two texts have in common, by counting."""
    spans = lambda t: Counter(t[i : i + w] for w in (min(fingerprint.SPAN, len(t)),) for i in range(len(t) - w + 1)) if t else Counter()
    x, y = spans(a), spans(b)
    return 1.0 if a == b else 2 * sum((x & y).values()) / max(1, x.total() + y.total())


def test_fingerprint_likeness_against_counted_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    rows += [(10**9 + i, t) for i, t in enumerate(["short text of 25 letters.", "abc", "ab", "a", "a", "short text of 25 letters?"])]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == [d for d, _ in rows]
    off, by_text = [], {}
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        r, changed = got[d], fingerprint.edited(t, after)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["edited_prefix"] == len(os.path.commonprefix([t, changed])) and r["next_prefix"] == len(os.path.commonprefix([t, after]))
        by_text.setdefault(t, set()).add(r["fingerprint"])
        by_text.setdefault(changed, set()).add(r["edited_fingerprint"])
        off += [abs(r["near_edited"] - common_share(t, changed)), abs(r["near_next"] - common_share(t, after))]
        if len(t) + len(after) < fingerprint.SAMPLE:
            assert max(off[-2:]) < 1e-9
    assert np.mean(off) < 0.04 and max(off) < 0.25
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)


def test_language_id_against_plain_nearest_centroid(spark):
    """Plain Python over the fitted vectors, for held-out documents; unlike text is rejected, documents are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~queries.held_out()))
    held = docs.where(queries.held_out()).select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in langid.predict(docs, model).where(queries.held_out()).collect()}
    for r in held[:60]:
        counts = Counter()
        text = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        if not text.strip():
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        at = np.flatnonzero(grams := langid.gram_counts(r["text"]))
        counts.update({int(k): (1 + math.log(grams[k])) * model.idf[k] for k in at})
        norm = math.sqrt(sum(v * v for v in counts.values()))
        cosines = [sum(v * model.matrix[k, c] for k, v in counts.items()) / norm for c in range(model.matrix.shape[1])]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[r["doc_id"]]["lang_pred"] == model.languages[model.of[best]] and got[r["doc_id"]]["score"] == pytest.approx(cosines[best], abs=1e-9)
    known = [r for r in held if r["lang"] and (r["text"] or "").strip()]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in known]) > 0.98
    assert np.mean([got[r["doc_id"]]["rejected"] for r in known]) < 0.01
    rng = np.random.default_rng(6)
    strange = ["".join(rng.choice(list(letters), 400)) for letters in ("αβγδεζηθ ικλμνξο", "абвгдежз ийклмно", "漢字日本語文章学習", "zqxjkvwz qxzjk")]
    assert all(model.predict(t)[2] for t in strange)


def test_language_sample_of_null_and_repeated_ids(spark):
    """Rows without ids, and one text repeated thousands of times, don't push a language out of the sample."""
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words over and over").alias("text"), F.lit("en").alias("lang"))
    more = spark.range(100).select("id", F.concat(F.lit("le chat est sur la table numero "), F.col("id").cast("string"), F.lit(" avec lui")).alias("text"), F.lit("fr").alias("lang"))
    model = langid.fit(df.union(more))
    assert model.languages == ["en", "fr"] and model.predict("le chat est sur la table")[0] == "fr"


def test_warc_query_against_brute_force(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first = {}
    for page, body in pages:
        first[body] = max(first.get(body, page), page)
    want = sorted((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == p else "revisit", None if first[b] == p else first[b]) for p, b in pages)
    assert sorted(map(tuple, queries.op2_warc(spark, SF).collect())) == want


def test_packing_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], ID)
            want.append((r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())))
    got = queries.op7_packing(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places.get(r["sequence_id"], 0)
        places[r["sequence_id"]] = r["offset"] + r["length"]
    floor = -(-sum(w[3] for w in want) // 4096)
    assert max(places.values()) <= 4096 and len(places) <= 1.05 * floor + 1


def test_sum_of_squares_against_the_plain_rule():
    """Every choice against a trial of all of them."""
    capacity = 40
    lengths = np.random.default_rng(8).integers(1, capacity + 1, 400).tolist()
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    used = []
    for n, b, offset in zip(lengths, bins, offsets, strict=True):
        def after(k):
            rooms = [capacity - u for u in used] + [capacity] * (k == len(used))
            rooms[k] -= n
            return sum(v * v for g, v in Counter(rooms).items() if g)

        able = [k for k, u in enumerate(used) if u + n <= capacity] + [len(used)]
        least = min(map(after, able))
        best = min((capacity - used[k] if k < len(used) else capacity + 1, k) for k in able if after(k) == least)[1]
        assert (b, offset) == (best, used[best] if best < len(used) else 0)
        if b == len(used):
            used.append(0)
        used[b] += n


def test_packing_deals_repeated_rows(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words").alias("text"))
    got = packing.pack(packing.pieces(df, P.path("word_bpe_49k.json")), 4096, 500)
    per_group = [r["n"] for r in got.groupBy((F.col("sequence_id") / (1 << 40)).cast("long").alias("g")).agg(F.count("*").alias("n")).collect()]
    assert sum(per_group) == 3000 and len(per_group) == 6 and max(per_group) < 700


def test_exact_index_files_answer(spark):
    rows = [(i, f"text {i % 300}" + " " * (i // 300)) for i in range(900)] + [(None, "text 0"), (2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest, folder = exactdedup.write_owners(df, "doc_id", "text", 2_000)
    names = [r["name"] for r in manifest.collect()]
    assert len(names) > 1 and sum(r["entries"] for r in manifest.collect()) == 301
    at = lambda text: [x for n in names if (x := exactdedup.find(f"{folder}/{n}", text))]
    assert at(b"te xt 5") == [(8, 605, 3)] and at(b"text 0") == [(8, 600, 4)] and at(b"") == [(0, 2000, 1)] and at(b"no such text") == []


def test_warc_common_payload_and_int_ids(spark):
    """A payload of a third of all rows, and ids that are no longs."""
    df = spark.range(600).select(F.col("id").cast("int").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("<p>common</p>")).otherwise(F.col("id").cast("string")).alias("html"))
    got = warc.read_archives(spark, warc.write_archives(df)).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"response": 401, "revisit": 199}
    ints = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    counted = tokencount.count_tokens(ints, P.path("piece_bpe_32k.model"), limit=1).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["over_limit"]) for r in counted] == [(3, True), (0, False)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert [len(r["ids"]) for r in bytebpe.encode_ids(ints, path, P.PATTERN).orderBy("doc_id").collect()] == [r["n_tokens"] for r in bytebpe.encode_digests(ints, path, P.PATTERN).orderBy("doc_id").collect()]


def test_damaged_store_is_refused(spark):
    from pathlib import Path

    df = spark.createDataFrame([(1, "some words of a text"), (2, "others")], "doc_id long, text string")
    folder = tokenstore.write_store(df, P.path("word_bpe_49k.json"))
    root = Path(folder.removeprefix("file://"), "root")
    root.write_bytes(b"\0" * 32)
    with pytest.raises(ValueError, match="root"):
        tokenstore.read_recipes(spark, folder)


def test_warc_round_trip_and_salvage(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "u", ""), (None, "u", "nul"), (5, "http://e\r\nX: y", "é" * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_archives(spark, warc.write_archives(df)).collect()}
    assert len(got) == 6 and got[1]["refers_to"] == 2 and got[1]["record_type"] == "revisit" and got[3]["refers_to"] == 4
    assert got[5]["payload_bytes"] == 18_000 and got[1]["payload_digest"] == warc.digest(b"<p>x</p>") and got[1]["payload_bytes"] == 8
    few = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, warc.write_archives(df, least=5)).collect()}
    assert few[3] == few[4] == "response" and few[1] == "revisit"
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0
    parts = [warc.member(warc.record(i, "u", b"<b>%d</b>" % i * 40)) for i in range(9)]
    data = bytearray(b"".join(parts))
    at = len(b"".join(parts[:4]))
    data[at + 30 : at + 40] = b"\0" * 10
    records, gaps = warc.salvage(bytes(data))
    assert [warc._page(r["warc-record-id"]) for r in records] == [0, 1, 2, 3, 5, 6, 7, 8] and gaps[0][:2] == (at, at + len(parts[4]))
    plain = b"".join(warc.record(i, "u", b"text") for i in range(4))
    first = len(warc.record(0, "u", b"text"))
    records, gaps = warc.salvage(plain[: first - 7] + plain[first - 5 :])
    assert len(records) == 3 and len(gaps) == 1
    files = spark.createDataFrame([("f", bytes(data))], "path string, content binary")
    assert warc.quarantined(files).count() == 1


def test_warc_salvage_within_a_member():
    parts = [warc.record(i, "u", hashlib.sha256(b"%d" % i).hexdigest().encode() * 9) for i in range(5)]
    ids = lambda data: [warc._page(r["warc-record-id"]) for r in warc.salvage(data)[0]]
    inside = bytearray(b"".join(parts))
    inside[len(parts[0]) + len(parts[1]) - 40] ^= 1
    data = warc.member(bytes(inside))
    assert ids(data) == [0, 2, 3, 4] and [g[:2] for g in warc.salvage(data)[1]] == [(0, len(data))]
    whole = warc.member(b"".join(parts))
    last = warc.member(warc.record(9, "u", b"x"))
    crc = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert ids(crc + last) == [0, 1, 2, 3, 4, 9] and warc.salvage(crc + last)[1][0][:2] == (0, len(crc))
    cut = ids(whole[: len(whole) * 3 // 4])
    assert 0 < len(cut) < 5 and cut == list(range(len(cut)))


def test_warc_read_quarantines_what_is_missing(spark):
    from pathlib import Path

    df = spark.createDataFrame([(i, "u", f"<b>{i}</b>" * 40) for i in range(9)], "page_id long, url string, html string")
    folder = warc.write_archives(df)
    assert warc.read_archives(spark, folder).count() == 9 and warc.quarantine(spark, folder).count() == 0
    file = max(Path(folder.removeprefix("file://"), "archives").glob("*.gz"), key=lambda f: f.stat().st_size)
    whole = file.read_bytes()
    n, first = len(warc.salvage(whole)[0]), warc._inflate(whole, 0)[1]

    def read(data):
        # a new file: the old one's checksum no longer fits
        for f in (file, file.with_name(f".{file.name}.crc")):
            f.unlink(missing_ok=True)
        file.write_bytes(data)
        count = len(warc.read_archives(spark, folder).collect())
        return count, [(r["start"], r["stop"], r["missing"]) for r in warc.quarantine(spark, folder).collect()]

    assert read(whole[:30] + b"\0" * 10 + whole[40:]) == (8, [(0, first, 1)])
    # cut at a member's edge: no gap in the bytes
    assert n > 1 and read(whole[:first]) == (10 - n, [(first, first, n - 1)])
    assert read(whole) == (9, [])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    components = minhash.near_duplicates(docs)
    assert components.where("not kept").count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages over real documents and odd rows (nulls, empty texts, repeated rows, an extra column), and an empty table."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("left", F.lit("extra"))
    some = [r["text"] for r in docs.where("n_chars between 400 and 3000").orderBy("doc_id").limit(3).collect()]
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n "), (None, some[0] + " and a last line\n" + some[0]), (None, some[1]), (10**6 + 3, some[2]), (10**6 + 3, some[2]), (10**6 + 4, "日本語の文章 " * 50)]
    odd = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"), F.lit(None).cast("string").alias("left"))
    docs.union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    model = langid.fit(docs.where(~queries.held_out()))
    rows = [(d, t) for d, t in rows if not model.predict(t or "")[2]]
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={d!r}, text={t!r})" for d, t in rows)

    low = lambda d: -(1 << 63) if d is None else d
    gone, after = brute_lines([(low(d), t) for d, t in rows]), []
    for d, t in rows:
        out = set(gone.get(low(d), "").split(","))
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in out)
        if left.strip(" \t\r\n") or not gone.get(low(d)):
            after.append((d, left))
    # null ids and a repeated id share line numbers in the brute force, so they are compared apart
    plain = [(d, t) for d, t in after if d is not None and d < 10**6]
    lines = corpus_pipeline.line_dedup(spark, kept, str(tmp_path))
    got = [(r["doc_id"], r["text"]) for r in lines.collect()]
    assert lines.columns == docs.columns and sorted(x for x in got if x[0] is not None and x[0] < 10**6) == sorted(plain)

    near = corpus_pipeline.near_dedup(spark, lines, str(tmp_path))
    stay = [(r["doc_id"], r["text"]) for r in near.collect()]
    component = {d: c for d, _, c in brute_components([x for x in got if x[0] is not None and x[0] < 10**6])}
    assert near.columns == docs.columns and sorted(d for d, _ in stay if d is not None and d < 10**6) == sorted(int(d) for d, c in component.items() if d == c)
    # by places instead of ids: no two rows that stay belong together
    assert all(d == c for d, _, c in brute_components([(i, t) for i, (_, t) in enumerate(stay)]))

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = sorted((str(d), min(4096, n - at)) for d, t in stay for n in (len(library.encode(t, add_special_tokens=False).ids) + 1,) for at in range(0, n, 4096))
    assert sorted((str(r["doc_id"]), r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == pieces
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
