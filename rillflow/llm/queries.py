"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import bytebpe, exactdedup, fingerprint, langid, linededup, minhash, packing, tokencount, tokenstore, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out():
    """Documents that nothing is learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_documents(spark, sf_dir))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenstore.write_store(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return tokenstore.document_digests(spark, folder)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_warc, op3_token_counts, op4_near_dedup, op5_exact_dedup, op6_token_store, op7_packing, op8_line_dedup, op9_byte_bpe, op10_fingerprint)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op4_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
        FROM documents JOIN m ON m.a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id""",
    "op8_line_dedup": """
        WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM x),
        f AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(13)) AS form FROM l),
        c AS (SELECT doc_id, line_no, form, length(form) AS size FROM f WHERE form <> ''),
        u AS (SELECT form, size, min((doc_id, line_no)) AS o FROM c GROUP BY ALL),
        e AS (SELECT form, size, o, m, (m - 1) // 2 AS h FROM (SELECT *, unnest([size, size + 1]) AS m FROM u WHERE size >= 24)),
        p AS (SELECT form, size, o, m, 'first' || left(form, h) AS half FROM e UNION ALL SELECT form, size, o, m, 'last' || right(form, m - h) AS half FROM e),
        g AS (SELECT DISTINCT b.form, a.o FROM p a JOIN p b ON a.m = b.m AND a.half = b.half AND a.o < b.o WHERE levenshtein(a.form, b.form) <= 1),
        t AS (SELECT u.form, least(u.o, coalesce(min(g.o), u.o)) AS t FROM u LEFT JOIN g ON g.form = u.form GROUP BY u.form, u.o),
        d AS (SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS gone FROM c JOIN t ON t.form = c.form WHERE (doc_id, line_no) > t GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(gone, '') AS dropped_lines
        FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id""",
    # SHA-1 in base32: five hexadecimal digits are four characters
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        n AS (SELECT *, list_transform(range(8), lambda j: list_sum(list_transform(range(5), lambda k: (strpos('0123456789abcdef', substr(x, 5 * j + k + 1, 1)) - 1) * (1 << (16 - 4 * k))))::BIGINT) AS n, max(page_id) OVER (PARTITION BY x, strlen(h)) AS first FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM n""",
}
