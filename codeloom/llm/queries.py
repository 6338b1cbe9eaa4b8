"""Queries of the training-data operators over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, fingerprints, html_extract, jaccard_join, kd_search, lexical, line_dedup, packing, pieces, prefix_trie, quotes, toxicity, warc

VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op2_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), window=4096, end=2)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(quotes.link_quotes(_table(spark, sf_dir, "conversations")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), with_ids=False)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_kd_search, op3_fingerprints, op4_warc, op5_packing, op6_bpe, op7_line_dedup, op8_jaccard_join, op9_quote_linking, op10_toxicity, op11_prefix_trie, op12_pieces, op13_lexical_search, pipeline)
}

def _crc_table() -> list[int]:
    """The remainders of all bytes under CRC-32's reflected polynomial."""
    out = []
    for r in range(256):
        for _ in range(8):
            r = r >> 1 ^ 0xEDB88320 * (r & 1)
        out.append(r)
    return out


ORACLE_SQL: dict[str, str] = {
    "op2_kd_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
            WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to,
               regexp_replace(url, '[\\r\\n]', '%0A', 'g') AS url
        FROM f
    """,
    "op7_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
        ), f AS (
            SELECT doc_id, line, i, trim(regexp_replace(line, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM l
        ), w AS (
            SELECT doc_id, i, t AS a, lead(t) OVER o AS b, lead(t, 2) OVER o AS c, lead(i) OVER o AS j, lead(i, 2) OVER o AS k
            FROM f WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), g AS (
            SELECT *, min({'doc_id': doc_id, 'i': i, 'j': j, 'k': k}) OVER h AS first
            FROM w WHERE c IS NOT NULL WINDOW h AS (PARTITION BY a, b, c)
        ), m AS (
            SELECT doc_id, unnest([i, j, k]) AS i, CASE WHEN first.doc_id = doc_id THEN [first.i, first.j, first.k] ELSE [] END AS own FROM g
        ), gone AS (
            SELECT DISTINCT doc_id, i FROM m WHERE NOT list_contains(own, i)
        ), r AS (
            SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
                   coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS text
            FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id
        )
        SELECT d.doc_id, r.text, CAST(coalesce(length(r.text), 0) AS BIGINT) AS n_chars, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
    """,
    "op11_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY place) AS turns FROM t GROUP BY conv_id
        ), crc AS (
            SELECT {_crc_table()} AS remainders
        ), h AS (
            SELECT conv_id, turns, CAST(xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                lambda a, b: xor(remainders[CAST(xor(a, b) & 255 AS INTEGER) + 1], a >> 8))) % 4 AS INTEGER) AS h
            FROM c, crc
        ), r AS (
            SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(h.turns, h + 1, len(h.turns))) AS turns
            FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20
        ), p AS (
            SELECT conv_id, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth, turns FROM r
        ), n AS (
            SELECT list_slice(turns, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
            FROM p GROUP BY 1, 2
        ), m AS (
            SELECT n.*, list_slice(path, 1, depth - 1) AS above,
                   CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
            FROM n
        ), k AS (
            SELECT above, depth - 1 AS depth, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY 1, 2
        ), a AS (
            SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN k ON k.above = m.path AND k.depth = m.depth
        ), u AS (
            SELECT list_slice(path, 1, d) AS path, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS d FROM a) GROUP BY 1, 2
        )
        SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
        FROM a JOIN u ON u.path = a.path AND u.depth = a.depth LEFT JOIN a b ON a.depth > 0 AND b.path = a.above AND b.depth = a.depth - 1
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), c AS (
            SELECT count(*) FILTER (WHERE len(terms) > 0) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM d
        ), t AS (
            SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY doc_id, term
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), s AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
            FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
    """,
}
