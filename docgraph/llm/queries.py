"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, exact_dedup, hard_negatives, html_extract, line_dedup, manifest, minhash, mixing, pii, quality, secret_scan, warc
from .common import read_table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(read_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal_data(read_table(spark, sf_dir, "documents"))


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged_replica(pages))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: null text has no tokens, null and repeated ids are kept."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.token_digest(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: any column may be null, rows that share a doc_id go by their leaves."""
    return manifest.audit_tampered(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten rows for each anchor and positive: rows with a null label or vector, or a component that is null or not finite, take no part."""
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_decontamination,
        op3_exact_dedup,
        op4_line_dedup,
        op5_quality_classifier,
        op6_secret_scan,
        op7_source_mixing,
        op8_minhash_near_dedup,
        op9_personal_data,
        op10_warc_audit,
        op11_byte_bpe,
        op12_merkle_manifest,
        op13_hard_negatives,
    )
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        WITH n AS (SELECT doc_id, sha256({_NORM}) AS h FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept,
               h AS text_sha256
        FROM n""",
    "op8_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array({_NORM}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (
          SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (
          SELECT doc_id AS id, doc_id AS r FROM documents
          UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS c FROM reach GROUP BY 1) m ON m.id = d.doc_id""",
}

_CRLF = "chr(13) || chr(10)"


def _record(html: str) -> str:
    return (
        f"'WARC/1.0' || {_CRLF} || 'WARC-Type: response' || {_CRLF} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {_CRLF}"
        f" || 'WARC-Target-URI: ' || url || {_CRLF} || 'Content-Length: ' || strlen({html}) || {_CRLF} || {_CRLF}"
        f" || {html} || {_CRLF} || {_CRLF}"
    )


_PLACED = """sum(strlen(r)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id, copy)::BIGINT - strlen(r)"""

ORACLE_SQL["op10_warc_audit"] = f"""
    WITH h AS (
      SELECT page_id, url, html, left(md5(page_id::VARCHAR), 2) AS code FROM pages),
    s AS (
      SELECT page_id, url, unnest(CASE code WHEN '02' THEN []::BIGINT[] WHEN '04' THEN [0, 1] ELSE [0] END)::BIGINT AS copy,
        CASE code WHEN '00' THEN chr(1) || substr(html, 2) WHEN '01' THEN repeat('0', strlen(html)) WHEN '03' THEN left(html, length(html) // 2) ELSE html END AS spoilt FROM h),
    a AS (SELECT page_id, 0::BIGINT AS copy, {_record("html")} AS r FROM h),
    b AS (SELECT page_id, copy, {_record("spoilt")} AS r FROM s),
    x AS (SELECT page_id, copy, r, {_PLACED} AS p FROM a),
    y AS (SELECT page_id, copy, r, {_PLACED} AS p FROM b),
    f AS (SELECT coalesce(x.page_id, y.page_id) AS page_id, coalesce(x.copy, y.copy) AS copy, x.r AS a, y.r AS b, x.p AS pa, y.p AS pb
      FROM x FULL JOIN y ON x.page_id = y.page_id AND x.copy = y.copy)
    SELECT page_id, page_id // 1024 AS archive, page_id % 1024 AS slot, copy,
           CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' WHEN a <> b THEN 'altered' ELSE 'moved' END AS status,
           pa AS "offset", pb AS replica_offset, strlen(a)::BIGINT AS length, strlen(b)::BIGINT AS replica_length
    FROM f WHERE a IS NULL OR b IS NULL OR a <> b OR pa <> pb"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
#: CRC-32 byte by byte, by the table of its polynomial.
_CRC = "list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)"
_UP = """SELECT tree, level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY tree, level, idx // 3""".format
_FOLD = """SELECT doc_id, leaf, f.tree, f.level + 1, idx // 3, sha256(array_to_string(hs[1:idx % 3], '') || own || array_to_string(hs[idx % 3 + 2:], '')),
    sibs || array_to_string(hs[1:idx % 3], '') || array_to_string(hs[idx % 3 + 2:], '')
  FROM {0} f JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.idx // 3""".format

ORACLE_SQL["op12_merkle_manifest"] = f"""
    WITH RECURSIVE crcs AS (
      SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc),
    leaves AS (
      SELECT doc_id, coalesce('s' || source, '-') AS tree, {_LEAF("text")} AS leaf,
        CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS own
      FROM documents, crcs),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    up AS (SELECT tree, 0 AS level, idx, n, leaf AS h FROM placed UNION ALL {_UP("up")}),
    subroots AS (
      SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
    top AS (SELECT '' AS tree, 0 AS level, place AS idx, n, h FROM subroots UNION ALL {_UP("top")}),
    runs AS (
      SELECT tree, level, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM (FROM up UNION ALL FROM top) WHERE n > 1 GROUP BY ALL),
    f1 AS (SELECT doc_id, leaf, tree, 0 AS level, idx, own, '' AS sibs FROM placed UNION ALL {_FOLD("f1")}),
    f2 AS (
      SELECT doc_id, leaf, '' AS tree, 0 AS level, place AS idx, own, sibs
      FROM f1 JOIN (SELECT tree, max(level) AS level FROM up GROUP BY 1) USING (tree, level) JOIN subroots USING (tree)
      UNION ALL {_FOLD("f2")})
    SELECT f2.doc_id, f2.leaf, s.h AS subroot, t.h AS root, sha256(sibs) AS proof_sha256, f2.own AS folded_root, f2.own = t.h AS verified
    FROM f2 JOIN (SELECT level, h FROM top WHERE n = 1) t ON t.level = f2.level
    JOIN placed p ON p.doc_id IS NOT DISTINCT FROM f2.doc_id AND p.leaf = f2.leaf JOIN subroots s ON s.tree = p.tree"""

ORACLE_SQL["op13_hard_negatives"] = """
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS "rank",
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
