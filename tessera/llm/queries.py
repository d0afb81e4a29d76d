"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode, tokenizer_path
from .common import table
from .exact_dedup import exact_groups
from .html_extract import extract
from .importance import importance_resample
from .jaccard_join import jaccard_components
from .mixing import mix_counts
from .periodic_runs import periodic_runs, planted, run_digests
from .quality import quality_scores
from .repetition import repetition
from .suffix_repeats import repeated_spans
from .toxicity import toxicity_scores
from .url_filter import url_filter
from .warc import archived


def op1_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


def op3_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def op4_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op7_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op8_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("n_classes")


def op9_url_segment_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_harmonic_grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op12_segmented_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op13_inverted_postings_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_min_cut_text": op1_min_cut_text,
    "op2_low_discrepancy_mix": op2_low_discrepancy_mix,
    "op3_repetition_coverage": op3_repetition_coverage,
    "op4_subsequence_kernel_toxicity": op4_subsequence_kernel_toxicity,
    "op5_nb_svm_quality": op5_nb_svm_quality,
    "op6_sparse_suffix_repeats": op6_sparse_suffix_repeats,
    "op7_content_sort_dedup": op7_content_sort_dedup,
    "op8_signature_tree_join": op8_signature_tree_join,
    "op9_url_segment_bayes": op9_url_segment_bayes,
    "op10_trie_bpe": op10_trie_bpe,
    "op11_harmonic_grid_runs": op11_harmonic_grid_runs,
    "op12_segmented_warc": op12_segmented_warc,
    "op13_inverted_postings_resample": op13_inverted_postings_resample,
}


def _crc32(bytes_of: str) -> str:
    """SQL for the checksum of a list of byte values: each byte goes in, then eight bits are shifted out."""
    steps = f"flatten(list_transform({bytes_of}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    reduced = f"list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor({reduced}, 4294967295)"

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BYTES = "list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"

ORACLE: dict[str, str] = {
    "op11_harmonic_grid_runs": rf"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l,
                   {_crc32(_BYTES.format("doc_id::VARCHAR"))} AS h
            FROM documents
        ), g AS (
            SELECT r, doc_id, l, len(l) AS n, h % 10 = 0 AND len(l) > 0 AS again, (h // 10) % len(l) AS a, h // 10 AS g FROM d
        ), w AS MATERIALIZED (
            SELECT r, doc_id, n, CASE WHEN again THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN l[i + 1] ELSE l[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE l END AS l
            FROM g
        ), s AS MATERIALIZED (
            SELECT r, n, i, array_to_string(l[i + 1:i + 16], ' ') AS t FROM (SELECT *, unnest(range(0, n - 15)) AS i FROM w WHERE n >= 24)
        ), q AS (
            SELECT x.r, x.i, y.i - x.i AS p FROM s x JOIN s y ON x.r = y.r AND x.t = y.t AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
        ), f AS (
            SELECT r, p, min(i) AS start, count(*) + 15 + p AS length
            FROM (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM q) GROUP BY r, p, k
        ), u AS MATERIALIZED (
            SELECT r, start, length, min(p) AS period FROM f WHERE length >= greatest(24, 3 * p) GROUP BY r, start, length
        ), c AS (
            SELECT r, sha256(coalesce(string_agg(t, ' ' ORDER BY i), '')) AS collapsed_sha256
            FROM (SELECT r, unnest(range(0, n)) AS i, unnest(l) AS t FROM w) v
            WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = v.r AND v.i >= u.start + u.period AND v.i < u.start + u.length) GROUP BY r
        ), o AS (
            SELECT r, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256 FROM u GROUP BY r
        ), b AS (
            SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
        FROM w LEFT JOIN o USING (r) LEFT JOIN b USING (r) LEFT JOIN c USING (r)
    """,
    "op12_segmented_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest, min(page_id) OVER (PARTITION BY b) AS first FROM p),
        r AS (SELECT *, payload_bytes >= 100 AND first <> page_id AS again FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first END AS refers_to, true AS intact
        FROM r
    """,
    "op13_inverted_postings_resample": rf"""
        WITH l AS MATERIALIZED (
            SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
            FROM (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
        ), f AS MATERIALIZED (
            SELECT side, doc_id, f, count(*) AS n
            FROM (SELECT side, doc_id, unnest(l) AS f FROM l UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM l) GROUP BY ALL
        ), k AS MATERIALIZED (
            SELECT f, {_crc32(_BYTES.format("f"))} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f)
        ), s AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM f JOIN k USING (f) GROUP BY bucket),
        g AS MATERIALIZED (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s
        ), m AS (
            SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM f JOIN k USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id
        ), c AS (
            SELECT doc_id, len(l) >= 20 AS counts, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM l LEFT JOIN m USING (doc_id) WHERE side = 0
        ), o AS (SELECT *, row_number() OVER (PARTITION BY counts ORDER BY score DESC, doc_id) AS place, count(*) FILTER (counts) OVER () AS eligible FROM c)
        SELECT doc_id, n_features, weight, score, CASE WHEN counts AND place <= 25 * eligible // 100 THEN place END AS rank FROM o
    """,
    "op7_content_sort_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op8_signature_tree_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
            FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, hash(array_to_string(l[i:i + 4], ' ')) AS g
            FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)
        ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ), e AS MATERIALIZED (
            SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
    """,
}
