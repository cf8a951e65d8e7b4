"""The operators bound to the sample tables, with production parameters."""

from __future__ import annotations

from . import ann, bpe, chosen_path, compact_windows, langid, manifest, merkle, packing, prefix_trie, suffix_tree, token_counts, toxicity, warc
from .common import table


def op1_projected_neighbours(spark, sf_dir):
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), 5)


def op2_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_merkle_fingerprints(spark, sf_dir):
    return merkle.fingerprints_of_edits(table(spark, sf_dir, "documents"))


def op4_chosen_path_join(spark, sf_dir):
    return chosen_path.similar_texts(table(spark, sf_dir, "documents"))


def op5_compact_windows(spark, sf_dir):
    return compact_windows.duplicate_passages(table(spark, sf_dir, "documents"))


def op6_suffix_tree_scores(spark, sf_dir):
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return langid.predictions(table(spark, sf_dir, "documents"))


def op10_column_generation_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return manifest.tampered_proofs(table(spark, sf_dir, "documents"))


def op12_convolutional_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_projected_neighbours, op2_warc_round_trip, op3_merkle_fingerprints, op4_chosen_path_join, op5_compact_windows, op6_suffix_tree_scores, op7_bpe_round_trip, op8_token_counts, op9_language_id, op10_column_generation_packing, op11_merkle_manifest, op12_convolutional_toxicity, op13_prefix_trie)}

#: Payload digests: SHA-1 as hex, and each ten digits as eight of base32.
WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS response FROM h),
n AS (SELECT *, list_transform([1, 11, 21, 31], lambda i: ('0x' || substr(hex, i, 10))::UBIGINT) AS parts FROM r)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM n
"""

#: The join by its definition: all pairs that share a shingle, and the
#: smallest doc_id that each document reaches over links.
JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\x09-\x0D\x20]')),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT d.doc_id, m.class_id, coalesce(k.n, 0)::BIGINT AS n_links FROM documents d
JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) m ON m.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = d.doc_id
"""

ORACLE_SQL = {"op2_warc_round_trip": WARC_SQL, "op3_merkle_fingerprints": merkle.SQL, "op4_chosen_path_join": JOIN_SQL, "op11_merkle_manifest": manifest.SQL, "op13_prefix_trie": prefix_trie.SQL}
