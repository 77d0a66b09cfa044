"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from repeatlake.llm import bpe, codes, digests, divergence, embeddings, extraction, language, packing, privacy, scoring, simhash, tokens, toxicity

QUERIES = {
    "op1_html_extraction": extraction.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_language_id": language.query,
    "op4_lm_scoring": scoring.query,
    "op5_embedding_near_dedup": embeddings.query,
    "op6_document_fingerprints": digests.query,
    "op7_token_counts": tokens.query,
    "op8_toxicity": toxicity.query,
    "op9_best_fit_packing": packing.query,
    "op10_bpe_round_trip": bpe.query,
    "op11_source_divergence": divergence.query,
    "op12_private_terms": privacy.query,
    "op13_vector_codes": codes.query,
}

#: Links by brute force over all pairs, and components by a closure: for tables of thousands of vectors.
OP5 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM vectors
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id < b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), many AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN many USING (vec_id)
"""

ORACLE_SQL: dict[str, str] = {"op5_embedding_near_dedup": OP5, "op11_source_divergence": divergence.SQL, "op12_private_terms": privacy.SQL, "op13_vector_codes": codes.oracle()}
