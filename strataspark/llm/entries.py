"""The queries of this subpackage by name, with their oracle SQL. The pipeline of corpus_pipeline.py is added in __spark_entry__.py."""

from __future__ import annotations

from . import op1_projected_ann, op2_topk, op3_mixing, op4_url_filter, op5_line_dedup, op6_license, op7_ngram_join, op8_packing, op9_secrets, op10_toxicity, op11_centroids, op12_near_vectors, op13_prefix_trie

QUERIES = {
    "op1_projected_ann": (op1_projected_ann.query, None),
    "op2_norm_bucketed_topk": (op2_topk.query, op2_topk.ORACLE),
    "op3_source_mixing": (op3_mixing.query, None),
    "op4_url_filter": (op4_url_filter.query, None),
    "op5_line_dedup": (op5_line_dedup.query, op5_line_dedup.ORACLE),
    "op6_license_scan": (op6_license.query, op6_license.ORACLE),
    "op7_ngram_join": (op7_ngram_join.query, op7_ngram_join.ORACLE),
    "op8_best_fit_packing": (op8_packing.query, None),
    "op9_secret_scan": (op9_secrets.query, op9_secrets.ORACLE),
    "op10_toxicity": (op10_toxicity.query, None),
    "op11_centroid_clustering": (op11_centroids.query, op11_centroids.ORACLE),
    "op12_near_duplicate_vectors": (op12_near_vectors.query, op12_near_vectors.ORACLE),
    "op13_prefix_trie": (op13_prefix_trie.query, op13_prefix_trie.ORACLE),
}


def queries():
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
