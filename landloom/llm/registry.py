"""Queries of this folder, and SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, collision, counts, hmm, kdtrees, mixing, nndescent, packing, secrets, sharding, simhash, toxicity, urls

QUERIES = {
    "op10_simhash_near_dedup": simhash.query,
    "op11_token_counts": counts.query,
    "op12_tokenizer_alignment": alignment.query,
    "op13_centroid_clustering": kdtrees.query,
    "op1_toxicity": toxicity.query,
    "op4_embedding_near_dedup": nndescent.query,
    "op5_nearest_neighbours": collision.query,
    "op6_lm_scoring": hmm.query,
    "op7_sharding": sharding.query,
    "op8_mixing": mixing.query,
    "op9_secret_scans": secrets.query,
    "op2_url_filters": urls.query,
    "op3_best_fit_packing": packing.query,
}
ORACLE_SQL: dict[str, str] = {
    "op13_centroid_clustering": kdtrees.sql(),
    "op8_mixing": mixing.sql(),
}
