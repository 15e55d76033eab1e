"""The queries of these operators, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, embeddings, exact_dedup, licenses, mixing, packing, quality, sharding, simhash, substring, tokens, trie, variants

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_substring": substring.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_licenses": licenses.query,
    "op5_quality": quality.query,
    "op6_token_counts": tokens.query,
    "op7_embeddings": embeddings.query,
    "op8_packing": packing.query,
    "op9_sharding": sharding.query,
    "op10_mixing": mixing.query,
    "op11_bpe": bpe.query,
    "op12_variants": variants.query,
    "op13_trie": trie.query,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_embeddings": embeddings.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_variants": variants.ORACLE,
    "op13_trie": trie.ORACLE,
}
