"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, checks, exact_dedup, lm_scoring, mixing, near_dedup, neighbours, packing, prefix_trie, repeats, secrets, sharding, spelling, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op5_lm_scoring_trigrams": lm_scoring.op5_lm_scoring_trigrams,
    "op6_sharding": sharding.op6_sharding,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_repeats": repeats.op8_repeats,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_packing": packing.op10_packing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_bpe": bpe.op12_bpe,
    "op13_spelling": spelling.op13_spelling,
    **checks.QUERIES,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op5_lm_scoring": lm_scoring.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_spelling": spelling.ORACLE,
    **checks.ORACLES,
}
