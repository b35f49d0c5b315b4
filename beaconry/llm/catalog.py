"""The operators' registered queries: name -> (Spark query, SQL twin or None)."""
from __future__ import annotations

from beaconry.llm import (
    chaining, content, decontaminate, embedding, grammar, lengths, minhash, mixing, mixing_model, negatives, ranked, secrets, toxicity,
)

QUERIES = {
    "op1_lengths": (lengths.op1_lengths, None),
    "op2_bm25_wand": (decontaminate.op2_bm25_wand, None),
    "op3_chaining": (chaining.op3_chaining, None),
    "op4_lexicon": (toxicity.op4_lexicon, None),
    "op5_repair": (grammar.op5_repair, None),
    "op6_context_mixing": (mixing_model.op6_context_mixing, None),
    "op7_minhash": (minhash.op7_minhash, None),
    "op8_range_join": (embedding.op8_range_join, embedding.ORACLE),
    "op9_mix": (mixing.op9_mix, mixing.ORACLE),
    "op10_token_ratio": (secrets.op10_token_ratio, None),
    "op11_best_position": (ranked.op11_best_position, ranked.ORACLE),
    "op12_hard_negatives": (negatives.op12_hard_negatives, negatives.ORACLE),
    "op13_html_regions": (content.op13_html_regions, None),
}
