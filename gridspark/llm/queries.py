"""The registered queries of this folder and their checking SQL."""

from __future__ import annotations

from . import alignment, bpe, chat, decontaminate, exact_dedup, jaccard, langid, media, packing, periodic, suffix_dedup, token_cache, toxicity

QUERIES = {
    "op1_chat_tools": chat.op1_chat_tools,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_media_columns": media.op7_media_columns,
    "op8_langid": langid.op8_langid,
    "op9_packing": packing.op9_packing,
    "op10_token_counts": token_cache.op10_token_counts,
    "op11_alignment": alignment.op11_alignment,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}
ORACLES = {
    "op1_chat_tools": chat.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op12_periodic_runs": periodic.OP12_SQL,
    "op13_decontaminate": decontaminate.OP13_SQL,
}
