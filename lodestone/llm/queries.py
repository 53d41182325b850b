"""The operators' queries and, where SQL can express them, their SQL."""

from . import op1_vptree, op2_packing, op3_toxicity, op4_substring, op5_chat, op6_language, op7_mix, op8_ngram_join, op9_tokens, op10_fingerprint

QUERIES = {
    "op1_vptree": op1_vptree.query,
    "op2_packing": op2_packing.query,
    "op3_toxicity": op3_toxicity.query,
    "op4_substring_dedup": op4_substring.query,
    "op5_chat": op5_chat.query,
    "op6_language": op6_language.query,
    "op7_mix": op7_mix.query,
    "op8_ngram_join": op8_ngram_join.query,
    "op9_tokens": op9_tokens.query,
    "op10_fingerprint": op10_fingerprint.query,
}

ORACLES = {"op1_vptree": op1_vptree.ORACLE, "op4_substring_dedup": op4_substring.ORACLE, "op7_mix": op7_mix.ORACLE, "op8_ngram_join": op8_ngram_join.ORACLE}
