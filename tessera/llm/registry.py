"""The queries of this subpackage, and their DuckDB SQL where there is any."""

from . import chat, decontaminate, exact_dedup, langid, mixing, near_dedup, pii, quality, spelling, suffix_dedup, token_output, toxicity, whitening

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_token_output": token_output.op3_token_output,
    "op4_quality": quality.op4_quality,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pii": pii.op7_pii,
    "op8_chat_format": chat.op8_chat_format,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_spelling": spelling.op12_spelling,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op5_mix_sources": mixing.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}

