"""The registered queries of this package and their SQL."""

from __future__ import annotations

from linkgrove.llm import decontaminate, htmltext, linededup, lm, oracles, packing, quality, sharding, simhash, suffixdedup, tokenfiles

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_suffix_dedup": suffixdedup.op5_suffix_dedup,
    "op6_html_extraction": htmltext.op6_html_extraction,
    "op7_quality_rules": quality.op7_quality,
    "op8_sharding": sharding.op8_sharding,
    "op9_token_files": tokenfiles.op9_token_files,
    "op10_line_dedup": linededup.op10_line_dedup,
}

#: The others have no SQL: XXH64, CRC-32, tokenizers, EM or suffix order; tests hold them against brute force.
ORACLE = {
    "op7_quality_rules": oracles.quality(),
    "op10_line_dedup": oracles.line_dedup(),
}
