"""The queries of the numbered operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import decontaminate, flac, htmltext, interaction, langid, linededup, lm, minhash, mixing, quality, spelling, topk, toxicity

QUERIES = {
    "op1_deleted_interpolation": lm.op1,
    "op2_subword_quality": quality.op2,
    "op3_benchmark_decontamination": decontaminate.op3,
    "op4_line_dedup": linededup.op4,
    "op5_toxicity": toxicity.op5,
    "op6_template_extraction": htmltext.op6,
    "op7_byte_cnn_language": langid.op7,
    "op8_flac_media": flac.op8,
    "op9_source_mixing": mixing.op9,
    "op10_minhash_near_dedup": minhash.op10,
    "op11_filter_interaction": interaction.op11,
    "op12_exact_top_k": topk.op12,
    "op13_spelling_variants": spelling.op13,
}

ORACLES = {
    "op3_benchmark_decontamination": decontaminate.ORACLE,
    "op6_template_extraction": htmltext.ORACLE,
    "op9_source_mixing": mixing.ORACLE,
    "op10_minhash_near_dedup": minhash.ORACLE,
    "op11_filter_interaction": interaction.ORACLE,
    "op12_exact_top_k": topk.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
