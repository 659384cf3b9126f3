"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from helixframe.llm import chat, collocations, decontam, html_extract, jpeg, line_dedup, mixing, ngram_join, packing, secrets, suffix_dedup, toxicity, variants

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_media_jpeg": jpeg.op2_media_jpeg,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_secrets": secrets.op9_secrets,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_packing": packing.op11_packing,
    "op12_collocations": collocations.op12_collocations,
    "op13_spelling_variants": variants.op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": mixing.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_spelling_variants": variants.ORACLE,
}
