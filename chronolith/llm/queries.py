"""The registered queries of this package and the SQL that says the same, where SQL can."""

from . import bpe, collocations, conversation_repair, exact_dedup, html_extract, language_id, line_dedup, ngram_join, secrets, source_mix, substring_dedup, toxicity, vector_dedup

QUERIES = {
    "op1_source_mix": source_mix.op1_source_mix,
    "op2_vector_dedup": vector_dedup.op2_vector_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_collocations": collocations.op12_collocations,
    "op13_html_extract": html_extract.op13_html_extract,
}

ORACLES = {
    "op1_source_mix": source_mix.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_secret_scan": secrets.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
