"""The queries of this subpackage and their DuckDB SQL."""

from . import bpe, conversations, decontaminate, divergence, fingerprint, html_text, licenses, near_dups, quality, token_files, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_imatch": fingerprint.op2_imatch,
    "op3_main_text": html_text.op3_main_text,
    "op4_near_duplicates": near_dups.op4_near_duplicates,
    "op5_token_files": token_files.op5_token_files,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_divergence": divergence.op13_divergence,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op4_near_duplicates": near_dups.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_license_scan": licenses.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
