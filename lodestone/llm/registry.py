"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from . import bpe, decontamination, hard_negatives, html_text, langid, mixing, quality_rules, secrets, simhash, suffixes, token_alignment, token_tables, vectors

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality_rules": quality_rules.query,
    "op3_language_id": langid.query,
    "op4_vectors": vectors.query,
    "op5_secret_scan": secrets.query,
    "op6_suffixes": suffixes.query,
    "op7_token_tables": token_tables.query,
    "op8_bpe_encoding": bpe.query,
    "op9_simhash": simhash.query,
    "op10_html_text": html_text.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_token_alignment": token_alignment.query,
    "op13_decontamination": decontamination.query,
}
SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op4_vectors": vectors.SQL,
    "op6_suffixes": suffixes.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_decontamination": decontamination.SQL,
}
