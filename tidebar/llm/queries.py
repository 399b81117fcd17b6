"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, containment, htmltext, licenses, minhash, pii, pqcodes, quality, simple8b, substring, toxicity, vafile, whitening

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_decontamination": containment.op2_decontamination,
    "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simple8b": simple8b.op6_simple8b,
    "op7_quality": quality.op7_quality,
    "op8_va_top_k": vafile.op8_va_top_k,
    "op9_pii_surrogates": pii.op9_pii_surrogates,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_vector_codes": pqcodes.op11_vector_codes,
    "op12_whitening": whitening.op12_whitening,
    "op13_html_text": htmltext.op13_html_text,
}

SQL = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op2_decontamination": containment.OP2_SQL,
    "op3_minhash_near_dedup": minhash.OP3_SQL,
    "op8_va_top_k": vafile.OP8_SQL,
    "op11_vector_codes": pqcodes.OP11_SQL,
}
