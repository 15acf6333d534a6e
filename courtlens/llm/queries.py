"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, jaccard, langid, licenses, lsm, packing, perplexity, pii, tokenpack, urlmodel

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_lsm_exact_dedup": lsm.op2_lsm_exact_dedup,
    "op4_best_two_fit": packing.op4_best_two_fit,
    "op5_pii": pii.op5_pii,
    "op3_url_model": urlmodel.op3_url_model,
    "op6_language": langid.op6_language,
    "op7_token_rows": tokenpack.op7_token_rows,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_perplexity": perplexity.op10_perplexity,
}

ORACLE_SQL = {"op2_lsm_exact_dedup": lsm.OP2_SQL, "op8_ngram_jaccard": jaccard.OP8_SQL}
