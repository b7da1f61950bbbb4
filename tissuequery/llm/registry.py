"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, language_model, license_scan, minhash, mixing, quality_classifier, quality_rules, sharding, token_counts

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_language_model": language_model.op3_language_model,
    "op4_sharding": sharding.op4_sharding,
    "op5_ann": ann.op5_ann,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_minhash": minhash.op7_minhash,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_bpe": bpe.op10_bpe,
}

SQL = {"op1_mixing": mixing.SQL, "op2_quality_rules": quality_rules.SQL}
