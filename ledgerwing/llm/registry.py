"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import op1_token_binary, op2_url_filter, op3_language_id, op4_quality, op5_bpe, op6_jaccard_join, op7_quality_rules, op8_packing, op9_fingerprint, op10_lm, op11_clustering, op12_alignment, op13_secrets

QUERIES = {
    "op1_token_binary": op1_token_binary.op1_token_binary,
    "op2_url_filter": op2_url_filter.op2_url_filter,
    "op3_language_id": op3_language_id.op3_language_id,
    "op4_quality": op4_quality.op4_quality,
    "op5_bpe": op5_bpe.op5_bpe,
    "op6_jaccard_join": op6_jaccard_join.op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules.op7_quality_rules,
    "op8_packing": op8_packing.op8_packing,
    "op9_fingerprint": op9_fingerprint.op9_fingerprint,
    "op10_lm": op10_lm.op10_lm,
    "op11_clustering": op11_clustering.op11_clustering,
    "op12_alignment": op12_alignment.op12_alignment,
    "op13_secrets": op13_secrets.op13_secrets,
}
#: The others have no SQL; their tests hold them against brute force or held-out rows.
ORACLE_SQL = {"op2_url_filter": op2_url_filter.ORACLE_SQL, "op11_clustering": op11_clustering.ORACLE_SQL}
