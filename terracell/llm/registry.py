"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, centroids, decontamination, line_dedup, mixing, ngram_join, pii, secrets, substring_dedup, telephony, token_ids, toxicity, whitening

_QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_pii": pii.op5_pii,
    "op6_token_ids": token_ids.op6_token_ids,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_secrets": secrets.op8_secrets,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_telephony": telephony.op10_telephony,
    "op11_whitening": whitening.op11_whitening,
    "op12_bpe": bpe.op12_bpe,
    "op13_centroids": centroids.op13_centroids,
    # Columns of the contracts that SQL can express, each through its operator.
    "mixing_targets": mixing.mixing_targets,
    "pii_base_counts": pii.pii_base_counts,
    "secret_base_counts": secrets.secret_base_counts,
    "telephony_payloads": telephony.telephony_payloads,
    "whitening_deviations": whitening.whitening_deviations,
}
_SQL = {"op3_line_dedup": line_dedup.OP3_SQL, "op7_substring_dedup": substring_dedup.OP7_SQL, "op9_decontamination": decontamination.OP9_SQL,
        "mixing_targets": mixing.TARGETS_SQL, "pii_base_counts": pii.BASE_SQL, "secret_base_counts": secrets.BASE_SQL, "telephony_payloads": telephony.PAYLOAD_SQL,
        "whitening_deviations": whitening.DEVIATION_SQL, "op13_centroids": centroids.OP13_SQL}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
