"""The queries of this package and their SQL."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, langid, licenses, minhash, mixing, packing, pii, substring_dedup, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_langid": langid.op2_langid,
    "op3_licenses": licenses.op3_licenses,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_pii": pii.op7_pii,
    "license_base": licenses.op3_licenses_base,
    "pii_base": pii.op7_pii_base,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_packing": packing.op9_packing,
    "op10_minhash": minhash.op10_minhash,
}

ORACLES = {
    "op10_minhash": minhash.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "license_base": licenses.BASE_SQL,
    "op6_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "pii_base": pii.BASE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
}
