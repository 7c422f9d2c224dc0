"""The queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from plexgraph.llm import flac, licenses, minhash, mixing, packing, quality, secrets, sharding, suffix_dedup, topk


def queries() -> dict:
    return {
        "op1_topk_search": topk.op1,
        "op2_best_fit_packing": packing.op2,
        "op3_secret_scan": secrets.op3,
        "op4_quality_classifier": quality.op4,
        "op5_minhash_dedup": minhash.op5,
        "op6_media_columns": flac.op6,
        "op7_sharding": sharding.op7,
        "op8_suffix_dedup": suffix_dedup.op8,
        "op9_license_scan": licenses.op9,
        "op9_short_notices": licenses.op9_short,
        "op10_source_mix": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_license_scan": licenses.oracle(), "op1_topk_search": topk.ORACLE_SQL, "op10_source_mix": mixing.ORACLE_SQL}
