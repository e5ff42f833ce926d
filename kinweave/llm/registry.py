"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import annulus, decontaminate, hnsw, language_id, linededup, minhash, mixing, secrets, sharding, spelling, surrogates, topk, toxicity


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_sharding": sharding.op3_sharding,
        "op4_line_dedup": linededup.op4_line_dedup,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_hnsw": hnsw.op6_hnsw,
        "op7_language_id": language_id.op7_language_id,
        "op8_minhash": minhash.op8_minhash,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_pii": surrogates.op10_pii,
        "op11_topk": topk.op11_topk,
        "op12_clustering": annulus.op12_clustering,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": linededup.OP4_SQL,
        "op6_hnsw": hnsw.OP6_SQL,
        "op8_minhash": minhash.OP8_SQL,
        "op9_decontamination": decontaminate.OP9_SQL,
        "op11_topk": topk.OP11_SQL,
        "op12_clustering": annulus.OP12_SQL,
        "op13_spelling": spelling.OP13_SQL,
    }
