"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from causeway.llm import chat, collocations, decontaminate, exact_dedup, lexical, licenses, line_dedup, mixing, near_dup, secrets, sharding, topk, toxicity


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_exact_topk": topk.op3_exact_topk,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_near_duplicates": near_dup.op6_near_duplicates,
        "op7_hilbert_sharding": sharding.op7_hilbert_sharding,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_format_chats": chat.op9_format_chats,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_ranked_search": lexical.op11_ranked_search,
        "op12_collocations": collocations.op12_collocations,
        "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.OP1_SQL, "op2_line_dedup": line_dedup.OP2_SQL, "op3_exact_topk": topk.OP3_SQL, "op6_near_duplicates": near_dup.OP6_SQL, "op9_format_chats": chat.OP9_SQL, "op11_ranked_search": lexical.OP11_SQL, "op12_collocations": collocations.OP12_SQL, "op13_exact_dedup": exact_dedup.OP13_SQL}
