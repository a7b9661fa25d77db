"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, doc_simhash, maxent, mips, near_simhash, packing, para_dedup, pii, toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_weak_pii": pii.op3_weak_pii,
        "op4_simhash_near_dedup": near_simhash.op4_simhash_near_dedup,
        "op5_chat_format": chat.op5_chat_format,
        "op6_exact_top_k": mips.op6_exact_top_k,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_maxent_scores": maxent.op8_maxent_scores,
        "op9_weighted_simhash": doc_simhash.op9_weighted_simhash,
        "op10_passage_dedup": para_dedup.op10_passage_dedup,
    }


def oracle_sql() -> dict:
    return {"op5_chat_format": chat.OP5_SQL, "op6_exact_top_k": mips.OP6_SQL}
