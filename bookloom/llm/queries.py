"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from bookloom.llm import best_fit_packing, chat_format, context_tree, conversation_repair, fuzzy_lines, qdwh_whitening, quality_cascade, secret_forest, simhash_documents, sparse_suffix, tag_path_ratios, template_decontamination, warc_salvage


def queries() -> dict:
    return {
        "op1_template_decontamination": template_decontamination.op1_template_decontamination,
        "op2_fuzzy_line_dedup": fuzzy_lines.op2_fuzzy_line_dedup,
        "op3_tag_path_ratios": tag_path_ratios.op3_tag_path_ratios,
        "op4_quality_cascade": quality_cascade.op4_quality_cascade,
        "op5_sparse_suffix": sparse_suffix.op5_sparse_suffix,
        "op6_best_fit_packing": best_fit_packing.op6_best_fit_packing,
        "op7_context_tree_weighting": context_tree.op7_context_tree_weighting,
        "op8_warc_salvage": warc_salvage.op8_warc_salvage,
        "op9_secret_forest": secret_forest.op9_secret_forest,
        "op10_simhash_near_dedup": simhash_documents.op10_simhash_near_dedup,
        "op11_qdwh_whitening": qdwh_whitening.op11_qdwh_whitening,
        "op12_chat_round_trip": chat_format.op12_chat_round_trip,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict:
    return {"op1_template_decontamination": template_decontamination.ORACLE_SQL, "op4_quality_cascade": quality_cascade.ORACLE_SQL, "op12_chat_round_trip": chat_format.ORACLE_SQL}
