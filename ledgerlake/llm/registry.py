"""The training-data queries: one for each operator over its whole table, and the pipeline."""
from __future__ import annotations

import corpus_pipeline
from ledgerlake.llm import (chat, embeddings, fill_middle, lines, mixing, near_text, outliers, packing, personal_data,
                            quality, token_counts, toxicity, whitening)
from ledgerlake.llm.common import table


def _over(name: str, contract):
    return lambda spark, sf_dir: contract(spark, table(spark, sf_dir, name))


def queries() -> dict:
    return {
        "op1_personal_data": _over("documents", personal_data.contract),
        "op2_token_counts": _over("documents", token_counts.contract),
        "op3_quality_classifier": lambda spark, sf_dir: quality.contract(
            spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op4_best_fit_packing": _over("documents", packing.contract),
        "op5_simhash_near_dedup": _over("documents", near_text.contract),
        "op6_chat_formatting": _over("conversations", chat.contract),
        "op7_quality_rules": _over("documents", outliers.contract),
        "op8_mix_sources": _over("documents", mixing.contract),
        "op9_line_dedup": _over("documents", lines.contract),
        "op10_embedding_near_dedup": _over("embeddings", embeddings.contract),
        "op11_embedding_whitening": _over("embeddings", whitening.contract),
        "op12_fill_in_middle": _over("documents", fill_middle.contract),
        "op13_toxicity": lambda spark, sf_dir: toxicity.contract(
            spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": chat.ORACLE, "op8_mix_sources": mixing.ORACLE, "op9_line_dedup": lines.ORACLE,
            "op10_embedding_near_dedup": embeddings.ORACLE, "op12_fill_in_middle": fill_middle.ORACLE}
