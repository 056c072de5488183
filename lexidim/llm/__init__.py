"""Operators for preparing training corpora, and the queries that apply them.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lexidim.llm import decontamination, licenses, line_dedup, packing, pii, quality_classifier, quality_rules, secrets, similarity_join, toxicity

    return {
        "op1_packing": packing.op1_packing,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_licenses": licenses.op4_licenses,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_secrets": secrets.op6_secrets,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_pii": pii.op8_pii,
        "op9_ngram_jaccard": similarity_join.op9_ngram_jaccard,
        "op10_decontamination": decontamination.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    from lexidim.llm import line_dedup

    return {"op7_line_dedup": line_dedup.OP7_SQL}
