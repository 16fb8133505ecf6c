"""The queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import divergence, fill_middle, html_text, language_id, lm_scoring, minhash, mixing, nearest, packing, quality_rules, simhash, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_token_files": token_files.query,
        "op3_packing": packing.query,
        "op4_mixing": mixing.query,
        "op5_html_text": html_text.query,
        "op6_lm_scoring": lm_scoring.query,
        "op7_nearest": nearest.query,
        "op8_language_id": language_id.query,
        "op9_simhash": simhash.query,
        "op10_toxicity": toxicity.query,
        "op11_minhash": minhash.query,
        "op12_fill_middle": fill_middle.query,
        "op13_divergence": divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL, "op11_minhash": minhash.SQL, "op12_fill_middle": fill_middle.SQL, "op13_divergence": divergence.SQL}
