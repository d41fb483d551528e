"""The subpackage's queries, one for each operator, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_bpe
from .html_text import op6_html_text
from .katz import op3_katz
from .latent import op7_decontamination
from .line_dedup import op10_line_dedup
from .near_dup import op2_near_duplicates
from .nbsvm import op5_quality_classifier
from .repetition import op1_quality_rules
from .secrets import op8_secrets
from .token_counts import op4_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_katz": op3_katz,
        "op4_token_counts": op4_token_counts,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_html_text": op6_html_text,
        "op7_decontamination": op7_decontamination,
        "op8_secrets": op8_secrets,
        "op9_bpe": op9_bpe,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {}
