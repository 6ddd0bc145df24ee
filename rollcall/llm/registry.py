"""Queries of the subpackage, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, mixing, quality, secrets, simhash, substrings, token_counts, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact.op1_exact_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_secret_ledger": secrets.op4_secret_ledger,
        "op5_url_equivalence": urls.op5_url_equivalence,
        "redirect_aliases": urls.redirect_aliases,
        "op6_simhash_golay": simhash.op6_simhash_golay,
        "op7_bpe": bpe.op7_bpe,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_substring_cdc": substrings.op9_substring_cdc,
        "op10_separator_scan": token_counts.op10_separator_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact.OP1_SQL, "op4_secret_ledger": secrets.OP4_SQL, "op5_url_equivalence": urls.OP5_SQL, "redirect_aliases": urls.REDIRECT_SQL}
