"""Queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bytecnn, collocations, filteraudit, mixing, neardup, neighbours, packing, piecewise, secrets, suffixes, tokenfiles, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest_neighbours": neighbours.op1_nearest_neighbours,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_token_files": tokenfiles.op3_token_files,
        "op4_mixing": mixing.op4_mixing,
        "op5_suffix_dedup": suffixes.op5_suffix_dedup,
        "op6_near_duplicates": neardup.op6_near_duplicates,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_packing": packing.op8_packing,
        "op9_fingerprints": piecewise.op9_fingerprints,
        "op10_url_filter": urls.op10_url_filter,
        "op11_collocations": collocations.op11_collocations,
        "op12_filter_audit": filteraudit.op12_filter_audit,
        "op13_quality_classifier": bytecnn.op13_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_filter_audit": filteraudit.ORACLE_SQL}
