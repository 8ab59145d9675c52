"""The queries of the numbered operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from kindred.llm import license_scan, line_dedup, source_divergence, suffix_dedup, superkmer_dedup  # noqa: E402  these modules ask for table
from kindred.llm.best_fit_packing import op12_best_fit_packing  # noqa: E402
from kindred.llm.decontamination import op6_decontamination  # noqa: E402
from kindred.llm.language_id import op8_language_id  # noqa: E402
from kindred.llm.periodic_runs import op11_periodic_runs  # noqa: E402
from kindred.llm.quality_rules import op7_quality_rules  # noqa: E402
from kindred.llm.simhash_dedup import op9_simhash_dedup  # noqa: E402
from kindred.llm.source_mixing import op1_source_mixing  # noqa: E402
from kindred.llm.token_output import op2_token_output  # noqa: E402

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_output": op2_token_output,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_superkmer_dedup": superkmer_dedup.op5_superkmer_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}
ORACLES: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_license_scan": license_scan.oracle(),
    "op5_superkmer_dedup": superkmer_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
