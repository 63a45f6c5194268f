"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stillkeep.llm import decontaminate, exact_dedup, html_text, licenses, line_dedup, lm_scoring, near_dedup, packing, phrases, secrets, spelling, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_lm_scoring": lm_scoring.op11_lm_scoring,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_collocations": phrases.op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_lm_scoring": lm_scoring.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_collocations": phrases.ORACLE_SQL,
}
