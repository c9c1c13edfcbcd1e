"""Queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from lexiforge.llm.decontaminate import op6_benchmark_decontamination
from lexiforge.llm.html import op7_html_extraction
from lexiforge.llm.language import op3_language_id
from lexiforge.llm.licenses import OP10_SQL, op10_license_scan
from lexiforge.llm.linededup import OP5_SQL, op5_line_dedup
from lexiforge.llm.lm import op8_lm_scoring
from lexiforge.llm.minmax import OP2_SQL, op2_minhash_near_dedup
from lexiforge.llm.packing import op1_best_fit_packing
from lexiforge.llm.quality import op4_quality_rules
from lexiforge.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_near_dedup, op3_language_id, op4_quality_rules, op5_line_dedup, op6_benchmark_decontamination, op7_html_extraction, op8_lm_scoring, op9_toxicity, op10_license_scan)}
ORACLE_SQL: dict[str, str] = {"op2_minhash_near_dedup": OP2_SQL, "op5_line_dedup": OP5_SQL, "op10_license_scan": OP10_SQL}
