"""Queries of the text operators and, where SQL can say it, the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stationflow.llm.decontamination import DECONTAMINATION_SQL, decontamination_query
from stationflow.llm.fingerprints import FINGERPRINT_SQL, fingerprint_query
from stationflow.llm.language import language_query
from stationflow.llm.lm_scoring import lm_query
from stationflow.llm.mixing import MIXING_SQL, mixing_query
from stationflow.llm.near_duplicates import NEAR_DUPLICATE_SQL, near_duplicate_query
from stationflow.llm.periodic_runs import periodic_runs_query
from stationflow.llm.quality import quality_query
from stationflow.llm.ranked_search import RANKED_SEARCH_SQL, ranked_search_query
from stationflow.llm.segmentations import segmentation_query
from stationflow.llm.token_counts import token_counts_query
from stationflow.llm.token_files import token_files_query
from stationflow.llm.toxicity import toxicity_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_query,
    "op2_segmentations": segmentation_query,
    "op3_token_files": token_files_query,
    "op4_quality_rules": quality_query,
    "op5_fingerprints": fingerprint_query,
    "op6_mixing": mixing_query,
    "op7_near_duplicates": near_duplicate_query,
    "op8_token_counts": token_counts_query,
    "op9_toxicity": toxicity_query,
    "op10_language": language_query,
    "op11_periodic_runs": periodic_runs_query,
    "op12_ranked_search": ranked_search_query,
    "op13_decontamination": decontamination_query,
}

ORACLES: dict[str, str] = {
    "op5_fingerprints": FINGERPRINT_SQL,
    "op6_mixing": MIXING_SQL,
    "op7_near_duplicates": NEAR_DUPLICATE_SQL,
    "op12_ranked_search": RANKED_SEARCH_SQL,
    "op13_decontamination": DECONTAMINATION_SQL,
}
