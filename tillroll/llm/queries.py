"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm.ann import op2_ann
from tillroll.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from tillroll.llm.line_dedup import OP1_SQL, op1_line_dedup
from tillroll.llm.mixing import op8_mixing
from tillroll.llm.packing import op4_packing
from tillroll.llm.periodic import op12_periodic_runs
from tillroll.llm.pii import OP9_SQL, op9_pii
from tillroll.llm.quality import op6_quality
from tillroll.llm.sharding import OP3_SQL, op3_sharding
from tillroll.llm.simhash import op7_simhash
from tillroll.llm.substring import op10_substring_dedup
from tillroll.llm.token_files import op11_token_files
from tillroll.llm.topk import OP5_SQL, op5_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ann": op2_ann,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_files": op11_token_files,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op3_sharding": OP3_SQL,
    "op5_topk": OP5_SQL,
    "op9_pii": OP9_SQL,
    "op13_hard_negatives": OP13_SQL,
}
