"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import op1_multi_index, op2_token_planes, op3_minhash, op4_token_counts, op5_mixing, op6_toxicity, op7_decontamination, op8_line_dedup, op9_quality, op10_html

MODULES = (op1_multi_index, op2_token_planes, op3_minhash, op4_token_counts, op5_mixing, op6_toxicity, op7_decontamination, op8_line_dedup, op9_quality, op10_html)


def queries() -> dict:
    return {m.__name__.rpartition(".")[2]: getattr(m, m.__name__.rpartition(".")[2]) for m in MODULES}


def oracle_sql() -> dict:
    return {m.__name__.rpartition(".")[2]: m.SQL for m in MODULES if hasattr(m, "SQL")}
