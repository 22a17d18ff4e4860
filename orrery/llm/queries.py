"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import ann, bpe, exact_dedup, line_dedup, mixing, near_dedup, secrets, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": ann.op1_ann,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_warc": warc.op5_warc,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_secrets": secrets.op9_secrets,
    "op10_bpe": bpe.op10_bpe,
}

SQL: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
