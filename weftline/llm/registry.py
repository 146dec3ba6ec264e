"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import op2_neardup, op5_mixing, op7_minhash
from weftline.llm.op1_quality import op1_quality
from weftline.llm.op10_langid import op10_langid
from weftline.llm.op3_sentencepiece import op3_sentencepiece
from weftline.llm.op4_neighbours import op4_neighbours
from weftline.llm.op6_secrets import op6_secrets
from weftline.llm.op8_lm import op8_lm
from weftline.llm.op9_toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_neardup": op2_neardup.op2_neardup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_neighbours": op4_neighbours,
        "op5_mixing": op5_mixing.op5_mixing,
        "op6_secrets": op6_secrets,
        "op7_minhash": op7_minhash.op7_minhash,
        "op8_lm": op8_lm,
        "op9_toxicity": op9_toxicity,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_neardup": op2_neardup.ORACLE_SQL,
        "op5_mixing": op5_mixing.ORACLE_SQL,
        "op7_minhash": op7_minhash.ORACLE_SQL,
    }
