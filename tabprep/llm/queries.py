"""The queries that apply these operators to their whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, decontaminate, importance, lm, mixing, neardup, pii, repeats, rules, search, tokenfiles, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_importance": importance.op2_importance,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_chat": chat.op6_chat,
    "op7_warc": warc.op7_warc,
    "op8_repeats": repeats.op8_repeats,
    "op8_repeat_groups": repeats.op8_repeat_groups,
    "op9_mixing": mixing.op9_mixing,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_lm_scores": lm.op11_lm_scores,
    "op12_search": search.op12_search,
    "op13_centroids": centroids.op13_centroids,
}

SQL: dict[str, str] = {
    "op1_pii": pii.OP1_SQL,
    "op3_near_duplicates": neardup.OP3_SQL,
    "op5_quality_rules": rules.OP5_SQL,
    "op6_chat": chat.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op12_search": search.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
