"""The operators as registered queries, next to their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineout.llm import bpe, chat, decontaminate, licenses, lm_scores, mixing, near_dedup, negatives, phrases, resampling, rules, toxicity, urls
from lineout.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(table(spark, folder, name))


def _labelled(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(table(spark, folder, "documents"), table(spark, folder, "labels"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": _over("documents", near_dedup.op1_near_dedup),
        "op2_quality_classifier": _labelled(resampling.op2_quality_classifier),
        "op3_decontaminate": lambda spark, folder: decontaminate.op3_decontaminate(
            table(spark, folder, "documents"), table(spark, folder, "benchmark")
        ),
        "op4_url_filter": _over("pages", urls.op4_url_filter),
        "op5_license_scan": _over("documents", licenses.op5_license_scan),
        "op6_quality_rules": _labelled(rules.op6_quality_rules),
        "op7_chat_format": _over("conversations", chat.op7_chat_format),
        "op8_toxicity": _labelled(toxicity.op8_toxicity),
        "op9_mix_sources": _over("documents", mixing.op9_mix_sources),
        "op10_lm_scores": _labelled(lm_scores.op10_lm_scores),
        "op11_hard_negatives": _over("embeddings", negatives.op11_hard_negatives),
        "op12_byte_bpe": _over("documents", bpe.op12_byte_bpe),
        "op13_phrase_mining": _over("documents", phrases.op13_phrase_mining),
    }


def all_sql() -> dict[str, str]:
    given = {"op3_decontaminate": decontaminate.OP3_SQL, "op4_url_filter": urls.OP4_SQL, "op6_quality_rules": rules.OP6_SQL, "op7_chat_format": chat.OP7_SQL, "op9_mix_sources": mixing.OP9_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op13_phrase_mining": phrases.OP13_SQL}
    names = {name: name for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")}
    out = {}
    for query, sql in given.items():
        for name in names:
            sql = sql.replace("{" + name + "}", name)
        out[query] = sql
    return out
