"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .canonical_text import canonical_documents, look_alike_classes, look_alike_pairs
from .cross_split import cross_split_overlap, cross_split_pairs, cross_split_report
from .defects import defects
from .layout_copies import collapse, layout_copies
from .leaks import leaked, paraphrases
from .mixing import mix, mixing_report
from .near_duplicates import near_duplicate_classes, near_duplicate_pairs
from .oracles import ORACLES
from .tokens import token_cube, token_update
from .truncation import truncated, truncation_report


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split_pairs(table(spark, folder, "problems"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    problems = table(spark, folder, "problems")
    return cross_split_report(problems, cross_split_pairs(problems))


def p1_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split_overlap(table(spark, folder, "problems"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "reasoning"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_report(table(spark, folder, "reasoning"))


def p3_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_cube(table(spark, folder, "problems"), table(spark, folder, "reasoning"))


def p3_update(spark: SparkSession, folder: str) -> DataFrame:
    return token_update(table(spark, folder, "problems"), table(spark, folder, "reasoning"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, folder, "problems"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_classes(table(spark, folder, "problems"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects(table(spark, folder, "problems"), table(spark, folder, "reasoning"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout_copies(table(spark, folder, "problems"))


def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return collapse(table(spark, folder, "problems"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    return paraphrases(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_pairs(table(spark, folder, "documents"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_classes(table(spark, folder, "documents"))


def p9_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_documents(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_report, p1_overlap, p2_found, p2_report, p3_tokens, p3_update, p4_found, p4_classes, p5_found, p6_found, p6_collapsed,
        p7_found, p7_paraphrases, p8_mix, p8_report, p9_found, p9_classes, p9_canonical,
    )
    return {query.__name__: query for query in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
