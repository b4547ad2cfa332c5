"""Qualification: attempts, diagnostics, candidate flags, metric bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate
from ..functions.text import allows_several_answers

# Categories of the wrong-answer diagnostic, all of which are reported.
WA_CATEGORIES = (
    "exact_normalized_mismatch",
    "whitespace_tokenization_mismatch",
    "unsupported_multiple_output_style_problem",
    "suspected_source_testcase_issue",
    "unknown",
)


def tests_in_scope(scope: str) -> Column:
    if scope not in ("all", "reward", "heldout"):
        raise ValueError(f"unknown scope {scope!r}")
    return F.concat("reward_tests", "heldout_tests") if scope == "all" else F.col(f"{scope}_tests")


def candidate_flags(stdio: Column, source_ok: Column, ocr_ok: Column) -> dict[str, Column]:
    base = stdio & source_ok
    return {"sft_candidate": F.coalesce(base & ocr_ok, F.lit(False)), "pt_candidate": F.coalesce(base, F.lit(False)), "dev_candidate": F.coalesce(base, F.lit(False))}


def best_attempt(attempts: Column) -> Column:
    """The first accepted attempt, else the one with the best pass rate, earlier ones first; null without attempts."""
    accepted = F.get(F.filter(attempts, lambda a: a["status"] == "AC"), F.lit(0))
    order = F.array_sort(F.transform(attempts, lambda a, i: F.struct((-F.coalesce(a["pass_rate"], F.lit(0.0))).alias("p"), a["attempt_index"].alias("k"), i.alias("i"))))
    return F.coalesce(accepted, F.get(attempts, F.get(order, F.lit(0))["i"]))


def wrong_answer_category(mismatches: Column, token_equal: Column, prompt: Column | str) -> Column:
    return (
        F.when(mismatches == 0, "unknown").when(token_equal == mismatches, "whitespace_tokenization_mismatch")
        .when(allows_several_answers(prompt), "unsupported_multiple_output_style_problem").otherwise("exact_normalized_mismatch")
    )


def suspected_test_issue(attempts: Column) -> Column:
    """Two or more wrong answers fail first at one test case and the best of them passes 95 %."""
    wrong = F.filter(attempts, lambda a: a["status"] == "WA")
    firsts = F.filter(F.transform(wrong, lambda a: a["first_failure"]), lambda x: x.isNotNull())
    shared = F.exists(F.array_distinct(firsts), lambda x: F.size(F.filter(firsts, lambda y: y == x)) >= 2)
    return F.coalesce((F.size(wrong) >= 2) & shared & (F.array_max(F.transform(wrong, lambda a: F.coalesce(a["pass_rate"], F.lit(0.0)))) >= 0.95), F.lit(False))


def record_failure(split: Column, stdio: Column, source_ok: Column, ocr_ok: Column, source_class: Column, ocr_class: Column) -> Column:
    return (
        F.when(~stdio, "skipped_call_based")
        .when(~F.coalesce(source_ok, F.lit(False)), F.concat(F.lit("source_reference_not_verified:"), F.coalesce(source_class, F.lit("no_source_solution"))))
        .when((split == "sft") & ~F.coalesce(ocr_ok, F.lit(False)), F.concat(F.lit("ocr_solution_not_ac:"), F.coalesce(ocr_class, F.lit("unknown"))))
        .otherwise("eligible")
    )


def metric_bundle(df: DataFrame, first: Column, best: Column, ocr: Column, *by: str) -> DataFrame:
    """(by..., metric, status, n, total) of first attempt, best of three and OCR solution; a missing attempt is NO_SOURCE, a missing OCR solution does not count."""
    named = F.array(
        F.struct(F.lit("ref_at_1").alias("metric"), F.coalesce(first, F.lit("NO_SOURCE")).alias("status")),
        F.struct(F.lit("ref_at_any3").alias("metric"), F.coalesce(best, F.lit("NO_SOURCE")).alias("status")), F.struct(F.lit("ocr").alias("metric"), ocr.alias("status")),
    )
    rows = df.select(*by, F.explode(named).alias("m")).where("m.status IS NOT NULL")
    counted = rows.groupBy(*by, "m.metric", "m.status").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy(*by, "m.metric").agg(F.count(F.lit(1)).alias("total"))
    return counted.join(total, [*by, "metric"]).withColumn("rate", rate(F.col("n"), F.col("total")))


def zero_filled(df: DataFrame, column: str, categories: tuple[str, ...]) -> DataFrame:
    """(category, n) of every category, 0 where it does not occur."""
    every = df.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def slow_recoveries(df: DataFrame, attempts: str = "attempts") -> DataFrame:
    """One row: attempts that time out, those accepted with more time, and the same of first attempts."""
    a = df.select(F.explode(attempts).alias("a"))
    tle, first = F.col("a.status") == "TLE", F.col("a.attempt_index") == 1
    ok = tle & (F.col("a.slow_status") == "AC")
    return a.agg(F.count_if(tle).alias("tle"), F.count_if(ok).alias("recovered"), F.count_if(tle & first).alias("first_tle"), F.count_if(ok & first).alias("first_recovered"))
