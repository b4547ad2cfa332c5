"""Validity predicates, ordered reject reasons, and assertions inside a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import testcase_fingerprint
from ..functions.text import is_text


def valid_testcase(test: Column, need_id: bool) -> Column:
    ok = is_text(test["input"]) & is_text(test["output"])
    return ok & is_text(test["test_id"]) if need_id else ok


def valid_tests(tests: Column, need_id: bool = False) -> Column:
    """At least one test case, and no invalid one."""
    return F.coalesce((F.size(tests) > 0) & F.forall(tests, lambda t: valid_testcase(t, need_id)), F.lit(False))


def valid_raw_problem() -> Column:
    return is_text("source") & is_text("source_id") & is_text("prompt") & is_text("reference_code") & valid_tests(F.col("tests"))


def valid_reasoning() -> Column:
    return (is_text("problem_id") | (is_text("source") & is_text("source_id"))) & is_text("reasoning")


def valid_processed() -> Column:
    """A processed problem whose reward and held-out test cases are disjoint by id and by content."""
    fields = [is_text(c) for c in ("problem_id", "source", "source_id", "difficulty", "prompt", "reasoning", "reference_code", "split")]
    ok = fields[0]
    for f in fields[1:]:
        ok = ok & f
    reward, held = F.col("reward_tests"), F.col("heldout_tests")

    def prints(tests: Column) -> Column:
        return F.transform(tests, lambda t: testcase_fingerprint(t["input"], t["output"]))

    apart = ~F.arrays_overlap(reward["test_id"], held["test_id"]) & ~F.arrays_overlap(prints(reward), prints(held))
    return ok & F.col("split").isin("sft", "pt", "dev") & valid_tests(reward, True) & valid_tests(held, True) & F.coalesce(apart, F.lit(False))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def assert_none(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """df, whose evaluation fails with the message at the first row where `broken` holds."""
    check = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.where(check)


def interactive(*columns: str) -> Column:
    """Does one of the columns hold the word, as a whole and in any case?"""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).rlike("\\binteractive\\b"), F.lit(False))
    return out


def passes(rate: Column, least: float) -> Column:
    """A pass rate that is null or below the least fails; NaN does not compare as below."""
    value = rate.try_cast("double")
    return F.coalesce(F.isnan(value) | (value >= least), F.lit(False))
