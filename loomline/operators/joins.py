"""Exact-key joins of problems and reasoning, and first-accepted selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_tests import as_text, solutions, tests
from ..functions.keys import make_problem_id, make_source_id
from ..functions.text import is_text, strip
from .validate import assert_none, first_reason, passes, valid_raw_problem, valid_reasoning


def reasoning_keys(reasoning: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Reasoning aggregated by each of its two keys: (key, n, reasoning).

    Only counts and one text per key leave the partial aggregate, so a key with many rows stays small. An
    invalid row fails the query where strict is set, as it would abort a curation run, and is left out otherwise.
    """
    rows = assert_none(reasoning, ~valid_reasoning(), "invalid reasoning record") if strict else reasoning.where(valid_reasoning())
    text = F.min_by("reasoning", "reasoning_id").alias("reasoning")
    by_id = rows.where(is_text("problem_id")).groupBy(strip("problem_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), text)
    by_source = rows.where(is_text("source") & is_text("source_id")).groupBy(make_problem_id(strip("source"), strip("source_id")).alias("key"))
    return by_id, by_source.agg(F.count(F.lit(1)).alias("n"), text)


def exact_join(problems: DataFrame, reasoning: DataFrame, strict: bool = True) -> DataFrame:
    """Problems with `reasoning`, `mapping_key` and `reject_reason`; accepted rows have a null reason.

    Reasons in order: invalid_problem, ambiguous (either key has several rows), no_reasoning. Problems are not de-duplicated.
    """
    by_id, by_source = reasoning_keys(reasoning, strict)
    a = by_id.select(F.col("key").alias("_k"), F.col("n").alias("_n1"), F.col("reasoning").alias("_r1"))
    b = by_source.select(F.col("key").alias("_k"), F.col("n").alias("_n2"), F.col("reasoning").alias("_r2"))
    key = make_problem_id(strip("source"), strip("source_id"))
    rows = problems.select("*", valid_raw_problem().alias("_valid"), key.alias("_source_key"), F.coalesce(F.nullif("problem_id", F.lit("")), key).alias("_id"))
    # Where a problem's two keys are one, as they usually are, its wide row is shuffled once, against both counts of that key.
    one = F.col("_id").eqNullSafe(F.col("_source_key"))
    same = rows.where(one).join(a.join(b, "_k", "full_outer").withColumnRenamed("_k", "_id"), "_id", "left")
    other = rows.where(~one).join(a.withColumnRenamed("_k", "_id"), "_id", "left").join(b.withColumnRenamed("_k", "_source_key"), "_source_key", "left")
    joined = same.unionByName(other)
    n1, n2 = F.coalesce("_n1", F.lit(0)), F.coalesce("_n2", F.lit(0))
    reason = first_reason(("invalid_problem", ~F.col("_valid")), ("ambiguous", (n1 > 1) | (n2 > 1)), ("no_reasoning", (n1 == 0) & (n2 == 0)))
    mapping = F.when(n1 == 1, "problem_id").when(n2 == 1, "source/source_id")
    out = joined.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    out = out.withColumns({"mapping_key": F.when(ok, mapping), "reasoning": F.when(ok, F.coalesce("_r1", "_r2")), "problem_id": F.col("_id")})
    return out.drop("_valid", "_source_key", "_id", "_n1", "_n2", "_r1", "_r2")


def join_report(joined: DataFrame) -> DataFrame:
    """Counts by reject reason and mapping key."""
    outcome = F.coalesce("reject_reason", F.lit("joined")).alias("outcome")
    return joined.groupBy(outcome, F.coalesce("mapping_key", F.lit("none")).alias("mapping_key")).agg(F.count(F.lit(1)).alias("problems"))


def first_accepted(rows: DataFrame, key: list[str], pos: str, accepted: Column, reason: Column, before: Column | None = None) -> DataFrame:
    """rows with `reject_reason` as a stream in order of pos would have given it.

    Reasons of `before` come first. Then a row of a key that was accepted earlier is 'duplicate_problem', before its own `reason` is
    looked at. A row whose earlier ones were all rejected is judged by its own reason.
    """
    ok = accepted & (before.isNull() if before is not None else F.lit(True))
    first = rows.where(ok).groupBy(*key).agg(F.min(pos).alias("_first"))
    joined = rows.join(first, key, "left")
    late = F.coalesce(F.col(pos) > F.col("_first"), F.lit(False))
    chain = F.when(late, F.lit("duplicate_problem")).otherwise(reason)
    if before is not None:
        chain = F.coalesce(before, chain)
    return joined.withColumn("reject_reason", chain).drop("_first")


def candidate_cascade(rows: DataFrame, pos: str, datasets: list[str], judgement: str, least: float) -> DataFrame:
    """Stream candidates with `problem_id` and `reject_reason`, null for accepted ones; the first accepted row of a problem wins.

    rows: (dataset, index, split, judgement, pass_rate, reasoning, pos). The reasons in order: dataset_not_selected, bad_index,
    missing_source_split, duplicate_problem, bad_judgement, low_pass_rate, missing_reasoning.
    """
    dataset, index = F.lower(strip(as_text("dataset"))), F.col("index").cast("string").try_cast("long")
    split = F.lower(strip(as_text("split")))
    known = rows.withColumn("problem_id", F.concat_ws(":", dataset, split, index.cast("string")))
    early = first_reason(("dataset_not_selected", ~dataset.isin(datasets)), ("bad_index", index.isNull()), ("missing_source_split", split == ""))
    own = first_reason(
        ("bad_judgement", F.lower(as_text("judgement")) != judgement), ("low_pass_rate", ~passes(F.col("pass_rate"), least)), ("missing_reasoning", ~is_text("reasoning")),
    )
    return first_accepted(known, ["problem_id"], pos, own.isNull(), own, early)


def source_rows(rows: DataFrame) -> DataFrame:
    """Records of source rows (dataset, split, index, question, difficulty, url, input_output, solutions), the last two being JSON texts.

    Rows without a test case, a solution or a question give none. The reference code is the first solution.
    """
    made = rows.select(
        F.col("dataset").alias("source"), make_source_id(F.col("split"), F.col("index")).alias("source_id"), F.coalesce(F.nullif(strip(as_text("difficulty")), F.lit("")), F.lit("unknown")).alias("difficulty"),
        strip(as_text("question")).alias("prompt"), strip(F.get(solutions("solutions"), F.lit(0))).alias("reference_code"), tests("input_output").alias("tests"),
        F.struct(strip(as_text("url")).alias("url"), F.col("split").alias("source_split"), F.col("index").cast("long").alias("source_index")).alias("metadata"),
    )
    return made.where((F.size("tests") > 0) & F.col("reference_code").isNotNull() & (F.col("prompt") != ""))


def assemble(candidates: DataFrame, sources: DataFrame, pos: str = "pos") -> DataFrame:
    """Candidates with `reject_reason` from an exact join on (dataset, source_split, index) with source records.

    sources: (dataset, source_split, index, src_source_split, src_source_id, prompt, reference_code, tests). The candidate's own
    solution replaces the source's code where it is not blank.
    """
    joined = candidates.join(sources, ["dataset", "source_split", "index"], "left")
    code = F.coalesce(F.when(is_text("solution"), strip("solution")), F.col("reference_code"))
    joined = joined.withColumn("reference_code", code).withColumn("source", F.col("dataset"))
    wrong = ~(F.col("src_source_split").eqNullSafe(F.col("source_split")) & F.col("src_source_id").eqNullSafe(F.col("source_id")))
    reason = first_reason(
        ("missing_source_problem", F.col("src_source_id").isNull() & F.col("src_source_split").isNull()), ("source_split_mismatch", wrong),
        ("invalid_output", ~is_text("reasoning") | ~valid_raw_problem()),
    )
    return first_accepted(joined, ["problem_id"], pos, reason.isNull(), reason)


def semi_by_keys(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of table whose key is wanted; the planner broadcasts the keys only if they are small."""
    return table.join(wanted.select(*keys).distinct(), keys, "left_semi")


def eligible_view(processed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Processed problems that the frozen manifest marks as candidates of their own split; misaligned rows fail the query."""
    m = manifest.select("problem_id", F.col("split").alias("m_split"), F.col("source").alias("m_source"), "sft_candidate", "pt_candidate", "dev_candidate")
    joined = processed.join(m, "problem_id")
    apart = ~(F.col("split").eqNullSafe(F.col("m_split")) & F.col("source").eqNullSafe(F.col("m_source")))
    joined = assert_none(joined, apart, "manifest and processed problems disagree")
    flag = F.when(F.col("split") == "sft", F.col("sft_candidate")).when(F.col("split") == "pt", F.col("pt_candidate")).when(F.col("split") == "dev", F.col("dev_candidate"))
    return joined.where(F.coalesce(flag, F.lit(False))).drop("m_split", "m_source", "sft_candidate", "pt_candidate", "dev_candidate")


def frozen_status(rows: DataFrame, manifest: DataFrame, response_hash: Column) -> DataFrame:
    """rows with `frozen`: 'missing' (no manifest row), 'mismatch' (another response hash), 'selected' or 'not_member'.

    manifest: (problem_id, source_response_hash, member).
    """
    m = manifest.select("problem_id", F.col("source_response_hash").alias("_h"), F.coalesce("member", F.lit(False)).alias("_m"), F.lit(True).alias("_there"))
    joined = rows.join(m, "problem_id", "left")
    status = F.when(F.col("_there").isNull(), "missing").when(~response_hash.eqNullSafe(F.col("_h")), "mismatch").when(F.col("_m"), "selected").otherwise("not_member")
    return joined.withColumn("frozen", status).drop("_h", "_m", "_there")


def frozen_selection(rows: DataFrame, manifest: DataFrame, response_hash: Column) -> DataFrame:
    """The members of a frozen manifest; a row that it lacks, or whose response has changed, fails the query."""
    told = assert_none(frozen_status(rows, manifest, response_hash), F.col("frozen").isin("missing", "mismatch"), "rows and frozen manifest disagree")
    return told.where("frozen = 'selected'").drop("frozen")


def manifest_diff(expected: DataFrame, actual: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(problem_id, issue): missing, extra, duplicate, or the name of a field that differs; of duplicates the last by `order` counts."""
    def last(df: DataFrame) -> DataFrame:
        return df.groupBy("problem_id").agg(F.max_by(F.struct(*fields), order).alias("r"), F.count(F.lit(1)).alias("n"))

    e, a = last(expected).select("problem_id", F.col("r").alias("e")), last(actual).select("problem_id", F.col("r").alias("a"), "n")
    joined = e.join(a, "problem_id", "full_outer")
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    issues = F.array_compact(
        F.array(
            F.when(F.col("a").isNull(), "missing"), F.when(F.col("e").isNull(), "extra"), F.when(F.col("n") > 1, "duplicate"),
            *(F.when(both & ~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), f) for f in fields),
        )
    )
    return joined.select("problem_id", F.explode(issues).alias("issue"))
