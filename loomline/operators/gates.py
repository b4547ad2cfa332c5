"""Gates and audits: checks over results of operators, assembled as small reports at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollouts import ordered_hash


def overlap_gate(counts: DataFrame) -> DataFrame:
    """counts (pair, ids, texts, near) with `passed`: all three overlap counts are zero."""
    return counts.withColumn("passed", (F.col("ids") == 0) & (F.col("texts") == 0) & (F.col("near") == 0))


def data_gate(processed: DataFrame, valid: Column, overlaps: DataFrame, issues: DataFrame) -> DataFrame:
    """One row (records, invalid, overlaps, manifest_issues, passed) of the gate over processed problems.

    overlaps: overlap counts of all pairs of splits; issues: what `joins.manifest_diff` found. It passes if there are records, all of them
    valid, and none of the nine overlaps and no issue.
    """
    n = processed.agg(F.count(F.lit(1)).alias("records"), F.count_if(~valid).alias("invalid"))
    met = overlaps.agg(F.coalesce(F.sum(F.col("ids") + F.col("texts") + F.col("near")), F.lit(0)).alias("overlaps"))
    bad = issues.agg(F.count(F.lit(1)).alias("manifest_issues"))
    one = n.crossJoin(met).crossJoin(bad)  # one row each
    return one.withColumn("passed", (F.col("records") > 0) & (F.col("invalid") + F.col("overlaps") + F.col("manifest_issues") == 0))


def same_order(a: DataFrame, b: DataFrame, order: str, row: Column) -> DataFrame:
    """One row (rows_a, rows_b, passed): both tables hold the same rows in the same order."""
    x, y = (ordered_hash(t, order, F.sha2(row, 256)) for t in (a, b))
    both = x.toDF("rows_a", "_a").crossJoin(y.toDF("rows_b", "_b"))  # one row each
    return both.select("rows_a", "rows_b", (F.col("_a") == F.col("_b")).alias("passed"))


def frozen_gate(status: DataFrame, expected: int, dataset_hash: str | None = None, found_hash: str | None = None) -> DataFrame:
    """One row (selected, missing, mismatched, expected, passed) of the checks of a frozen manifest; status: see `joins.frozen_status`."""
    counts = status.agg(*(F.count_if(F.col("frozen") == k).alias(n) for k, n in (("selected", "selected"), ("missing", "missing"), ("mismatch", "mismatched"))))
    same = F.lit(dataset_hash is None or dataset_hash == found_hash)
    return counts.withColumn("expected", F.lit(expected).cast("long")).withColumn("passed", (F.col("selected") == expected) & (F.col("missing") + F.col("mismatched") == 0) & same)


def control_gate(run: dict, control: dict, allowed: tuple[str, ...], hashes: dict[str, tuple[str, str]]) -> dict:
    """Differences of two configurations beyond the allowed paths, hashes (expected, found) that differ, and whether the comparison is controlled."""
    differ = config_difference(run, control, allowed)
    stale = sorted(name for name, (expected, found) in hashes.items() if expected != found)
    return {"unexpected_differences": differ, "stale_hashes": stale, "passed": not differ and not stale}


def config_matches(config: dict, expected: dict[str, object]) -> list[str]:
    """Dotted paths of a configuration whose value is not the expected one; a missing path counts."""
    out = []
    for path, value in expected.items():
        at: object = config
        for part in path.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at != value:
            out.append(path)
    return out


def count_gate(df: DataFrame, expected: int, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("gate"), "found", F.lit(expected).cast("long").alias("expected"), (F.col("found") == expected).alias("passed"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b, passed): multiset difference both ways."""
    x, y = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b"))
    return x.crossJoin(y).withColumn("passed", (F.col("only_a") == 0) & (F.col("only_b") == 0))  # one row each


def config_difference(a: dict, b: dict, allowed: tuple[str, ...] = ()) -> list[str]:
    """Dotted paths at which two configurations differ, without the allowed ones."""
    out: list[str] = []

    def walk(x: object, y: object, path: str) -> None:
        if isinstance(x, dict) and isinstance(y, dict):
            for k in sorted(set(x) | set(y)):
                walk(x.get(k), y.get(k), f"{path}.{k}" if path else str(k))
        elif x != y and path not in allowed:
            out.append(path)

    walk(a, b, "")
    return out


def policy_view(problems: DataFrame) -> DataFrame:
    """What reward code may see: held-out test cases never leave."""
    return problems.drop("heldout_tests", "heldout_test_ids", "heldout_fingerprints")


def report_row(**values: Column) -> list[Column]:
    return [v.alias(k) for k, v in values.items()]


def length_policy_status(expected: int, finished: int, capped: int | None) -> str:
    """completed once all reruns are there and few enough are capped, awaiting before, incomplete otherwise."""
    if capped is None:
        return "awaiting"
    return "completed" if finished == expected and capped <= int(0.05 * expected) else "incomplete"
