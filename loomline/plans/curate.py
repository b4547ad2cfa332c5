"""The curation pipeline: raw problems and reasoning in, split and blocked problems, manifest and reports out.

    python -m loomline.plans.curate PROBLEMS.jsonl REASONING.jsonl CONFIG OUT

CONFIG is a mapping with `seed`, `ratios`, optionally `targets`, `reward_ratio`, `min_total_tests_by_split` or `min_total_tests`, `ngram`
and `threshold`. OUT must not exist.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.storage import checkpointed
from ..operators import joins, overlap, splits
from ..sources import files, jsonl

TESTS = "array<struct<test_id:string,input:string,output:string>>"
PROBLEM = f"problem_id string, source string, source_id string, difficulty string, prompt string, reference_code string, tests {TESTS}"
REASONING = "problem_id string, source string, source_id string, reasoning string"
PAIRS = (("sft", "pt"), ("sft", "dev"), ("pt", "dev"))


@dataclass(frozen=True)
class Curated:
    """processed: kept problems of all splits; manifest; dropped (problem_id, reason); overlaps before and after blocking; counts."""

    processed: DataFrame
    manifest: DataFrame
    dropped: DataFrame
    before: DataFrame
    after: DataFrame
    counts: DataFrame


def _overlaps(sets: dict[str, DataFrame], threshold: float) -> DataFrame:
    out = None
    for a, b in PAIRS:
        row = overlap.overlap_counts(sets[a], sets[b], threshold, f"{a}_{b}")
        out = row if out is None else out.unionByName(row)
    return out


def curate(problems: DataFrame, reasoning: DataFrame, config: dict) -> Curated:
    """problems and reasoning need a position column each: pos and reasoning_id."""
    joined = checkpointed(joins.exact_join(problems, reasoning))
    seed, ratios = int(config["seed"]), config["ratios"]
    split = splits.assign_splits(joined.where("reject_reason IS NULL"), seed, ratios, config.get("targets"))
    tested = checkpointed(splits.reward_heldout(split, seed, float(config.get("reward_ratio", 0.7)), splits.least_tests_column(config)))
    enough = tested.where("reward_tests IS NOT NULL")
    n, threshold = int(config.get("ngram", 5)), float(config.get("threshold", 0.8))
    sets = {s: overlap.shingled(enough.where(F.col("split") == s), n) for s in splits.SPLITS}
    before = _overlaps(sets, threshold)
    blocked = checkpointed(overlap.sequential_blocking(sets["sft"], sets["pt"], sets["dev"], threshold))
    kept = checkpointed(enough.join(blocked, ["split", "problem_id"], "left_anti"))
    clear = {s: v.join(blocked.where(F.col("split") == s), "problem_id", "left_anti") for s, v in sets.items()}
    after = _overlaps(clear, threshold)
    dropped = (
        joined.where("reject_reason IS NOT NULL").select("problem_id", F.col("reject_reason").alias("reason"))
        .unionByName(tested.where("reward_tests IS NULL").select("problem_id", F.lit("too_few_tests").alias("reason")))
        .unionByName(blocked.select("problem_id", F.concat(F.lit("blocked_"), "split").alias("reason")))
    )
    counts = kept.groupBy("split").agg(F.count(F.lit(1)).alias("problems"))
    return Curated(kept, splits.test_manifest(kept), dropped, before, after, counts)


def _tests_json(tests: str) -> Column:
    each = F.transform(tests, lambda t: keys.stable_json(input=keys.json_string(t["input"]), output=keys.json_string(t["output"]), test_id=keys.json_string(t["test_id"])))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def problem_json() -> Column:
    fields = {c: keys.json_string(c) for c in ("problem_id", "source", "source_id", "difficulty", "prompt", "reasoning", "reference_code", "split")}
    return keys.stable_json(**fields, reward_tests=_tests_json("reward_tests"), heldout_tests=_tests_json("heldout_tests"))


def manifest_json() -> Column:
    lists = {c: keys.json_array(c) for c in ("reward_test_ids", "heldout_test_ids", "reward_fingerprints", "heldout_fingerprints")}
    return keys.stable_json(problem_id=keys.json_string("problem_id"), split=keys.json_string("split"), **lists)


def write(result: Curated, out: str) -> dict:
    """Write splits, manifest and report; the report is returned. Raises if a gate fails; nothing is overwritten."""
    for s in splits.SPLITS:
        jsonl.write_jsonl(result.processed.where(F.col("split") == s), f"{out}/{s}", problem_json(), order="problem_id")
    jsonl.write_jsonl(result.manifest, f"{out}/test_split_manifest", manifest_json(), order="problem_id")
    report = {
        "counts": {r.split: r.problems for r in result.counts.collect()},
        "dropped": {r.reason: r["count"] for r in result.dropped.groupBy("reason").count().collect()},
        "overlap_before": {r.pair: {"ids": r.ids, "texts": r.texts, "near": r.near} for r in result.before.collect()},
        "overlap_after": {r.pair: {"ids": r.ids, "texts": r.texts, "near": r.near} for r in result.after.collect()},
        "gate_passed": result.after.select(F.min((F.col("ids") == 0) & (F.col("texts") == 0) & (F.col("near") == 0)).alias("ok")).first().ok,
    }
    jsonl.write_json(report, f"{out}/report.json")
    if not report["gate_passed"]:
        raise ValueError("the splits still overlap")
    return report


def main(args: list[str]) -> None:
    problems, reasoning, config, out = args
    spark = SparkSession.builder.appName("curate").getOrCreate()
    p = jsonl.read_jsonl(spark, problems, PROBLEM).withColumn("pos", F.monotonically_increasing_id())
    r = jsonl.read_jsonl(spark, reasoning, REASONING).withColumn("reasoning_id", F.monotonically_increasing_id())
    write(curate(checkpointed(p), checkpointed(r), files.load_config(config)), out)


__all__ = ["Curated", "curate", "main", "manifest_json", "problem_json", "write"]

if __name__ == "__main__":
    main(sys.argv[1:])
