"""Rollout summaries, comparisons and policy signals."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order import ranked
from ..functions.stats import rate
from .validate import assert_none


def one_delivery(rollouts: DataFrame) -> DataFrame:
    """Each rollout_id once: the delivery that arrived first.

    Each column is an aggregate of its own, so the optimiser drops those that a query does not use: they are neither read nor shuffled.
    """
    kept = [c for c in rollouts.columns if c != "rollout_id"]
    return rollouts.groupBy("rollout_id").agg(*(F.min_by(c, "arrived_at").alias(c) for c in kept))


def combined_status(reward: Column, heldout: Column) -> Column:
    """CE, then TLE, then RE of either; AC if both are; else WA."""
    both = F.array(reward, heldout)
    out = F.when(F.array_contains(both, "CE"), "CE").when(F.array_contains(both, "TLE"), "TLE").when(F.array_contains(both, "RE"), "RE")
    return out.when((reward == "AC") & (heldout == "AC"), "AC").otherwise("WA")


def verdict_summary(rollouts: DataFrame, *by: str) -> DataFrame:
    """Total, accepted and acceptance rate, overall and by each of the columns, in one pass over grouping sets."""
    sets = [[c] for c in by] + [[]]
    grouped = rollouts.groupingSets(sets, *by)
    keys = [F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit("None"))).alias(c) for c in by]
    accepted = F.count_if(F.col("verifier_status") == "AC")
    return grouped.agg(*[k.alias(f"_{c}") for k, c in zip(keys, by)], F.count(F.lit(1)).alias("total"), accepted.alias("accepted"), rate(accepted, F.count(F.lit(1))).alias("acceptance_rate")).select(
        *[F.col(f"_{c}").alias(c) for c in by], "total", "accepted", "acceptance_rate"
    )


def rollout_metrics(rollouts: DataFrame, *by: str) -> DataFrame:
    """The metric bundle of evaluated rollouts in one aggregate; rates are 0.0 where there is nothing."""
    n, status = F.count(F.lit(1)), F.col("verifier_status")

    def mean(c: Column) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    reward, held = F.coalesce(F.try_divide("reward_passed", "reward_total"), F.lit(0.0)), F.coalesce(F.try_divide("heldout_passed", "heldout_total"), F.lit(0.0))
    return rollouts.groupBy(*by).agg(
        n.alias("total"), rate(F.count_if(status == "AC"), n).alias("pass_at_1"), rate(F.count_if(status.isin("AC", "WA")), n).alias("executable_rate"),
        mean(F.col("testcase_pass_rate")).alias("mean_testcase_pass_rate"), mean(reward).alias("reward_mean"), mean(held).alias("heldout_mean"),
        (mean(reward) - mean(held)).alias("generalization_gap"), F.count_if("hit_max_new_tokens").alias("cap_hits"), rate(F.count_if("hit_max_new_tokens"), n).alias("cap_hit_rate"),
        mean(F.col("response_token_count").cast("double")).alias("mean_response_tokens"),
    )


def format_metrics(rollouts: DataFrame, flags: str, *by: str) -> DataFrame:
    """rollout_metrics with counts and rates of the format flags, a struct column; the gap of reward and held-out means is in generalization_gap."""
    names = ("starts_with_think", "closed_think", "unclosed_think", "fenced_code", "valid_reasoning_to_code_transition", "format_valid")
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col(f"{flags}.{f}")).alias(f"{f}_count") for f in names]
    told = rollouts.groupBy(*by).agg(n.alias("_n"), *counts)
    return rollout_metrics(rollouts, *by).join(told, list(by)).select("*", *(rate(F.col(f"{f}_count"), F.col("_n")).alias(f"{f}_rate") for f in names)).drop("_n")


def capped(rollouts: DataFrame, cap: int, exactly: bool = False) -> DataFrame:
    """Rollouts whose response reached the cap; exactly: those that stopped at it."""
    tokens = F.col("response_token_count")
    return rollouts.where(tokens == cap if exactly else tokens >= cap)


def final_policy(rollouts: DataFrame, cap: int, expected: int | None = None) -> DataFrame:
    """rollouts marked with the final cap and the cap hit recomputed; another number of rows than expected fails the query."""
    rows = rollouts.withColumns({"max_new_tokens": F.lit(cap), "hit_max_new_tokens": F.col("response_token_count") >= cap})
    if expected is None:
        return rows
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    return assert_none(rows.crossJoin(F.broadcast(n)), F.col("_n") != expected, "another number of rollouts than expected").drop("_n")  # one row


def compact(rollouts: DataFrame) -> DataFrame:
    """What a report keeps of a rollout: ids, verdict, counts; and of a failed one its key (status and first failure)."""
    key = F.when(F.col("verifier_status") != "AC", F.concat_ws("|", "verifier_status", F.coalesce(F.col("testcase_passed").cast("string"), F.lit("none"))))
    return rollouts.select("rollout_id", "problem_id", "model_revision", "verifier_status", "testcase_passed", "testcase_total", key.alias("failure_key"))


def override(pilot: DataFrame, rerun: DataFrame, cap: int, fields: list[str], key: str = "problem_id") -> DataFrame:
    """Pilot rows; those at the cap are replaced by their rerun. A capped row without a rerun fails the query."""
    new = rerun.select(key, F.struct(*fields).alias("_new"))
    joined = pilot.join(new, key, "left")
    capped = F.col("response_token_count") >= cap
    joined = assert_none(joined, capped & F.col("_new").isNull(), "a capped rollout has no rerun")
    return joined.select(*(c for c in pilot.columns if c not in fields), *(F.when(capped, F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f) for f in fields), capped.alias("rerun"))


def transitions(old: DataFrame, new: DataFrame, key: str = "problem_id") -> DataFrame:
    """(old_status, new_status, n) of rows matched by key."""
    a, b = old.select(key, F.col("verifier_status").alias("old_status")), new.select(key, F.col("verifier_status").alias("new_status"))
    return a.join(b, key).groupBy("old_status", "new_status").agg(F.count(F.lit(1)).alias("n"))


def cost_ratio(old: DataFrame, new: DataFrame, key: str = "problem_id") -> DataFrame:
    """Sums, averages and new / old ratios of latency and tokens of matched rows."""
    a = old.select(key, F.col("generation_latency_ms").cast("long").alias("ol"), F.col("response_token_count").alias("ot"), F.col("verifier_status").alias("os"))
    b = new.select(key, F.col("generation_latency_ms").cast("long").alias("nl"), F.col("response_token_count").alias("nt"), F.col("verifier_status").alias("ns"))
    j = a.join(b, key)
    return j.agg(
        F.count(F.lit(1)).alias("n"), F.sum("ol").alias("old_latency"), F.sum("nl").alias("new_latency"), F.try_divide(F.sum("nl"), F.sum("ol")).alias("latency_ratio"),
        F.sum("ot").alias("old_tokens"), F.sum("nt").alias("new_tokens"), F.try_divide(F.sum("nt"), F.sum("ot")).alias("token_ratio"),
        F.count_if((F.col("ns") == "AC") & (F.col("os") != "AC")).alias("added_accepted"),
    )


def length_policy(still_capped: Column, expected: Column) -> Column:
    return F.when(still_capped <= F.floor(expected * 0.05), "choose_4096").otherwise("stop_no_auto_increase")


def metric_deltas(a: DataFrame, b: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """(by, metric, a, b, delta) of the metrics that both reports have."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot([by], metrics, "metric", name)

    return long(a.select(by, *(F.col(m).cast("double").alias(m) for m in metrics)), "a").join(long(b.select(by, *(F.col(m).cast("double").alias(m) for m in metrics)), "b"), [by, "metric"]).withColumn("delta", F.col("b") - F.col("a"))


def reward(binary: bool = False) -> Column:
    """Dense reward by reward test cases only; 0 for what does not run. Binary: all of them pass."""
    dense = F.when(F.col("verifier_status").isin("CE", "RE", "TLE"), 0.0).otherwise(F.coalesce(F.try_divide("reward_passed", "reward_total"), F.lit(0.0)))
    return F.when(dense == 1.0, 1.0).otherwise(0.0) if binary else dense


def group_advantage(rollouts: DataFrame, group: list[str], epsilon: float = 1e-6) -> DataFrame:
    """rollouts with `reward` and `advantage` = (reward - mean) / (population standard deviation + epsilon) in its group.

    Group moments are aggregated and joined back, so a group of any size is never sorted or held by one task.
    """
    rows = rollouts.withColumn("reward", reward())
    moments = rows.groupBy(*group).agg(F.avg("reward").alias("_m"), F.stddev_pop("reward").alias("_s"))
    return rows.join(moments, group).withColumn("advantage", (F.col("reward") - F.col("_m")) / (F.col("_s") + epsilon)).drop("_m", "_s")


def zero_variance(rollouts: DataFrame, group: list[str]) -> DataFrame:
    """One row: groups, groups of equal rewards, those all solved and those all unsolved."""
    g = rollouts.withColumn("r", reward()).groupBy(*group).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(flat).alias("zero"), F.count_if(flat & (F.col("lo") == 1.0)).alias("all_solved"), F.count_if(flat & (F.col("hi") == 0.0)).alias("all_failed"))


def false_positive_gap(rollouts: DataFrame, *by: str) -> DataFrame:
    """Share of rollouts with full reward that fail a held-out test case, and the gap of mean pass rates."""
    full = F.col("reward_passed") == F.col("reward_total")
    miss = F.col("heldout_passed") < F.col("heldout_total")
    gap = F.avg(F.try_divide("reward_passed", "reward_total")) - F.avg(F.try_divide("heldout_passed", "heldout_total"))
    return rollouts.groupBy(*by).agg(F.count_if(full).alias("full_reward"), F.count_if(full & miss).alias("false_positives"), rate(F.count_if(full & miss), F.count_if(full)).alias("fpr"), gap.alias("gap"))


def first_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows per group, with their rank; the planner keeps k rows per group and task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ordered_hash(df: DataFrame, order: str, hashed: Column) -> DataFrame:
    """(rows, dataset_hash): a hash over row hashes in order.

    A tree: row hashes are combined per block of 4096 ranks, the blocks' hashes per block of 4096 blocks, and so on to one, so no task ever
    holds more than 4096 hashes. Equal data in equal order gives equal hashes, whatever the partitioning. An empty table has the hash of ''.
    """
    rows = ranked(df.select(F.col(order).alias("_o"), hashed.alias("_h")), "_o", "_h")
    level, count = rows.select(F.col("rank").alias("b"), F.lit(1).cast("long").alias("n"), F.col("_h").alias("h")), rows.count()
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ","), 256)
    while True:
        level = level.groupBy((F.col("b") / 4096).cast("long").alias("b")).agg(F.sum("n").alias("n"), joined.alias("h"))
        count = -(-count // 4096)
        if count <= 1:
            break
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("dataset_hash"))


def list_hash(df: DataFrame, order: str, text: Column) -> DataFrame:
    """(rows, list_hash): SHA-256 of the JSON array of the texts in order, as manifests of other tools record it.

    Such a hash is serial by definition. Rows are sorted by ranges and then stream through one task, which holds one batch of them;
    `ordered_hash` is the one to use where both sides are made here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(b"["), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                digest.update((b"," if n else b"") + json.dumps(x, ensure_ascii=False).encode("utf-8", "surrogatepass"))
                n += 1
        digest.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["rows", "list_hash"])

    rows = df.select(F.col(order).alias("_o"), text.alias("_t")).repartitionByRange("_o").sortWithinPartitions("_o", "_t").select("_t")
    told = rows.coalesce(1).mapInArrow(run, "rows long, list_hash string")
    return told.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("list_hash"), F.sha2(F.lit("[]"), 256)).alias("list_hash"))  # no task runs for an empty table


def bootstrap_mean(df: DataFrame, key: str, value: Column, draws: int, seed: int, low: float = 2.5, high: float = 97.5) -> DataFrame:
    """(mean, low, high): Poisson bootstrap over keys with weights from a hash of (seed, draw, key), so it is repeatable.

    Each row is expanded to `draws` weights and summed before the shuffle: what moves is one pair of numbers per draw and task.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col(key)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(9):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum(((u > s).cast("int") for s in steps[1:]), (u > steps[0]).cast("int"))
    rows = df.select(key, value.alias("_v")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    w = F.when(F.col("draw") == 0, F.lit(1)).otherwise(weight)
    per = rows.withColumn("_w", w).groupBy("draw").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("m"))
    return per.agg(F.max(F.when(F.col("draw") == 0, F.col("m"))).alias("mean"), F.percentile(F.when(F.col("draw") > 0, F.col("m")), low / 100).alias("low"), F.percentile(F.when(F.col("draw") > 0, F.col("m")), high / 100).alias("high"))
