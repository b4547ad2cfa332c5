"""Preference pairs, matched triples and difficulty strata from rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rollouts import reward


def graded(rollouts: DataFrame) -> DataFrame:
    """(problem_id, rollout_id, reward, grade, tokens): chosen R = 1, hard 0.5 <= R < 1, easy R <= 0.2; only programs that run."""
    rows = rollouts.where(F.col("verifier_status").isin("AC", "WA")).withColumn("reward", reward())
    grade = F.when(F.col("reward") == 1.0, "chosen").when(F.col("reward") >= 0.5, "hard").when(F.col("reward") <= 0.2, "easy")
    return rows.select("problem_id", "rollout_id", "reward", grade.alias("grade"), F.col("response_token_count").alias("tokens"))


def preference_pairs(rollouts: DataFrame) -> DataFrame:
    """(problem_id, chosen_id, rejected_id, kind, margin): of each chosen rollout the rejected one of either kind that is nearest in length.

    Per problem and length one rejected rollout of each kind is enough, the one with the smallest id. Windows run over the different
    lengths of a problem, whose number the token budget bounds, not over its rollouts; the chosen ones are joined by length.
    """
    rows = graded(rollouts).where("grade IS NOT NULL")
    kinds = ("hard", "easy")
    firsts = [F.min(F.when(F.col("grade") == k, F.struct("rollout_id", "reward"))).alias(k) for k in kinds]
    lengths = rows.groupBy("problem_id", "tokens").agg(*firsts)
    w = W.partitionBy("problem_id").orderBy("tokens")
    near = []
    for k in kinds:
        item = F.when(F.col(k).isNotNull(), F.struct("tokens", F.col(k).alias("r")))
        near.append(F.last(item, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(f"{k}_lo"))
        near.append(F.first(item, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)).alias(f"{k}_hi"))
    table = lengths.select("problem_id", "tokens", *near)
    chosen = rows.where("grade = 'chosen'").select("problem_id", "tokens", F.col("rollout_id").alias("chosen_id"), "reward").join(table, ["problem_id", "tokens"])

    def pick(k: str) -> Column:
        lo, hi = F.col(f"{k}_lo"), F.col(f"{k}_hi")
        nearer = F.when(hi.isNull() | (F.col("tokens") - lo["tokens"] <= hi["tokens"] - F.col("tokens")), lo).otherwise(hi)
        return F.struct(F.lit(k).alias("kind"), F.coalesce(nearer, hi)["r"].alias("r"))

    out = chosen.select("problem_id", "chosen_id", "reward", F.explode(F.array(*map(pick, kinds))).alias("p")).where("p.r IS NOT NULL")
    return out.select("problem_id", "chosen_id", F.col("p.r.rollout_id").alias("rejected_id"), "p.kind", (F.col("reward") - F.col("p.r.reward")).alias("margin"))


def matched_triples(pairs: DataFrame) -> DataFrame:
    """(problem_id, chosen_id, hard_id, easy_id, hard_margin, easy_margin) of chosen rollouts with a partner of both kinds."""
    h = pairs.where("kind = 'hard'").select("problem_id", "chosen_id", F.col("rejected_id").alias("hard_id"), F.col("margin").alias("hard_margin"))
    e = pairs.where("kind = 'easy'").select("problem_id", "chosen_id", F.col("rejected_id").alias("easy_id"), F.col("margin").alias("easy_margin"))
    return h.join(e, ["problem_id", "chosen_id"])


def length_matched(pairs: DataFrame, rollouts: DataFrame, bucket: int) -> DataFrame:
    """Pairs whose two responses lie in one length bucket."""
    t = rollouts.select("rollout_id", (F.col("response_token_count") / bucket).cast("long").alias("b"))
    a, b = t.select(F.col("rollout_id").alias("chosen_id"), F.col("b").alias("x")), t.select(F.col("rollout_id").alias("rejected_id"), F.col("b").alias("y"))
    return pairs.join(a, "chosen_id").join(b, "rejected_id").where("x = y").drop("x", "y")


def difficulty_strata(rollouts: DataFrame, bounds: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(problem_id, success, stratum): problems by success rate; the bounds are nearest-rank quantiles of the rates."""
    from ..functions.stats import numeric_stats

    per = rollouts.groupBy("problem_id").agg((F.count_if(F.col("verifier_status") == "AC") / F.count(F.lit(1))).alias("success"))
    qs = tuple(100 * b for b in bounds)
    cuts = numeric_stats(per, "success", qs)  # one row
    stratum = F.lit(0)
    for q in qs:
        stratum = stratum + F.when(F.col("success") > F.col(f"`p{q}`"), 1).otherwise(0)
    return per.crossJoin(F.broadcast(cuts)).select("problem_id", "success", stratum.alias("stratum"))
