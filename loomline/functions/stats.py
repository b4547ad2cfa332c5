"""Rates, nearest-rank percentiles and numeric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import running_total


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def rank_index(q: float, n: Column) -> Column:
    """0-based nearest rank of a percentile, halves rounded to even."""
    return F.rint(F.lit(q / 100.0) * (n - 1)).cast("long")


def numeric_stats(df: DataFrame, value: str, percentiles: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., count, p.., max) as doubles; nulls are not counted; an empty input gives count 0 and max 0.0 without by.

    Equal values are counted first. The histogram is then ranked by ranges of (group, value), so neither a large group nor a column
    without repeated values has to fit into one task.
    """
    group = [F.col(b) for b in by]
    hist = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = running_total(hist, [*by, "v"], "n")
    whole = rows.groupBy(*by).agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.sum("n").alias("all"), F.max("v").alias("top"))
    if by:
        same = [F.col(f"h.{b}").eqNullSafe(F.col(f"w.{b}")) for b in by]
        joined = rows.alias("h").join(whole.alias("w"), same).select(*(F.col(f"h.{b}").alias(b) for b in by), "v", "n", "upto", "start", "all", "top")
    else:
        joined = rows.crossJoin(whole)  # one row

    def hit(q: float) -> Column:
        at = F.col("start") + rank_index(q, F.col("all"))
        return F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at), F.col("v")))

    columns = {"count": F.sum("n").cast("double"), **{f"p{q}": hit(q) for q in percentiles}, "max": F.max("top")}
    if by:
        return joined.groupBy(*by).agg(*(c.alias(k) for k, c in columns.items()))
    return joined.agg(*(F.coalesce(c, F.lit(0.0)).alias(k) for k, c in columns.items()))


def threshold_counts(df: DataFrame, value: str, thresholds: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., threshold, count, rate) of values up to each threshold; one aggregate over all thresholds."""
    counts = [F.count_if(F.col(value) <= t).alias(f"c{t}") for t in thresholds]
    one = df.groupBy(*by).agg(F.count(value).alias("all"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"c{t}").alias("count")) for t in thresholds))).alias("t")
    return one.select(*by, "all", rows).select(*by, "t.threshold", "t.count", rate(F.col("t.count"), F.col("all")).alias("rate"))


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, count, rate) of each column on its own, in one pass by grouping sets; null reads as 'None'."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in columns))).alias("p")
    counted = df.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("rate", F.col("count") / F.sum("count").over(W.partitionBy("field")))


def distribution_shift(candidate: DataFrame, original: DataFrame) -> DataFrame:
    """(field, value, delta) of rates over the union of keys, a missing key counting 0."""
    a, b = candidate.select("field", "value", F.col("rate").alias("a")), original.select("field", "value", F.col("rate").alias("b"))
    return a.join(b, ["field", "value"], "full_outer").select("field", "value", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("delta"))


def subset_summary(df: DataFrame, rules: dict[str, Column], *columns: str) -> DataFrame:
    """(rule, count, rate, field, value, share, delta): size of the subset of each rule, its distribution, and the shift against all rows.

    One pass: every row is counted under each rule that holds for it and under 'all'.
    """
    named = F.array_compact(F.array(F.lit("all"), *(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in columns))
    counted = df.select(F.explode(named).alias("rule"), pairs.alias("p")).select("rule", F.explode("p").alias("p")).groupBy("rule", "p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
    per = counted.withColumn("count", F.sum("n").over(W.partitionBy("rule", "field"))).withColumn("share", F.col("n") / F.col("count"))
    whole = per.where("rule = 'all'").select("field", "value", F.col("share").alias("_all"), F.col("count").alias("_total"))
    names = df.sparkSession.createDataFrame([(n,) for n in rules], "rule string")
    every = names.crossJoin(whole)  # rules times different values
    out = every.join(per.where("rule <> 'all'").select("rule", "field", "value", "share", "count"), ["rule", "field", "value"], "left")
    size = F.max("count").over(W.partitionBy("rule"))
    return out.select(
        "rule", F.coalesce(size, F.lit(0)).alias("count"), rate(F.coalesce(size, F.lit(0)), F.col("_total")).alias("rate"), "field", "value", F.coalesce("share", F.lit(0.0)).alias("share"),
        (F.coalesce("share", F.lit(0.0)) - F.col("_all")).alias("delta"),
    )


def is_finite(c: Column) -> Column:
    """A number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) in product form; 1 where fewer than k attempts failed; null where n < k."""
    terms = F.sequence(n - c + 1, n)
    missed = F.aggregate(F.when(c > 0, terms).otherwise(F.array().cast("array<bigint>")), F.lit(1.0), lambda acc, i: acc * (1.0 - F.lit(float(k)) / i.cast("double")))
    return F.when(n < k, F.lit(None).cast("double")).when(n - c < k, F.lit(1.0)).otherwise(1.0 - missed)
