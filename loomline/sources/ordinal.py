"""Sources whose rows are known by their ordinal: lines of a file, rows of name-sorted Parquet shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import checkpointed

#: Names of shards that may become a filter on a scan.
MOST_NAMES = 1000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): 0-based line numbers over all files in the order of their names, blank lines counted; rows of blank lines are left out.

    A block of a file is read in order by one task, so a line's place in its block is the distance of its running id from the block's
    smallest one. Blocks are put in order by one row each; lines never leave the JVM.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    blocks = lines.groupBy("_f", "_b").agg(F.min("_m").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(blocks.select("_f", "_b", "_lo", before.alias("_o")), ["_f", "_b"])
    return placed.where(F.trim("value") != "").select((F.col("_o") + F.col("_m") - F.col("_lo")).alias("ordinal"), "value")


def wanted_lines(spark: SparkSession, path: str, schema: str, wanted: DataFrame, id_field: str = "id") -> DataFrame:
    """Rows whose index is wanted; the index is the row's id, or its line number where the id is missing."""
    rows = numbered_lines(spark, path).withColumn("r", F.from_json("value", schema))
    index = F.coalesce(F.col(f"r.{id_field}").try_cast("long"), F.col("ordinal"))
    return rows.select(index.alias("index"), "r.*").join(wanted.select(F.col("index").cast("long")).distinct(), "index", "left_semi")


def numbered_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all Parquet shards with `ordinal`, global over shards in the order of their names.

    Offsets come from one row per shard; row positions from the scan's own metadata.
    """
    df = spark.read.parquet(path)
    rows = df.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    sizes = rows.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(W.orderBy("_f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("_f", offset.alias("_o")), "_f").withColumn("ordinal", F.col("_o") + F.col("_i")).drop("_f", "_i", "_o")


def wanted_shards(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows whose global ordinal is wanted.

    Ordinals meet the spans of shards by buckets of the mean shard size, so the join is one by equality with about two buckets per shard.
    Shards that hold none are not read, as long as the names of those that do are at most MOST_NAMES, which then filter the scan.
    """
    df = spark.read.parquet(path)
    sizes = df.select(F.col("_metadata.file_name").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("f"))
    spans = checkpointed(sizes.select("f", (upto - F.col("n")).alias("o"), upto.alias("e")).where("e > o"))
    width = max(1, int(spans.agg(F.avg(F.col("e") - F.col("o"))).first()[0] or 1))
    bucketed = spans.withColumn("k", F.explode(F.sequence(F.expr(f"o DIV {width}"), F.expr(f"(e - 1) DIV {width}"))))
    indices = wanted.select(F.col("index").cast("long").alias("w")).distinct().withColumn("k", F.expr(f"w DIV {width}"))
    local = checkpointed(indices.join(bucketed, "k").where("w >= o AND w < e").select("f", (F.col("w") - F.col("o")).alias("i"), F.col("w").alias("ordinal")))
    names = [r.f for r in local.select("f").distinct().limit(MOST_NAMES + 1).collect()]
    if len(names) <= MOST_NAMES:
        df = df.where(F.col("_metadata.file_name").isin(names))
    rows = df.select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    return rows.join(local, ["f", "i"]).drop("f", "i")


def capped(df: DataFrame, pos: str, cap: int) -> tuple[DataFrame, str]:
    """The first `cap` rows of a stream by position, and why it stopped."""
    more = df.where(F.col(pos) >= cap).limit(1).count()
    return df.where(F.col(pos) < cap), "max_records_reached" if more else "dataset_exhausted"


def prefix(df: DataFrame, pos: str, n: int | None, split: str | None = None) -> DataFrame:
    """Rows of a split in order of position, at most n (a top-k)."""
    rows = df if split is None else df.where(F.col("split") == split)
    return rows if n is None else rows.orderBy(pos).limit(n)
