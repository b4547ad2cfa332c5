"""JSONL and JSON sources and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON objects; blank lines are skipped, a malformed line or one that is no object fails the query."""
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", "\\s", " ")) != "")
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    bad = ~F.trim("value").startswith("{")
    checked = lines.where(F.when(bad, F.raise_error(F.lit("a line is not a JSON object")).cast("boolean")).otherwise(F.lit(True)))
    return checked.select(row.alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, json_line: Column, order: str | None = None, single: bool = False, overwrite: bool = False) -> None:
    """One stable JSON object per line. Order is kept across files by range partitions; a single file is for small tables."""
    rows = df.select(*([order] if order else []), json_line.alias("value"))
    if order:
        rows = rows.repartitionByRange(1, order).sortWithinPartitions(order) if single else rows.repartitionByRange(order).sortWithinPartitions(order)
    elif single:
        rows = rows.coalesce(1)
    rows.select("value").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_json(value: object, path: str | Path) -> None:
    """A small report: sorted keys, two blanks of indent."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def read_json(path: str | Path) -> object:
    return json.loads(Path(path).read_text(encoding="utf-8"))
