"""File hashes, line counts, configuration, resolution of splits, logging, sharded appends."""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file under a path, hashed where it is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def load_config(path: str | Path) -> dict:
    """YAML where a parser is installed, else JSON."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        value = json.loads(text)
    else:
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def resolve(path: str | Path, root: str | Path) -> Path:
    p = Path(path)
    return p if p.is_absolute() else Path(root) / p


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_splits(spark: SparkSession, root: str, splits: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Parquet data of the splits that exist, and those that do not: a missing split is reported, never replaced.

    The file system of the path itself is asked, so a shared store is seen as the executors see it.
    """
    found, missing = [], []
    for split in splits:
        (found if exists(spark, f"{root.rstrip('/')}/{split}") else missing).append(split)
    frames = [spark.read.parquet(f"{root.rstrip('/')}/{s}").withColumn("source_split", F.lit(s)) for s in found]
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out, missing


def merge_shards(shards: list[DataFrame], key: str, content: str) -> DataFrame:
    """Union of shards, one row per key; a key with two contents fails the query. Columns that are not used later are not read."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)
    kept = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(*(F.min_by(c, content).alias(c) for c in kept), F.min(content).alias("_lo"), F.max(content).alias("_hi"))
    same = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.lit(True)).otherwise(F.raise_error(F.lit("shards disagree")).cast("boolean"))
    return one.where(same).drop("_lo", "_hi")


def provenance(seeds: dict[str, int], packages: tuple[str, ...] = ("pyspark", "pyarrow")) -> dict:
    """What a report tells of its run: commit, whether files were changed, package and Python versions, seeds."""
    import platform
    import subprocess
    from importlib import metadata

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, check=True, timeout=30).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    versions = {}
    for name in packages:
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = None
    status = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "dirty": None if status is None else bool(status), "python": platform.python_version(), "packages": versions, "seeds": dict(seeds)}


def generation_config(config: dict) -> dict:
    """The part of a generation configuration that its hash covers: booleans and integers only, so its JSON is the same everywhere."""
    return {k: v for k, v in sorted(config.items()) if isinstance(v, (bool, int))}


def logger(name: str, path: str | None = None) -> logging.Logger:
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not log.handlers:
        log.addHandler(logging.StreamHandler(sys.stderr))
        if path:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            log.addHandler(logging.FileHandler(path, encoding="utf-8"))
    return log


def code_hash(paths: list[str | Path]) -> str:
    """A hash over files by name: name, NUL, bytes, NUL."""
    import hashlib

    h = hashlib.sha256()
    for p in sorted(map(Path, paths), key=lambda p: p.name):
        h.update(p.name.encode() + b"\0" + p.read_bytes() + b"\0")
    return h.hexdigest()
