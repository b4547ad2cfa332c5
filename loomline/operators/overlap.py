"""Exact and n-gram overlap between sets of problems, and blocking of the later splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import checkpointed
from ..functions.text import jaccard, let, ngram_set, normalize, normalized_hash, tokens_of


def shingled(problems: DataFrame, n: int, text: str = "prompt", keep: tuple[str, ...] = ()) -> DataFrame:
    """(problem_id, norm_hash, grams, keep...): distinct problem_ids with normalised text hash and set of n-gram hashes.

    Texts stay where they are read: hashes and sets are made there, n-grams as 64-bit hashes, so a set takes 8 bytes per n-gram in memory
    and shuffles. The sets are checkpointed, as every operator below reads them several times.
    """
    rows = problems.where(F.col("problem_id").isNotNull()).select("problem_id", "pos", *keep, normalize(F.coalesce(text, F.lit(""))).alias("_norm"))
    # The words are bound once per row: inside the lambda of n-grams they would be cut apart for every n-gram.
    grams = F.array_distinct(F.transform(let(tokens_of(F.col("_norm")), lambda words: ngram_set(words, n)), lambda g: F.xxhash64(g)))
    made = rows.select("problem_id", "pos", *keep, F.sha2("_norm", 256).alias("norm_hash"), grams.alias("grams"))
    return checkpointed(made.groupBy("problem_id").agg(*(F.min_by(c, "pos").alias(c) for c in ("norm_hash", "grams", *keep))))


def exact_groups(problems: DataFrame, text: str = "prompt") -> DataFrame:
    """(norm_hash, n, first_id): groups of two or more problems with one normalised text.

    Texts without an ASCII letter or digit normalise to the empty text and form one group.
    """
    rows = problems.select("problem_id", normalized_hash(F.coalesce(text, F.lit(""))).alias("norm_hash"))
    return rows.groupBy("norm_hash").agg(F.count_distinct("problem_id").alias("n"), F.min("problem_id").alias("first_id")).where("n > 1")


def exact_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(norm_hash, side, problem_id): the problems of either side whose text the other side has too.

    One row per problem instead of lists of ids per text, so a text of any number of copies stays distributed.
    """
    a = left.join(right.select("norm_hash").distinct(), "norm_hash", "left_semi").select("norm_hash", F.lit("left").alias("side"), "problem_id")
    b = right.join(left.select("norm_hash").distinct(), "norm_hash", "left_semi").select("norm_hash", F.lit("right").alias("side"), "problem_id")
    return a.unionByName(b)


def _prefixes(rows: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(problem_id, g): of every set the rarest n-grams, as many as a similar set must share at least one of."""
    each = rows.select("problem_id", F.size("grams").alias("size"), F.explode("grams").alias("g")).join(frequency, "g")
    rank = F.row_number().over(W.partitionBy("problem_id").orderBy("df", "g"))
    need = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1
    return each.withColumn("rank", rank).where(F.col("rank") <= need).select("problem_id", "g")


def near_pairs(left: DataFrame, right: DataFrame, threshold: float, same_ids: bool = False) -> DataFrame:
    """(left_id, right_id, score): every pair with a Jaccard similarity of the threshold or more, rounded to six places.

    A lossless inverted index over prefixes: two sets with similarity t share one of the size - ceil(t * size) + 1 rarest n-grams of
    either, so frequent n-grams, which would make the index quadratic, are posted by few sets only. Sets of candidates are compared
    exactly. The window is over the n-grams of one problem. A problem is not paired with itself, unless equal ids name different things.
    """
    frequency = left.select("problem_id", "grams").unionByName(right.select("problem_id", "grams")).select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    a = _prefixes(left, frequency, threshold).withColumnRenamed("problem_id", "left_id")
    b = _prefixes(right, frequency, threshold).withColumnRenamed("problem_id", "right_id")
    pairs = a.join(b, "g").where(F.lit(True) if same_ids else F.col("left_id") != F.col("right_id")).select("left_id", "right_id").distinct()
    x = left.select(F.col("problem_id").alias("left_id"), F.col("grams").alias("x"))
    y = right.select(F.col("problem_id").alias("right_id"), F.col("grams").alias("y"))
    score = jaccard(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))
    return pairs.join(x, "left_id").join(y, "right_id").select("left_id", "right_id", score.alias("score")).where(F.col("score") >= threshold).select("left_id", "right_id", F.round("score", 6).alias("score"))


def containment_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, share): share of the right set's n-grams that stand in the left set, of at least `least`.

    Lossless: of n n-grams of the right set, a left set that holds a share of them holds one of the n - ceil(least * n) + 1 that are rarest
    on the left, so frequent n-grams (boilerplate) are not joined. Left n-grams that no right set has are dropped before anything is
    counted, and sets of candidates are compared exactly.
    """
    y = right.select(F.col("problem_id").alias("right_id"), F.size("grams").alias("n"), F.explode("grams").alias("g"))
    x = left.select(F.col("problem_id").alias("left_id"), F.explode("grams").alias("g")).join(y.select("g").distinct(), "g", "left_semi")
    held = y.join(x.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "g")
    rank = F.row_number().over(W.partitionBy("right_id").orderBy("df", "g"))
    # n-grams that no left set has come first in the order and match nothing, so they use up the prefix.
    absent = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("right_id"))
    need = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    prefix = held.withColumns({"rank": rank, "absent": absent}).where(F.col("rank") + F.col("absent") <= need).select("right_id", "g")
    pairs = x.join(prefix, "g").select("left_id", "right_id").distinct()
    sets = pairs.join(left.select(F.col("problem_id").alias("left_id"), F.col("grams").alias("a")), "left_id").join(right.select(F.col("problem_id").alias("right_id"), F.col("grams").alias("b")), "right_id")
    share = F.try_divide(F.size(F.array_intersect("a", "b")).cast("double"), F.size("b"))
    return sets.select("left_id", "right_id", share.alias("share")).where(F.col("share") >= least)


def external_overlap(problems: DataFrame, external: DataFrame, n: int, threshold: float, contained: float) -> DataFrame:
    """(problem_id, external_id, kind): overlaps with an external set, each kind on its own.

    problems and external: (problem_id, pos, prompt, url), url being any identity of its own, null for none. kinds: 'id' (equal
    problem_ids), 'url', 'text' (equal normalised texts), 'near' (n-gram similarity of the threshold or more), 'contained' (that share of
    the external text's n-grams stands in the problem).
    """
    left, right = (shingled(t, n, keep=("url",)) for t in (problems, external))
    a, b = left.withColumnRenamed("problem_id", "p"), right.withColumnRenamed("problem_id", "e")
    same = {
        "id": left.select("problem_id").join(right.select("problem_id"), "problem_id").select(F.col("problem_id").alias("p"), F.col("problem_id").alias("e")),
        "url": a.where("url IS NOT NULL").select("p", "url").join(b.select("e", "url"), "url").select("p", "e"),
        "text": a.where(F.size("grams") > 0).select("p", "norm_hash").join(b.select("e", "norm_hash"), "norm_hash").select("p", "e"),
        "near": near_pairs(left, right, threshold, same_ids=True).select(F.col("left_id").alias("p"), F.col("right_id").alias("e")),
        "contained": containment_pairs(left, right, contained).select(F.col("left_id").alias("p"), F.col("right_id").alias("e")),
    }
    out = None
    for kind, rows in same.items():
        named = rows.select(F.col("p").alias("problem_id"), F.col("e").alias("external_id"), F.lit(kind).alias("kind"))
        out = named if out is None else out.unionByName(named)
    return out


def blocked(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(problem_id) of the right side that share an id, a text or a near duplicate with the left."""
    same = right.join(left.select("problem_id"), "problem_id", "left_semi").select("problem_id")
    text = right.join(left.select("norm_hash").distinct(), "norm_hash", "left_semi").select("problem_id")
    near = near_pairs(left, right, threshold).select(F.col("right_id").alias("problem_id"))
    return same.unionByName(text).unionByName(near).distinct()


def sequential_blocking(sft: DataFrame, pt: DataFrame, dev: DataFrame, threshold: float) -> DataFrame:
    """(split, problem_id) blocked: pt against sft, then dev against sft and what is left of pt."""
    from_pt = checkpointed(blocked(sft, pt, threshold))
    kept = pt.join(from_pt, "problem_id", "left_anti")
    from_dev = blocked(sft.unionByName(kept), dev, threshold)
    return from_pt.select(F.lit("pt").alias("split"), "problem_id").unionByName(from_dev.select(F.lit("dev").alias("split"), "problem_id"))


def overlap_counts(left: DataFrame, right: DataFrame, threshold: float, pair: str) -> DataFrame:
    """One row (pair, ids, texts, near) of overlap counts; a gate asks for three zeros."""
    ids = left.select("problem_id").intersect(right.select("problem_id")).agg(F.count(F.lit(1)).alias("ids"))
    texts = left.select("norm_hash").intersect(right.select("norm_hash")).agg(F.count(F.lit(1)).alias("texts"))
    near = near_pairs(left, right, threshold).agg(F.count(F.lit(1)).alias("near"))
    return ids.crossJoin(texts).crossJoin(near).select(F.lit(pair).alias("pair"), "ids", "texts", "near")  # one row each
