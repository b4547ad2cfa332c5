"""Broken prompt and response pairs.

Method: responses are range-partitioned and sorted by text; a response that is a proper prefix of its
successor is a shortened version of it (`shortened`). If its last word goes on there, it is cut inside that word; else
how much that speaks for a cut is estimated over all texts (`prefix_evidence`). Either is added to the score that the
length-limit spikes and endings of `truncation` give. Copy, refusal and language rules follow on the joined pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .endings import says_nothing
from .language import LanguageModel, fit_languages
from .pair_rules import COPIED, copied_share, is_refusal, wrong_language
from .storage import checkpointed
from .tokens import content_hash, language_code
from .truncation import cut_scores, source_limits, text_endings

#: What it adds to the log-odds of being cut off that the last word or number of a response goes on in a longer version of it.
INSIDE = 12.0
#: Shares of other shortened versions among cut texts and among finished ones, believed before any text is seen; their weight in texts.
SHORTENED, WORTH = (0.02, 0.002), 20.0


def distinct_texts(reasoning: DataFrame) -> DataFrame:
    """Each different text once; equal texts are dropped inside a task before the shuffle, so copies stay few.

    Checkpointed, as the bounds of the ranges are sampled from the texts before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                key = content_hash(text)
                if key not in seen:
                    seen.add(key)
                    out.append(text)
            if len(seen) > 500_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["reasoning"])

    rows = reasoning.select(F.col("reasoning").cast("string").alias("reasoning")).where("length(reasoning) > 0")
    return checkpointed(rows.mapInArrow(run, "reasoning string"))


def shortened(reasoning: DataFrame) -> DataFrame:
    """(digest, inside): 128-bit digests of the texts that are proper prefixes of another text; inside: their last word goes on there.

    In text order the proper prefixes of a text directly precede it, so one comparison with the next
    different text decides. A scan holds one text. Where a partition ends, its last text and the next
    partition's first one are compared in a second step over one row per partition.
    """

    names, kinds = ["digest", "part", "first", "last", "inside"], (pa.binary(), pa.int32(), pa.string(), pa.string(), pa.bool_())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, out = None, []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if last is None:
                    out.append((content_hash(text), part, text, None, None))
                elif text != last and text.startswith(last):
                    out.append((content_hash(last), part, None, None, goes_on(last, text)))
                last = text
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((content_hash(last), part, None, last, None), kinds)], names=names)

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lasts, following = (batch.column(c).to_pylist() for c in ("digest", "last", "next"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([goes_on(a, b) for a, b in zip(lasts, following)], pa.bool_())], names=["digest", "inside"])

    ordered = distinct_texts(reasoning).repartitionByRange("reasoning").sortWithinPartitions("reasoning")
    rows = checkpointed(ordered.mapInArrow(scan, "digest binary, part int, first string, last string, inside boolean"))
    found = rows.where("inside IS NOT NULL").select("digest", "inside")
    firsts = rows.where("first IS NOT NULL").select("part", "first")
    # One row per partition that has texts: its last text, and the first one of the next such partition.
    lasts = rows.where("last IS NOT NULL").select("part", "last", "digest")
    following = F.lead("first").over(W.orderBy("part"))
    edges = firsts.join(lasts, "part").select("last", "digest", following.alias("next")).where("startswith(next, last) AND next <> last")
    return found.unionByName(edges.select("digest", "last", "next").mapInArrow(edge, "digest binary, inside boolean")).groupBy("digest").agg(F.bool_or("inside").alias("inside"))


def goes_on(text: str, longer: str) -> bool:
    """Does the last word or number of text go on in the longer text that begins with it?"""
    a, b = text[-1], longer[len(text)]
    return (a.isalnum() and b.isalnum()) or (a in ".," and b.isdigit() and text[-2:-1].isdigit())


def prefix_evidence(cut_prefix: float, cut_all: float, whole_prefix: float, whole_all: float) -> float:
    """Log-likelihood ratio, cut against finished, of being a shortened version, from expected counts of texts."""
    cut = (cut_prefix + WORTH * SHORTENED[0]) / (cut_all + WORTH)
    whole = (whole_prefix + WORTH * SHORTENED[1]) / (whole_all + WORTH)
    return math.log(cut / whole)


def prompts(problems: DataFrame) -> DataFrame:
    """(source, source_id, prompt): the prompt of the first delivery (smallest pos) of each problem."""
    rows = problems.where("source IS NOT NULL AND source_id IS NOT NULL").select("source", "source_id", "pos", "prompt")
    return rows.groupBy("source", "source_id").agg(F.min_by("prompt", "pos").alias("prompt"))


def defects(problems: DataFrame, reasoning: DataFrame) -> DataFrame:
    """(reasoning_id, defect) of the rows of reasoning that match a problem by (source, source_id) and are defective.

    Each has one defect, the first that holds of empty, truncated, refusal, copy, language. A null prompt
    reads as empty, so only empty, truncated and refusal can hold. Rows with a null source or source_id match
    nothing; a null reasoning_id is left out; repeated deliveries of a problem count once. Empty tables give no rows.
    """
    endings = text_endings(reasoning)
    scores = checkpointed(cut_scores(endings, source_limits(endings)).where("reasoning_id IS NOT NULL").select("reasoning_id", "score").distinct())
    short = shortened(reasoning)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [None if t is None else content_hash(t) for t in batch.column("reasoning").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("reasoning_id"), pa.array(keys, pa.binary())], names=["reasoning_id", "digest"])

    ids = reasoning.select(F.col("reasoning_id").cast("long").alias("reasoning_id"), "reasoning").mapInArrow(digest, "reasoning_id long, digest binary")
    prefix = ids.join(short, "digest").groupBy("reasoning_id").agg(F.bool_or("inside").alias("inside"))
    scores = checkpointed(scores.join(prefix, "reasoning_id", "left"))
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    sums = scores.where("NOT coalesce(inside, false)").agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for c in (chance, 1 - chance) for x in (F.when(~F.col("inside"), c), c))).first()
    # A text whose ending is finished by definition stays finished, whatever its neighbours are.
    total = F.col("score") + F.when(F.col("inside"), INSIDE).when(~F.col("inside"), prefix_evidence(*sums)).otherwise(0.0)
    cut = scores.where(total > 0).select("reasoning_id", F.lit(True).alias("cut")).distinct()
    rows = reasoning.where("source IS NOT NULL AND source_id IS NOT NULL AND reasoning_id IS NOT NULL")
    rows = rows.select(F.col("reasoning_id").cast("long").alias("reasoning_id"), "source", "source_id", F.col("reasoning").cast("string").alias("reasoning"))
    pairs = rows.join(prompts(problems), ["source", "source_id"]).join(cut, "reasoning_id", "left")
    model = fit_languages(problems.select(F.nullif(language_code(), F.lit("unknown")).alias("lang"), F.col("prompt").alias("text")))
    sent = reasoning.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES x DIMENSIONS numbers at most: 8 MB

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = sent.value
        for batch in batches:
            found = []
            for i, text, prompt, is_cut in zip(*(batch.column(c).to_pylist() for c in ("reasoning_id", "reasoning", "prompt", "cut"))):
                defect = defect_of(text, prompt or "", bool(is_cut), languages)
                if defect:
                    found.append((i, defect))
            if found:
                i, d = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(d, pa.string())], names=["reasoning_id", "defect"])

    return pairs.select("reasoning_id", "reasoning", "prompt", "cut").mapInArrow(judge, "reasoning_id long, defect string").distinct()


def defect_of(text: str | None, prompt: str, is_cut: bool, languages: LanguageModel) -> str | None:
    if says_nothing(text):
        return "empty"
    if is_cut:
        return "truncated"
    if is_refusal(text):
        return "refusal"
    if prompt and copied_share(text, prompt) >= COPIED:
        return "copy"
    if prompt and wrong_language(text, prompt, languages):
        return "language"
    return None
