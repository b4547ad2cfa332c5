"""Token budget per source, language and topic under an existing tokenizer.

Method: a count table keyed by content hash and tokenizer hash (`update_counts`). Only contents that the table lacks are encoded. What is
kept per slice is how often it holds each content; snapshots change that by signed deltas (`slice_delta`, `apply_delta`): texts that
appeared count +1, texts that went or moved to another slice -1, so removed documents leave the totals. A cube is read off the slices and
the count table (`cube`). `TokenBudget` holds both tables and takes one snapshot after the other.

Content moves as 16-byte hashes; texts are read and encoded where they are stored. A content that tasks read several times is encoded once
per task at most (of the last MOST_CONTENTS contents).
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import bitmap, in_bitmap
from .storage import checkpointed

#: Path of a rank file, one "base64 rank" per line; a parameter, never part of the repository.
RANKS = os.environ.get("LOOMLINE_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of byte-level BPE rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A task forgets the counts of contents it has encoded beyond this many.
MOST_CONTENTS = 200_000


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def tokenizer_hash(ranks: str = RANKS) -> str:
    with open(ranks, "rb") as file:
        return hashlib.sha256(PATTERN.encode() + b"\0" + file.read()).hexdigest()[:32]


def content_hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def count_tokens(texts: list[str | None], ranks: str = RANKS) -> list[int]:
    """Tokens of each text, special-token strings being ordinary text; null and lone surrogates are defined: 0, '?'."""
    encode = encoding(ranks).encode_ordinary
    return [len(encode(t if t.isascii() else t.encode("utf-8", "replace").decode())) if t else 0 for t in texts]


def encode(texts: DataFrame, ranks: str = RANKS) -> DataFrame:
    """texts (..., text) with `content` and `tokens` in place of text; equal texts of a task are encoded once."""
    kept = [c for c in texts.columns if c != "text"]
    rows = texts.select(*kept, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            keys = [None if t is None else content_hash(t) for t in all_texts]
            if len(known) > MOST_CONTENTS:
                known.clear()
            first = {k: t for k, t in zip(keys, all_texts) if k is not None and k not in known}
            known.update(zip(first, count_tokens(list(first.values()), ranks)))
            counts = [0 if k is None else known[k] for k in keys]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=[*kept, "content", "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}{', ' if kept else ''}content binary, tokens long")


def contents(texts: DataFrame) -> DataFrame:
    """texts (..., text) with `content` in place of text."""
    kept = [c for c in texts.columns if c != "text"]
    rows = texts.select(*kept, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [None if t is None else content_hash(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(keys, pa.binary())], names=[*kept, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}{', ' if kept else ''}content binary")


def update_counts(counts: DataFrame | None, texts: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The count table (content, tokenizer, tokens) after texts (text) were seen.

    Only hashes are shuffled to find unseen contents; a bit set of fixed size then picks the texts to encode.
    """
    tokenizer = F.lit(tokenizer_hash(ranks)).alias("tokenizer")
    texts = texts.where("text IS NOT NULL").select("text")
    if counts is None:
        return encode(texts, ranks).groupBy("content").agg(F.max("tokens").alias("tokens")).select("content", tokenizer, "tokens")
    known = counts.where(F.col("tokenizer") == tokenizer_hash(ranks)).select("content")
    unseen = checkpointed(contents(texts).distinct().join(known, "content", "left_anti"))
    wanted = bitmap(unseen.select(F.conv(F.hex(F.substring("content", 1, 7)), 16, 10).cast("long").alias("id")))
    sent = texts.sparkSession.sparkContext.broadcast(wanted)  # 1 MB, by construction

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([int.from_bytes(content_hash(t)[:7], "big") for t in batch.column(0).to_pylist()], dtype=np.int64)
            keep = np.flatnonzero(in_bitmap(ids, sent.value))
            if len(keep):
                yield batch.take(pa.array(keep))

    picked = encode(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(pick, "text string"), ranks)
    new = picked.join(unseen, "content", "left_semi").groupBy("content").agg(F.max("tokens").alias("tokens"))
    return counts.unionByName(new.select("content", tokenizer, "tokens"))


def slice_delta(before: DataFrame | None, after: DataFrame, slices: list[str]) -> DataFrame:
    """Signed change (slices..., content, texts) between two snapshots (key, slices..., content)."""
    columns = ["key", *slices, "content"]
    rows = after.select(*columns, F.lit(1).alias("sign"))
    if before is not None:
        rows = rows.unionByName(before.select(*columns, F.lit(-1).alias("sign")))
        rows = rows.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return rows.groupBy(*slices, "content").agg(F.sum("sign").alias("texts")).where("texts <> 0")


def apply_delta(held: DataFrame | None, delta: DataFrame, slices: list[str]) -> DataFrame:
    """How often each slice holds each content after a delta."""
    return delta if held is None else held.unionByName(delta).groupBy(*slices, "content").agg(F.sum("texts").alias("texts")).where("texts <> 0")


def cube(held: DataFrame, counts: DataFrame, slices: list[str], ranks: str = RANKS) -> DataFrame:
    """(slices..., texts, tokens, unique_tokens): repeated contents of a slice count in tokens, and once in unique_tokens."""
    known = counts.where(F.col("tokenizer") == tokenizer_hash(ranks)).select("content", "tokens")
    joined = held.join(known, "content", "left").select(*slices, "texts", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return joined.groupBy(*slices).agg(F.sum("texts").alias("texts"), F.sum(F.col("texts") * F.col("tokens")).alias("tokens"), F.sum("tokens").alias("unique_tokens"))


def clean(column: str):
    return F.coalesce(F.nullif(F.lower(F.trim(F.col(column).cast("string"))), F.lit("")), F.lit("unknown"))


def language_code(column: str = "lang"):
    """'en' of 'EN', ' en ' and 'en-XX'; 'unknown' of null."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(F.col(column).cast("string"))), "^[a-z]{2,3}", 0), F.lit("")), F.lit("unknown"))


SLICES = ["field", "source", "language", "topic"]


def snapshot(problems: DataFrame, reasoning: DataFrame, read: Callable[[DataFrame], DataFrame] = contents) -> DataFrame:
    """(key, field, source, language, topic, content) of problems.prompt and reasoning.reasoning, with the columns that `read` adds.

    A problem_id counts once (smallest pos), a row of reasoning each time. Reasoning takes language and topic of the problem it matches by
    (source, source_id), 'unknown' without one. Null texts count as no text. Sources, languages and topics are compared without case and
    outer blanks; null reads as 'unknown'.
    """
    slices = [clean("source").alias("source"), language_code().alias("language"), clean("topic").alias("topic")]
    rows = problems.where("problem_id IS NOT NULL").select("problem_id", "pos", F.col("source").alias("raw_source"), "source_id", *slices, F.col("prompt").alias("text"))
    each = read(rows)
    added = [c for c in each.columns if c not in rows.columns]
    best = F.min_by(F.struct("raw_source", "source_id", "source", "language", "topic", *added), F.struct("pos", "content")).alias("r")
    one = checkpointed(each.groupBy("problem_id").agg(best).select("problem_id", "r.*"))
    prompts = one.where("content IS NOT NULL").select(F.col("problem_id").alias("key"), F.lit("prompt").alias("field"), "source", "language", "topic", *added)
    known = one.groupBy("raw_source", "source_id").agg(F.min(F.struct("source", "language", "topic")).alias("p"))
    texts = read(reasoning.where("reasoning IS NOT NULL").select(F.col("reasoning_id").cast("string").alias("key"), F.col("source").alias("raw_source"), "source_id", F.col("reasoning").alias("text")))
    unknown = F.lit("unknown")
    answers = texts.join(known, ["raw_source", "source_id"], "left").select(
        "key", F.lit("reasoning").alias("field"), F.coalesce("p.source", F.lower(F.trim("raw_source")), unknown).alias("source"), F.coalesce("p.language", unknown).alias("language"),
        F.coalesce("p.topic", unknown).alias("topic"), *added,
    )
    return prompts.unionByName(answers)


@dataclass(frozen=True)
class TokenBudget:
    """What is kept from snapshot to snapshot: the count table, the last snapshot, and how often each slice holds each content."""

    counts: DataFrame
    seen: DataFrame
    held: DataFrame
    ranks: str = RANKS

    @classmethod
    def first(cls, problems: DataFrame, reasoning: DataFrame, ranks: str = RANKS) -> TokenBudget:
        """Every content is unseen, so contents are hashed and encoded in one reading of the texts."""
        rows = checkpointed(snapshot(problems, reasoning, lambda texts: encode(texts, ranks)))
        counts = rows.groupBy("content").agg(F.max("tokens").alias("tokens")).select("content", F.lit(tokenizer_hash(ranks)).alias("tokenizer"), "tokens")
        seen = rows.drop("tokens")
        return cls(checkpointed(counts), seen, checkpointed(apply_delta(None, slice_delta(None, seen, SLICES), SLICES)), ranks)

    def then(self, problems: DataFrame, reasoning: DataFrame) -> TokenBudget:
        """The budget after another snapshot: contents are hashed, the unseen ones encoded, and the slices changed by the signed delta."""
        seen = checkpointed(snapshot(problems, reasoning))
        texts = problems.select(F.col("prompt").alias("text")).unionByName(reasoning.select(F.col("reasoning").alias("text")))
        counts = checkpointed(update_counts(self.counts, texts, self.ranks))
        return TokenBudget(counts, seen, checkpointed(apply_delta(self.held, slice_delta(self.seen, seen, SLICES), SLICES)), self.ranks)

    def cube(self) -> DataFrame:
        return cube(self.held, self.counts, SLICES, self.ranks)


def token_cube(problems: DataFrame, reasoning: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(field, source, language, topic, texts, tokens, unique_tokens) of problems.prompt and reasoning.reasoning; see `snapshot`, `cube`.

    Empty tables give no rows.
    """
    return TokenBudget.first(problems, reasoning, ranks).cube()


def token_update(problems: DataFrame, reasoning: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The cube after a second snapshot, beside its recount: (field, source, language, topic, texts, tokens, recounted_texts, recounted_tokens).

    The first snapshot is what had been ingested by the middle of the tables' period of ingestion, the second everything but what was
    ingested in the first tenth of it, so that texts are new, changed and removed. Undated rows are in both. Empty tables give no rows.
    """
    at = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    ends = problems.select(at.alias("t")).unionByName(reasoning.select(at.alias("t"))).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    a, b = ends.a or 0, ends.b or 0
    old = [t.where(F.coalesce(at <= (a + b) // 2, F.lit(True))) for t in (problems, reasoning)]
    new = [t.where(F.coalesce(at > a + (b - a) // 10, F.lit(True))) for t in (problems, reasoning)]
    kept = TokenBudget.first(*old, ranks).then(*new).cube().drop("unique_tokens")
    again = snapshot(*new, lambda texts: encode(texts, ranks)).groupBy(*SLICES).agg(F.count(F.lit(1)).alias("recounted_texts"), F.sum("tokens").alias("recounted_tokens"))
    return kept.join(again, SLICES, "full_outer").na.fill(0)


def document_tokens(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens) of documents with an id and a text."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), clean("source").alias("source"), "text")
    return encode(rows, ranks).select("doc_id", "source", "tokens")
