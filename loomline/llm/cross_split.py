"""Same or near-same records across splits.

Method: content-defined chunks. The words of a normalised record are cut where a rolling hash over WINDOW
words meets a condition, chunk digests are joined across splits, and the lengths of shared chunks are summed
into overlap fractions. Pairs that share a fraction of OVERLAP or more are compared exactly.

Chunks that many records have would make the join quadratic, so two steps keep them out of it without loss:

* A chunk that occurs more often than FREQUENT times (as told by a sketch of fixed size) is joined to the
  chunk that follows it, and so on until a rare chunk ends the run (or, in text that has none, a cut that
  depends on the chunk itself). The frequency of a joined chunk is at most that of its rarest part. All
  cuts depend on content alone, so equal passages are cut equally.
* Of each record the most frequent chunks, up to a fraction SKIP of its words, are not posted. Two records
  that share a fraction of OVERLAP of the longer one then still share OVERLAP - SKIP of it in posted chunks
  (the order by frequency and digest is the same for all records), which is the bound the join applies.

In a group of more than FREQUENT alike records all shared chunks are frequent, and what they are joined to may be
an edit. Each class is therefore also posted under the combinations of coordinates of `near_duplicates`, which don't
depend on frequency; such a key has no length and makes a candidate by itself.

A key whose parts occur in more than HOT records, as told by the sketches, is split into cells by a hash of the record:
each side of it goes to as many cells as the other side has parts, so no task holds a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mean_load, mix, occurrences, shingles_of, sketch_bits, slices, slots, words_of
from .near_duplicates import SIMILARITY, across, combined_keys, group_candidates, sequences_of
from .records import SHINGLE, batch_texts, class_ids, counted_members, digests, problem_records, similar, unseen
from .storage import checkpointed

#: A cut follows a word with a chance of one in CUT.
CUT, WINDOW = 3, 2
FREQUENT = 128.0
#: Combinations of coordinates under which a class is posted, besides its chunks.
BANDS = 24
#: Records that meet in one cell of a key, about.
HOT = 4096
#: A run of frequent chunks ends after a chunk with a chance of one in REST.
REST = 16
OVERLAP, SKIP = 0.14, 0.06
TRAIN, HELD_OUT = 1, 2

_U = np.uint64
_PLACE = mix(np.arange(1 << 16, dtype=np.uint64) + _U(12345)) | _U(1)


def _digest(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order-dependent digests of the runs of values that begin at starts."""
    place = (np.arange(len(values)) - np.repeat(starts, sizes)) & 0xFFFF
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(values) * _PLACE[place], starts))


def chunks(words: np.ndarray, counts: np.ndarray, cut: int = CUT, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, length in words, text) of the content-defined chunks of all texts."""
    if not len(words):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    with np.errstate(over="ignore"):
        rolling = words.copy()
        for j in range(1, window):
            rolling[j:] += words[:-j] * _U(pow(0x9E3779B97F4A7C15, j, 1 << 64))
        ends = (mix(rolling) >> _U(40)) % _U(cut) == 0
    ends[np.cumsum(counts)[counts > 0] - 1] = True
    last = np.flatnonzero(ends)
    starts = np.concatenate(([0], last[:-1] + 1))
    sizes = last - starts + 1
    return _digest(words, starts, sizes), sizes, np.repeat(np.arange(len(counts)), counts)[last]


def join_frequent(digest: np.ndarray, sizes: np.ndarray, text: np.ndarray, times: np.ndarray, frequent: float) -> tuple[np.ndarray, ...]:
    """Join chunks that occur more than `frequent` times to their successors; (digest, length, text, times)."""
    if not len(digest):
        return digest, sizes, text, times
    final = np.ones(len(text), dtype=bool)
    final[:-1] = text[1:] != text[:-1]
    ends = (times <= frequent) | ((digest >> _U(20)) % _U(REST) == 0) | final
    # A frequent rest at a text's end belongs to the chunk before it.
    ends[:-1] &= ~(ends[:-1] & ~final[:-1] & (final & (times > frequent))[1:])
    last = np.flatnonzero(ends)
    starts = np.concatenate(([0], last[:-1] + 1))
    return _digest(digest, starts, last - starts + 1), np.add.reduceat(sizes, starts), text[last], np.minimum.reduceat(times, starts)


def once(digest: np.ndarray, sizes: np.ndarray, text: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each chunk once per text, however often the text repeats it."""
    order = np.lexsort((digest, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]) | (text[order][1:] != text[order][:-1])
    first = order[new]
    return digest[first], sizes[first], text[first], times[first]


def posted(digest: np.ndarray, sizes: np.ndarray, text: np.ndarray, times: np.ndarray, counts: np.ndarray, frequent: float, skip: float) -> np.ndarray:
    """Which chunks are posted: all but the most frequent ones, up to a fraction skip of their text's words."""
    order = np.lexsort((digest, -times, text))
    total = np.cumsum(sizes[order])
    first = np.searchsorted(text[order], text[order])  # of the text's chunks
    so_far = total - (total[first] - sizes[order][first])
    keep = np.ones(len(digest), dtype=bool)
    keep[order] = (so_far > skip * counts[text[order]]) | (times[order] <= frequent)
    return keep


def chunk_digests(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return chunks(words, counts)[0]


def split_of(source_id: str = "source_id"):
    """The text of source_id before its first colon; null if it has no colon."""
    return F.when(F.col(source_id).contains(":"), F.substring_index(source_id, ":", 1))


def side():
    """TRAIN, HELD_OUT or 0 by the split of a record."""
    return F.when(split_of() == "train", TRAIN).when(split_of().isin("test", "valid"), HELD_OUT).otherwise(0)


def cells(keys: np.ndarray, ids: np.ndarray, sides: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell keys, which row): a key of up to HOT records is one cell; a hotter one has parts x parts of them.

    A train record goes to all cells of its row, a held-out one to all cells of its column, so each two meet in one cell.
    """
    parts = np.maximum(np.ceil(times / HOT), 1).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = (mix(ids.view(np.uint64)) >> _U(8)).astype(np.int64)[row] % parts[row]
    at = np.where(sides[row] == TRAIN, own * parts[row] + k, k * parts[row] + own)
    with np.errstate(over="ignore"):
        return np.where(parts[row] > 1, mix(keys[row] + at.astype(np.uint64)), keys[row]), row


def posted_chunks(records: DataFrame, chunk_codes: np.ndarray, codes: np.ndarray) -> DataFrame:
    """(chunk, id, side, words, size) of the posted chunks of each class of equal records on each side, and of its combined coordinates.

    words is the length of the record's distinct chunks: a repeated passage counts once, as in the similarity. A combination has the
    size of 0. A task posts a class and side once, however many copies it reads.
    """
    chunk_bits, bits = int(np.log2(len(chunk_codes))), int(np.log2(len(codes)))
    frequent = max(FREQUENT, 3 * mean_load(chunk_codes))
    table = occurrences(np.arange(256, dtype=np.uint8))
    sent = records.sparkSession.sparkContext.broadcast((chunk_codes, codes))  # 32 MB at most, by construction

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        chunk_codes, codes = sent.value
        for batch in batches:
            texts, sides = batch_texts(batch), batch.column("side").to_numpy(zero_copy_only=False)
            for i, j in slices(texts):
                words, counts = words_of(texts[i:j])
                ids = class_ids(digests(words, counts))
                new = unseen(list(zip(ids.tolist(), sides[i:j].tolist())), counts, SHINGLE, seen)
                if not new.any():
                    continue
                words, counts, ids, side = words[np.repeat(new, counts)], counts[new], ids[new], sides[i:j][new].astype(np.int8)
                digest, sizes, text = chunks(words, counts)
                digest, sizes, text, times = join_frequent(digest, sizes, text, table[chunk_codes[slots(digest, chunk_bits)]], frequent)
                digest, sizes, text, times = once(digest, sizes, text, times)
                total = np.bincount(text, weights=sizes, minlength=len(counts)).astype(np.int64)
                keep = posted(digest, sizes, text, times, total, frequent, SKIP)
                h, n = shingles_of(words, counts, SHINGLE)
                found = codes[slots(h, bits)]
                combined, some = combined_keys(h, n, found, BANDS)
                own = np.repeat(np.flatnonzero(some), BANDS)
                keys, of = np.concatenate((digest[keep], combined.ravel())), np.concatenate((text[keep], own))
                size, times = np.concatenate((sizes[keep], np.zeros(len(own), dtype=np.int64))), np.concatenate((times[keep], np.ones(len(own))))
                keys, row = cells(keys, ids[of], side[of], times)
                of, size = of[row], size[row]
                columns = [keys.view(np.int64), ids[of], side[of], total[of].astype(np.int32), size.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "id", "side", "words", "size"])

    rows = records.select(side().alias("side"), "prompt", "reference_code").where("side <> 0")
    return rows.mapInArrow(run, "chunk long, id long, side byte, words int, size int")


def overlaps(chunks: DataFrame, at_least: float = OVERLAP) -> DataFrame:
    """(a, b, shared) of a class in train and one held out; shared: fraction of the longer record's distinct chunks in shared posted chunks.

    Pairs that share a combination of coordinates come out whatever their fraction is.
    """
    # Partitioned by chunk once, for the copies of a class in several tasks, and for both sides of the join.
    one = chunks.repartition("chunk").groupBy("chunk", "id", "side").agg(F.max("words").alias("words"), F.max("size").alias("size"))
    a = one.where(f"side = {TRAIN}").select("chunk", F.col("id").alias("a"), F.col("words").alias("wa"), F.col("size").alias("sa"))
    b = one.where(f"side = {HELD_OUT}").select("chunk", F.col("id").alias("b"), F.col("words").alias("wb"), F.col("size").alias("sb"))
    joined = a.join(b, "chunk").where("a <> b")
    shared = (F.sum(F.least("sa", "sb")) / F.max(F.greatest("wa", "wb"))).alias("shared")
    return joined.groupBy("a", "b").agg(shared, F.min("sa").alias("least")).where((F.col("shared") >= at_least - SKIP) | (F.col("least") == 0)).drop("least")


def across_splits(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes with a record in train and one held out."""
    of = members.groupBy("id").agg(F.bit_or("side").alias("sides"))
    joined = pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    return joined.where(f"x | y = {TRAIN | HELD_OUT}").select("a", "b")


def class_overlaps(problems: DataFrame, at_least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity, shared) of classes across the splits, and (problem_id, source_id, id, side) of records in a split.

    shared is the fraction in shared posted chunks, null for pairs that a group implied.
    """
    records = problem_records(problems)
    rows = records.count()
    (chunk_codes, codes), members = counted_members(records, [(sketch_bits(rows, 64), chunk_digests), (sketch_bits(rows), sequences_of)])
    members = checkpointed(members.withColumn("side", side()).where("side <> 0"))
    found = overlaps(posted_chunks(records, chunk_codes, codes)).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("shared").alias("shared"))
    found = checkpointed(found)
    pairs = checkpointed(similar(records, members, found.select("a", "b"), at_least))
    more = checkpointed(across_splits(group_candidates(pairs, sided=True), members))
    if not more.isEmpty():
        pairs = pairs.unionByName(similar(records, members, more, at_least))
    return checkpointed(pairs.join(found, ["a", "b"], "left")), members


def cross_split_pairs(problems: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """Pairs of different problem_ids, one in split train, one in test or valid, with a similarity of at_least or more.

    A source_id without a colon, or null, is in no split. Empty tables give no pairs; see `records` for
    nulls, repeated deliveries and short texts. Columns: problem_id_a, problem_id_b (a < b).
    """
    pairs, members = class_overlaps(problems, at_least)
    left, right = members.where(F.col("side") == TRAIN), members.where(F.col("side") == HELD_OUT)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = members.groupBy("id").agg(F.bit_or("side").alias("sides")).where(f"sides = {TRAIN | HELD_OUT}")
    same = of.select(F.col("id").alias("a"), F.col("id").alias("b"))
    found = across(both.unionByName(same), left, right)
    return found.select(F.least("p", "q").alias("problem_id_a"), F.greatest("p", "q").alias("problem_id_b"))


def cross_split_overlap(problems: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """(problem_id, split, source, links, overlap, similarity) of every problem that stands, exactly or almost, across the splits.

    links: problems of the other side that it overlaps with; overlap: the largest summed fraction of its chunks that one of them shares,
    1.0 for a copy, null if only its group implied the pair; similarity: the largest exact one. One row per problem, however many
    counterparts it has.
    """
    pairs, members = class_overlaps(problems, at_least)
    count = lambda side: F.count_if(F.col("side") == side)
    sizes = members.groupBy(F.col("id").alias("b")).agg(count(TRAIN).alias("train"), count(HELD_OUT).alias("held"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity", "shared"))
    same = sizes.where("train > 0 AND held > 0").select(F.col("b").alias("a"), "b", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("shared"))
    met = both.unionByName(same).join(sizes, "b")

    def against(other: str) -> DataFrame:
        return met.where(F.col(other) > 0).groupBy(F.col("a").alias("id")).agg(F.sum(other).alias("links"), F.max("shared").alias("overlap"), F.max("similarity").alias("similarity"))

    left = members.where(F.col("side") == TRAIN).join(against("held"), "id")
    right = members.where(F.col("side") == HELD_OUT).join(against("train"), "id")
    sources = problems.where("problem_id IS NOT NULL").groupBy("problem_id").agg(F.min_by(F.lower(F.trim("source")), F.coalesce("pos", F.lit(2**63 - 1))).alias("source"))
    rows = left.unionByName(right).join(sources, "problem_id")
    return rows.select("problem_id", split_of().alias("split"), "source", "links", F.round("overlap", 6).alias("overlap"), F.round("similarity", 6).alias("similarity"))


def cross_split_report(problems: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per split and source: problems, how many of them have a counterpart across the splits, and the share.

    Every split of the table is reported, those without a counterpart with 0; a source_id without a colon
    is in split 'none'.
    """
    ids = pairs.select(F.explode(F.array("problem_id_a", "problem_id_b")).alias("problem_id")).distinct().withColumn("hit", F.lit(1))
    named = F.coalesce(split_of(), F.lit("none")).alias("split")
    one = problems.where(F.col("problem_id").isNotNull()).groupBy("problem_id").agg(F.min_by(F.struct("source", "source_id"), "pos").alias("r"))
    one = one.select("problem_id", F.lower(F.trim("r.source")).alias("source"), F.col("r.source_id").alias("source_id")).select("problem_id", "source", named)
    joined = one.join(ids, "problem_id", "left")
    out = joined.groupBy("split", "source").agg(F.count(F.lit(1)).alias("problems"), F.count("hit").alias("overlapping"))
    return out.select("split", "source", "problems", "overlapping", (F.col("overlapping") / F.col("problems")).alias("share"))
