"""Problem records: one per problem_id, classes of equal word sequences, exact similarity of pairs.

Rules shared by the pair operators:

* Repeated deliveries of a problem_id count once; if they differ, the one with the smallest pos (a null
  pos comes last), and of these the one with the smallest digest, counts. Rows with a null problem_id are no problem and are left out.
* A null prompt or reference_code reads as empty. A record with fewer than three words has no three-word
  sequence and is similar to nothing, not even to its own copy.
* Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BLOCK, bitmap, frequency_code, in_bitmap, list_array, pack_counts, record_text, shingles_of, slices, slots, words_of
from .storage import checkpointed

SHINGLE = 3
LAST = 2**63 - 1


def problem_records(problems: DataFrame) -> DataFrame:
    """(row, pos, problem_id, source_id, prompt, reference_code); row finds a record again, alone or with few others."""
    return problems.where(F.col("problem_id").isNotNull()).select(
        F.xxhash64("problem_id", "pos").alias("row"), F.coalesce(F.col("pos").cast("long"), F.lit(LAST)).alias("pos"), "problem_id", "source_id", "prompt", "reference_code"
    )


def batch_texts(batch: pa.RecordBatch) -> list[str]:
    return [record_text(p, c) for p, c in zip(batch.column("prompt").to_pylist(), batch.column("reference_code").to_pylist())]


def digests(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each text's word sequence."""
    import xxhash

    ends = np.cumsum(counts)
    return [xxhash.xxh3_128_digest(words[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]


def class_ids(digest: list[bytes]) -> np.ndarray:
    """The first 64 bits of the digests: ids of classes of equal word sequences."""
    return np.frombuffer(b"".join(d[:8] for d in digest), dtype="<i8").astype(np.int64)


def one_per_problem(rows: DataFrame, *kept: str) -> DataFrame:
    """The delivery that counts of each problem_id, with the columns kept; small rows only."""
    best = F.min_by(F.struct(*kept), F.struct("pos", "digest", "row")).alias("r")
    return rows.groupBy("problem_id").agg(best).select("problem_id", "r.*")


def counted_members(records: DataFrame, sketches: list[tuple[int, Callable]], n: int = SHINGLE) -> tuple[list[np.ndarray], DataFrame]:
    """(frequency codes of each sketch, (problem_id, row, source_id, id) of the delivery of each problem that counts and has n words or more).

    One reading of the texts. A sketch is (bits, hashes of the words and counts of some texts); a class of equal records is counted once per
    task, so copies hardly raise a frequency. Summed counters and members are small; only they are checkpointed.
    """
    step = 1 << 20  # more than the blocks of a sketch
    schema = "block int, counts binary, pos long, row long, problem_id string, source_id string, digest binary, id long, some boolean"
    members = ["pos", "row", "problem_id", "source_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [np.zeros(1 << bits, dtype=np.uint32) for bits, _ in sketches]
        seen: set[int] = set()
        for batch in batches:
            texts = batch_texts(batch)
            for i, j in slices(texts):
                words, counts = words_of(texts[i:j])
                digest = digests(words, counts)
                ids = class_ids(digest)
                columns = [pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary()), *(batch.column(c).slice(i, j - i) for c in members)]
                columns += [pa.array(digest, pa.binary()), pa.array(ids), pa.array(counts >= n)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "counts", *members, "digest", "id", "some"])
                new = unseen(ids, counts, n, seen)
                if new.any():
                    for (bits, hashes), into in zip(sketches, counters):
                        at, times = np.unique(slots(hashes(words[np.repeat(new, counts)], counts[new]), bits), return_counts=True)
                        into[at] += times.astype(np.uint32)
        for k, into in enumerate(counters):
            for part in pack_counts(into):
                block = pa.array(part.column(0).to_numpy() + k * step, pa.int32())
                empty = [pa.nulls(len(part), t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([block, part.column(1), *empty], names=["block", "counts", *members, "digest", "id", "some"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            is_block = batch.column("block").is_valid()
            for b, raw in zip(*(batch.column(c).filter(is_block).to_pylist() for c in ("block", "counts"))):
                part = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
                blocks[b] = blocks[b] + part if b in blocks else part
            yield batch.filter(batch.column("block").is_null())
        for b, total in blocks.items():
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([frequency_code(total).tobytes()], pa.binary()), *empty], names=["block", "counts", *members, "digest", "id", "some"])

    rows = records.select(*members, "prompt", "reference_code").mapInArrow(read, schema)
    rows = rows.repartition(F.coalesce(F.col("block"), F.hash("row")))
    rows = checkpointed(rows.mapInArrow(merge, schema))
    codes = [np.zeros(1 << bits, dtype=np.uint8) for bits, _ in sketches]
    for r in rows.where("block IS NOT NULL").select("block", "counts").collect():  # 2**bits bytes per sketch, whatever the corpus holds
        k, b = divmod(r.block, step)
        codes[k][b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(r.counts, dtype=np.uint8)
    found = one_per_problem(rows.where("problem_id IS NOT NULL"), "row", "source_id", "id", "some")
    return codes, found.where("some").select("problem_id", "row", "source_id", "id")


def unseen(ids: np.ndarray, counts: np.ndarray, n: int, seen: set) -> np.ndarray:
    """Which texts have n words or more and a key that the task has not met before; of a bounded number of keys."""
    new = np.zeros(len(ids), dtype=bool)
    for k, x in enumerate(ids.tolist() if isinstance(ids, np.ndarray) else ids):
        if counts[k] >= n and x not in seen:
            seen.add(x)
            new[k] = True
    if len(seen) > 500_000:
        seen.clear()
    return new


def shingle_sets(records: DataFrame, wanted: np.ndarray, n: int = SHINGLE) -> DataFrame:
    """(id, shingles): class and set of n-word sequences of each record whose row may be wanted; each class once per task."""
    sent = records.sparkSession.sparkContext.broadcast(wanted)  # 1 MB, by construction

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(in_bitmap(rows, sent.value))
            if not len(keep):
                continue
            texts = batch_texts(batch.take(pa.array(keep)))
            for i, j in slices(texts):
                words, counts = words_of(texts[i:j])
                ids = class_ids(digests(words, counts))
                new = unseen(ids, counts, n, seen)
                if not new.any():
                    continue
                h, sizes = shingles_of(words[np.repeat(new, counts)], counts[new], n)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.ones(len(h), dtype=bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[new]), list_array(h[first].view(np.int64), np.bincount(doc[first], minlength=len(sizes)))], names=["id", "shingles"])

    return records.select("row", "prompt", "reference_code").mapInArrow(run, "id long, shingles array<long>")


def similar(records: DataFrame, members: DataFrame, pairs: DataFrame, at_least: float) -> DataFrame:
    """Of the candidate pairs (a, b) of class ids those whose records reach the similarity, which is added.

    The sets are compared exactly. Only records of classes that occur in a pair are shuffled: a bit set of 1 MB drops most others
    while the texts are read, and the join by class drops the rest, so a record is only ever taken for its own class.
    """
    pairs = checkpointed(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    reps = checkpointed(members.groupBy("id").agg(F.min("row").alias("row")).join(ids, "id", "left_semi"))
    sets = shingle_sets(records, bitmap(reps.select("row"))).join(reps, "id", "left_semi").dropDuplicates(["id"])
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return joined.select("a", "b", F.try_divide(F.col("n").cast("double"), F.col("m") - F.col("n")).alias("similarity")).where(F.col("similarity") >= at_least)
