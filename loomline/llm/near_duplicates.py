"""Near-duplicate records with small edits, insertions or a changed order.

Method: a signature-coordinate inverted join. Each record has COORDINATES min-hash coordinates over its
three-word sequences. Records are posted under each (coordinate, value) pair; records that meet in a posting
list collide, collisions are counted per pair, and pairs with MATCHES collisions or more are retained. An
exact comparison of the sets of three-word sequences follows.

Postings stay short without any cap, by three means:

* A sequence that occurs once in the corpus can't be shared and is no coordinate.
* Coordinates are weighted. A sequence that occurs more often than `common` times in the corpus (as told by
  a sketch of fixed size) is chosen with a chance that falls with the square of its frequency, the same way
  in every record. So a phrase that stands in a third of all records is hardly ever a coordinate.
* Records with the same words are one class; only its representative is posted.

What a big group of alike records shares is frequent too, and weighted away. So each class is also posted under
BANDS combinations of ROWS unweighted coordinates, taken over its sequences less the third (DROP) that is most
frequent in the corpus and those that occur once. All records rank sequences alike, so two of the same length n
that share 2/3 n sequences (similarity 0.5) share 1/3 n or more of n kept ones, whatever the frequencies are.
A collision of a combination weighs MATCHES: one makes a pair a candidate.

A list longer than LONG (a cluster of records that are alike, but not the same) streams through the merge and is
compared in blocks of BLOCK ids by counting the keys they share (`long_pairs`). No list is dropped. Pairs that a
group implies but the signatures miss are compared in a second round (`group_candidates`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import meet
from .hashing import mean_load, mix, occurrences, shingles_of, sketch_bits, slices, slots, starts_of, words_of
from .records import SHINGLE, batch_texts, class_ids, counted_members, digests, problem_records, similar, unseen
from .storage import checkpointed

COORDINATES = 24
MATCHES = 5
#: Sequences with at most this many occurrences have full weight.
COMMON = 8.0
LONG = 256
#: Ids of a long list that are compared at once.
BLOCK = 2048
#: Share of a record's distinct sequences, the most frequent ones, that group coordinates leave out.
DROP = 1 / 3
#: BANDS combinations of ROWS of UNWEIGHTED coordinates: each coordinate is in three of them.
UNWEIGHTED, BANDS, ROWS = 48, 36, 4
SIMILARITY = 0.5

_U = np.uint64
_ROUND = np.random.default_rng(20240817).integers(1, 2**62, size=256, dtype=np.uint64) * _U(2) + _U(1)
_COMBINED = np.concatenate([np.random.default_rng(7 + k).permutation(UNWEIGHTED).reshape(-1, ROWS) for k in range(BANDS * ROWS // UNWEIGHTED)])


def sequences_of(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return shingles_of(words, counts, SHINGLE)[0]


def signatures(h: np.ndarray, sizes: np.ndarray, penalty: np.ndarray, coordinates: int) -> np.ndarray:
    """Weighted min-hash: even posting keys, one row per text with sequences, one column per coordinate."""
    starts = starts_of(sizes[sizes > 0])
    keys = np.empty((len(starts), coordinates), dtype=np.uint64)
    low = h >> _U(32)
    with np.errstate(over="ignore"):
        for k in range(coordinates):
            rank = ((h * _ROUND[k]) >> _U(40)).astype(np.float32) + np.float32(1)
            rank *= penalty
            first = np.minimum.reduceat((rank.view(np.uint32).astype(np.uint64) << _U(32)) | low, starts)
            keys[:, k] = mix(first * _U(2 * k + 1) + _U(k))
    return keys & ~_U(1)


def shared_sequences(h: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of each text, less the DROP most frequent and those that occur once; their number per text."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    order = np.argsort((doc << _U(40)) | ((_U(255) - codes.astype(np.uint64)) << _U(32)) | (h >> _U(32)))
    h, codes, doc = h[order], codes[order], doc.astype(np.int64)
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, codes, doc = h[new], codes[new], doc[new]
    distinct = np.bincount(doc, minlength=len(sizes))
    rank = np.arange(len(h)) - starts_of(distinct)[doc]
    keep = (rank >= np.floor(DROP * distinct)[doc]) & (codes > 1)
    return h[keep], np.bincount(doc[keep], minlength=len(sizes))


def combined_keys(h: np.ndarray, sizes: np.ndarray, codes: np.ndarray, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(odd posting keys under combinations of unweighted coordinates, which texts have them)."""
    h, sizes = shared_sequences(h, sizes, codes)
    if not len(h):
        return np.zeros((0, bands), dtype=np.uint64), sizes > 0
    single = signatures(h, sizes, np.ones(len(h), dtype=np.float32), UNWEIGHTED)
    keys = np.zeros((len(single), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mix(keys + single[:, _COMBINED[:bands, k]])
    return keys | _U(1), sizes > 0


def single_keys(h: np.ndarray, sizes: np.ndarray, codes: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(even posting keys under weighted coordinates, which texts have them); sequences that occur once are no coordinate."""
    keep = codes > 1
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
    return signatures(h[keep], sizes, penalty[codes[keep]], COORDINATES), sizes > 0


def penalties(codes: np.ndarray) -> np.ndarray:
    """What each frequency code costs in the choice of coordinates."""
    common = max(COMMON, 1.5 * mean_load(codes))
    return np.maximum((occurrences(np.arange(256, dtype=np.uint8)) / common) ** 2, 1).astype(np.float32)


def postings(records: DataFrame, codes: np.ndarray, n: int = SHINGLE) -> DataFrame:
    """(key, id): the posting of each class of equal records under its coordinates (even keys) and combinations of coordinates (odd keys).

    A task posts a class once; copies of a class in several tasks are dropped when the lists are merged.
    """
    bits, table = int(np.log2(len(codes))), penalties(codes)
    sent = records.sparkSession.sparkContext.broadcast(codes)  # 16 MB at most, by construction

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch_texts(batch)
            for i, j in slices(texts):
                words, counts = words_of(texts[i:j])
                ids = class_ids(digests(words, counts))
                new = unseen(ids, counts, n, seen)
                if not new.any():
                    continue
                ids = ids[new]
                h, sizes = shingles_of(words[np.repeat(new, counts)], counts[new], n)
                found = sent.value[slots(h, bits)]
                for keys, some in (single_keys(h, sizes, found, table), combined_keys(h, sizes, found)):
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[some], keys.shape[1]))], names=["key", "id"])

    return records.select("prompt", "reference_code").mapInArrow(post, "key long, id long")


def _runs(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Sorted (key, id) batches as (keys, ids, False) of whole lists of up to `long` ids, each id once, and (keys, ids, True) of longer ones.

    A list that grows longer than `long` comes out in parts, so memory is that of a batch and `long` ids.
    """
    keys, ids, hot = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
        ids = np.concatenate((ids, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(keys):
            continue
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[new], ids[new]
        last = int(np.searchsorted(keys, keys[-1]))
        yield from _sorted_out(keys[:last], ids[:last], long, hot)
        keys, ids = keys[last:], ids[last:]
        if len(keys) > long or keys[0] == hot:
            hot = keys[0]
            yield keys, ids, True
            keys, ids = keys[:0], ids[:0]
    yield from _sorted_out(keys, ids, long, hot)


def _sorted_out(keys: np.ndarray, ids: np.ndarray, long: int, hot: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    if not len(keys):
        return
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)]))
    sizes = np.diff(edges)
    skipped = np.repeat(sizes > long, sizes)
    if hot is not None:
        skipped |= keys == hot
    for part, is_long in ((~skipped, False), (skipped, True)):
        if part.any():
            yield keys[part], ids[part], is_long


def _pairs_of(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, collisions) of the ids of each list; a combination counts MATCHES."""
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)]))
    sizes, weight = np.diff(edges), np.where(keys[edges[:-1]] & 1, MATCHES, 1).astype(np.int32)
    a, b, m = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
    for size in np.unique(sizes[sizes > 1]):
        members = ids[edges[:-1][sizes == size][:, None] + np.arange(size)]
        x, y = np.triu_indices(size, 1)
        a.append(members[:, x].ravel())
        b.append(members[:, y].ravel())
        m.append(np.repeat(weight[sizes == size], len(x)))
    return np.concatenate(a), np.concatenate(b), np.concatenate(m)


def merge_skip(lists: DataFrame, long: int = LONG) -> DataFrame:
    """Collisions from posting lists (key, id): (a, b, m) of two ids, a < b, or (id, key, -1) of a long list.

    Lists of up to `long` ids are merged; the ids of longer ones come out with the list's key.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, is_long in _runs(batches, long):
            a, b, m = (ids, keys, np.full(len(ids), -1, dtype=np.int32)) if is_long else _pairs_of(keys, ids)
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (a, b, m)], names=["a", "b", "m"])

    return lists.repartition("key").sortWithinPartitions("key", "id").mapInArrow(merge, "a long, b long, m int")


def _shared(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many keys each two of n rows have in common (x < y); keys and rows are sorted by key and row."""
    out = np.zeros((n, n), dtype=np.float32)
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)])) if len(keys) else np.zeros(1, dtype=np.int64)
    sizes = np.diff(edges)
    often = sizes > max(n // 8, 1)
    if often.any():
        held = np.repeat(often, sizes)
        has = np.zeros((n, int(often.sum())), dtype=np.float32)
        has[rows[held], np.repeat(np.arange(has.shape[1]), sizes[often])] = 1
        out += has @ has.T
    for size in np.unique(sizes[~often & (sizes > 1)]):
        members = rows[edges[:-1][~often & (sizes == size)][:, None] + np.arange(size)]
        x, y = np.triu_indices(size, 1)
        np.add.at(out, (members[:, x].ravel(), members[:, y].ravel()), 1)
    return out


def long_pairs(lists: DataFrame, hot: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) of ids that share a long list, rows (id, key) of hot, and `matches` collisions in all.

    A list is cut into blocks of about BLOCK ids, and each two blocks are compared at once. A pair comes out of the
    first of the long lists that it shares only.
    """
    sizes = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    every = hot.groupBy("id").agg(F.collect_set("key").alias("hot"))
    every = every.join(lists.join(hot.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    rows = hot.join(sizes, "key").join(every, "id").withColumn("s", F.expr("pmod(xxhash64(id), blocks)"))
    rows = rows.withColumn("t", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("key", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "id", "s", "keys", "hot")

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        column = column.combine_chunks()
        rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        keys = column.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((rows, keys))
        return keys[order], rows[order]

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        ids, s, n = table.column("id").to_numpy(), table.column("s").to_numpy(), len(table)
        keys, at = flat(table.column("hot"))
        good = np.triu(_shared(keys[keys < key], at[keys < key], n) == 0, 1)
        if i != j:
            good &= s[:, None] != s
        keys, at = flat(table.column("keys"))
        odd = keys & 1 == 1
        good &= _shared(keys[~odd], at[~odd], n) + MATCHES * _shared(keys[odd], at[odd], n) >= matches
        x, y = np.nonzero(good)
        return pa.table({"a": ids[x], "b": ids[y]})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def candidate_pairs(lists: DataFrame, matches: int = MATCHES, long: int = LONG) -> DataFrame:
    """Pairs (a, b) of classes with `matches` collisions or more; an odd key is a combination and counts MATCHES.

    Those that short lists don't show come from `long_pairs`.
    """
    counted = merge_skip(lists, long).groupBy("a", "b", F.signum("m").alias("s")).agg(F.sum("m").alias("m"))
    counted = checkpointed(counted.where(F.expr(f"s < 0 OR m >= {matches}")))
    short, hot = counted.where("s > 0").select("a", "b"), counted.where("s < 0").select(F.col("a").alias("id"), F.col("b").alias("key"))
    if hot.isEmpty():
        return short
    return short.unionByName(long_pairs(lists, hot, matches)).distinct()


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, and pairs inside a class, as ordered pairs of problem_ids."""
    same = members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    met = across(pairs.select("a", "b").unionByName(same), members, members).where("a <> b OR p < q")
    return met.select(F.least("p", "q").alias("problem_id_a"), F.greatest("p", "q").alias("problem_id_b"))


def across(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, p, q): problem_ids of the members of class a in left and of class b in right; classes of any size (see `blocks`)."""
    some = meet(pairs.select("a", "b"), left.select(F.col("id").alias("a"), F.col("problem_id").alias("p")), "a")
    return meet(some, right.select(F.col("id").alias("b"), F.col("problem_id").alias("q")), "b")


def partners(both: DataFrame, *more: int) -> DataFrame:
    """(x, z): of each x its smallest and largest y and, for each of the numbers, the two at the ends of an order by hash."""
    orders = [F.xxhash64("y", F.lit(k)) for k in more]
    chosen = [F.min("y"), F.max("y"), *(f("y", o) for o in orders for f in (F.min_by, F.max_by))]
    return both.groupBy("x").agg(F.array(*chosen).alias("z")).select("x", F.explode(F.array_distinct("z")).alias("z"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))


def group_candidates(pairs: DataFrame, sided: bool = False) -> DataFrame:
    """(a, b) not among the pairs that have a near duplicate in common: every record with those of eight of its partners.

    A pair whose signatures happen to match too little is found through its group. For a group of n records there are at most 8 * n * n
    such pairs, as many as the group itself may have. sided: pairs only lead from one side to the other, so a record goes to partners of
    its partners, which are on its own side, and takes the near duplicates of up to twelve of those.
    """
    both = checkpointed(both_ways(pairs))
    if sided:
        steps = [partners(both, 0), partners(both, 1)]
        hops = steps[0].join(steps[1].toDF("z", "w"), "z").where("x <> w").select("x", F.col("w").alias("y")).distinct()
        least = partners(hops, *range(5))
    else:
        least = partners(both, 0, 1, 2)
    joined = meet(least, both.select(F.col("x").alias("z"), "y"), "z").where("x <> y")
    found = joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return found.join(pairs.select("a", "b"), ["a", "b"], "left_anti")


def class_pairs(problems: DataFrame, at_least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of classes of equal records, and (problem_id, row, source_id, id) of their members."""
    records = problem_records(problems)
    (codes,), members = counted_members(records, [(sketch_bits(records.count()), sequences_of)])
    members = checkpointed(members)
    pairs = checkpointed(similar(records, members, candidate_pairs(postings(records, codes)), at_least))
    more = checkpointed(group_candidates(pairs))
    if not more.isEmpty():
        pairs = checkpointed(pairs.unionByName(similar(records, members, more, at_least)))
    return pairs, members


def near_duplicate_pairs(problems: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """Every pair of different problem_ids whose records have a similarity of at_least or more.

    Empty tables give no pairs; ties (a similarity of exactly at_least) count; see `records` for nulls,
    repeated deliveries and short texts.
    """
    return expand(*class_pairs(problems, at_least))


def near_duplicate_classes(problems: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """(problem_id, class_id, copies, links, group_id) of every problem that has a copy or a near duplicate.

    class_id: smallest problem_id with the same words; copies: problems with the same words, itself included; links: near duplicates with
    other words; group_id: smallest class_id that can be reached over near duplicates. One row per problem, however large its group is.
    """
    pairs, members = class_pairs(problems, at_least)
    sizes = checkpointed(members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("problem_id").alias("class_id")))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    links = both.join(sizes.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("links"))
    joined = sizes.join(links, "id", "left").where("copies > 1 OR links > 0").join(components(pairs), "id", "left")
    named = joined.select("id", "copies", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    groups = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return members.select("problem_id", "id").join(named.join(groups, "root"), "id").select("problem_id", "class_id", "copies", "links", "group_id")


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of all ids of the pairs: the smallest id that can be reached.

    Alternating stars: every id is linked to the smallest of its larger, then of its smaller neighbours, until nothing changes; the number
    of rounds grows with the logarithm of a component's size. An id with many neighbours is one row per neighbour, never a list.
    """
    edges = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = checkpointed(small)
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
