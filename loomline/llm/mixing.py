"""Mixing sources to target weights.

Method: cube-method balanced sampling. A source that needs r copies of its documents on average gives every
document floor(r) copies and one more with inclusion probability r - floor(r). The flight phase moves these
probabilities inside the null space of the balancing constraints (number of documents and number of tokens of
the source) until they are 0 or 1, so both totals stay what they should be. It streams: at any time at most
three documents of a (mix, source) are undecided, whatever the size of the source. Documents fly in shards by a
hash of doc_id, in order of doc_id, so the sample does not depend on how the table is partitioned. Each shard
leaves at most two of them; these few rows fly again together, and a landing decides the last.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed
from .tokens import RANKS, clean, document_tokens

#: Targets are configuration; a table of more rows is refused, as it is sent to every task.
MOST_TARGETS = 100_000
_EPS = 1e-9
#: Documents per shard, about; what moves to make shards are (doc_id, source, tokens).
SHARD = 20_000


@dataclass(frozen=True)
class Target:
    mix: str
    source: str
    copies: int
    chance: float


def mixing_plan(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, documents, available, quota, repeats) per target.

    The total of a mix is the largest at which no source needs more than max_repeats. A target without
    tokens can't be met; the shares of the others are scaled to sum to 1. Targets with a null or
    non-positive share or repeat ask for nothing. Repeated targets of a source are added up.
    """
    wanted = targets.where("mix_name IS NOT NULL AND source IS NOT NULL").select("mix_name", clean("source").alias("source"), "target_share", "max_repeats")
    wanted = wanted.groupBy("mix_name", "source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats")
    )
    have = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    rows = wanted.join(have, "source", "left").fillna(0, ["documents", "available"])
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    total = rows.groupBy("mix_name").agg(
        F.sum(F.when(usable, F.col("target_share"))).alias("shares"), F.min(F.when(usable, F.col("max_repeats") * F.col("available") / F.col("target_share"))).alias("total")
    )
    quota = F.when(usable, F.col("target_share") * F.col("total")).otherwise(0.0)
    rows = rows.join(total, "mix_name").withColumn("quota", quota)
    return rows.select(
        "mix_name", "source", "target_share", "max_repeats", "documents", "available", "quota", F.coalesce(F.try_divide("quota", "available"), F.lit(0.0)).alias("repeats")
    )


class Flight:
    """The flight phase of one (mix, source): holds at most two undecided units between calls."""

    def __init__(self, seed: str) -> None:
        self.rng = random.Random(seed)
        self.units: list[list] = []

    def add(self, key: object, size: float, chance: float) -> list[tuple[object, float, float]]:
        """Decided units (key, size, 0.0 or 1.0) after a unit has joined."""
        self.units.append([key, size, chance])
        return self._move() if len(self.units) == 3 else []

    def _move(self) -> list[tuple[object, float, float]]:
        (_, a, p), (_, b, q), (_, c, r) = self.units
        u = (b - c, c - a, a - b)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for x, d in zip((p, q, r), u):
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, x / -d), min(down, (1 - x) / -d)
        step = up if up + down <= 0 or self.rng.random() * (up + down) < down else -down
        done, left = [], []
        for unit, d in zip(self.units, u):
            unit[2] += step * d
            if unit[2] < _EPS or unit[2] > 1 - _EPS:
                done.append((unit[0], unit[1], float(unit[2] > 0.5)))
            else:
                left.append(unit)
        if not done:  # rounding: settle the unit nearest to a bound
            nearest = min(left, key=lambda x: min(x[2], 1 - x[2]))
            left.remove(nearest)
            done.append((nearest[0], nearest[1], float(nearest[2] > 0.5)))
        self.units = left
        return done

    def land(self) -> list[tuple[object, float, float]]:
        """Decide what is left: one constraint after the other is given up, tokens last."""
        done = []
        if len(self.units) == 2:
            (k, a, p), (m, b, q) = self.units
            wanted = p * a + q * b
            best = min(((x, y) for x in (0, 1) for y in (0, 1)), key=lambda s: (abs(s[0] * a + s[1] * b - wanted), s))
            done = [(k, a, float(best[0])), (m, b, float(best[1]))]
        elif self.units:
            k, a, p = self.units[0]
            done = [(k, a, float(self.rng.random() < p))]
        self.units = []
        return done


_NAMES = ["mix_name", "source", "doc_id", "tokens", "copies", "chance"]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
_SCHEMA = "mix_name string, source string, doc_id long, tokens long, copies long, chance double"


def _emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), _TYPES)], names=_NAMES)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan): chosen (mix_name, source, doc_id, tokens, copies) with copies >= 1; plan of mixing_plan.

    Documents with a null id, text or source name, or without a token, take no part. Empty tables give an
    empty mix. Rows of equal text are documents of their own.
    """
    if targets.count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} mixing targets")
    tokens = checkpointed(document_tokens(documents, ranks).where("tokens > 0"))
    plan = checkpointed(mixing_plan(tokens, targets))
    wanted: dict[str, list[Target]] = {}
    for row in plan.where("repeats > 0").collect():
        copies = int(row.repeats + _EPS)
        wanted.setdefault(row.source, []).append(Target(row.mix_name, row.source, copies, max(row.repeats - copies, 0.0)))
    sent = documents.sparkSession.sparkContext.broadcast(wanted)

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flights: dict[tuple, Flight] = {}
        base: dict[tuple, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for shard, doc, source, size in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "source", "tokens"))):
                for t in sent.value.get(source, ()):
                    if t.chance < _EPS:
                        if t.copies:
                            out.append((t.mix, source, doc, size, t.copies, 0.0))
                        continue
                    key = (t.mix, source, shard)
                    flight = flights.get(key)
                    if flight is None:
                        flight, base[key] = flights.setdefault(key, Flight(f"{seed}|{t.mix}|{source}|{shard}")), t.copies
                    out.extend((t.mix, source, d, s, t.copies + int(x), 0.0) for d, s, x in flight.add(doc, size, t.chance) if t.copies + x)
            yield from _emit(out)
        rest = [(m, s, d, size, base[m, s, shard], chance) for (m, s, shard), f in flights.items() for d, size, chance in f.units]
        yield from _emit(rest)

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flights: dict[tuple, tuple[Flight, int]] = {}
        for batch in batches:
            out: list[tuple] = []
            for m, s, d, size, copies, chance in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                if (m, s) not in flights:
                    flights[m, s] = Flight(f"{seed}|{m}|{s}"), copies
                out.extend((m, s, k, n, copies + int(x), 0.0) for k, n, x in flights[m, s][0].add(d, size, chance) if copies + x)
            yield from _emit(out)
        for (m, s), (flight, copies) in flights.items():
            yield from _emit([(m, s, k, n, copies + int(x), 0.0) for k, n, x in flight.land() if copies + x])

    shards = max(1, math.ceil(tokens.count() / SHARD))
    placed = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "doc_id", "source", "tokens")
    flown = checkpointed(placed.mapInArrow(fly, _SCHEMA))
    rest = flown.where("chance > 0").repartition("mix_name", "source").sortWithinPartitions("mix_name", "source", "doc_id", "tokens")
    chosen = flown.where("chance = 0").unionByName(rest.mapInArrow(land, _SCHEMA)).drop("chance")
    return chosen, plan


def mixing_report(documents: DataFrame, targets: DataFrame, seed: int = 7, ranks: str = RANKS) -> DataFrame:
    """Per target: its share, what the source has, copies and tokens taken, and the share of the mix reached."""
    chosen, plan = mix(documents, targets, seed, ranks)
    taken = chosen.groupBy("mix_name", "source").agg(
        F.count(F.lit(1)).alias("documents_taken"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens")
    )
    total = taken.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    rows = plan.join(taken, ["mix_name", "source"], "left").join(total, "mix_name", "left").fillna(0, ["documents_taken", "copies", "most_repeats", "tokens", "mix_tokens"])
    share = F.coalesce(F.try_divide("tokens", "mix_tokens"), F.lit(0.0)).alias("share_reached")
    return rows.select("mix_name", "source", "target_share", "max_repeats", "documents", "available", "documents_taken", "copies", "most_repeats", "tokens", share)
