"""Duplicates hidden by formatting: test cases of a problem that differ in layout only.

Method: canonical records are range-partitioned and externally sorted by full key and test_id; each partition then
scans its rows in order, compares neighbours' full keys and emits one representative and the exact number of copies
per run.

The scan streams: it holds one row, whatever the length of a run. A range may begin inside a run, so a problem_id or
test case that holds a third of all rows is spread over many partitions; each partition also emits one row that tells
how it begins and ends, from which the representative of a run that began earlier is carried over. Repeated rows are
merged inside a row's own array and inside an Arrow batch before the sort.

The canonical form of a text keeps values in their order: numbers with minus sign and decimal point, and
words in lower case. Punctuation and blank space only separate values. Named fields (name: values,
name = values, or the members of an object) are ordered by name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed

#: A value: a number, or a run of letters, digits and underscores.
_VALUE = r"[-−]?(?:\d+\.\d+|\.\d+|\d+)(?![^\W\d])|\w+"
_TOKEN = re.compile(_VALUE)
_FIELD = re.compile(r"""(?:(?<=[\s{,;\[("'])|^)["']?([^\W\d]\w*)["']?[ \t\r\n]*[:=](?![:=])""")
_NESTED = re.compile(r"[{].*[{]", re.S)
#: Separates fields of a key; no value contains it.
_GAP = "\x1f"


def _values(text: str) -> str:
    return " ".join(_TOKEN.findall(text)).replace("−", "-")


def _tree(value: object) -> str:
    if isinstance(value, dict):
        return "{" + _GAP.join(sorted(f"{_values(k.casefold())}={_tree(v)}" for k, v in value.items())) + "}"
    if isinstance(value, list):
        return " ".join(map(_tree, value))
    return _values(json.dumps(value, ensure_ascii=False).casefold() if not isinstance(value, str) else value.casefold())


def canonical_layout(text: str | None) -> str:
    """Texts that differ in layout only have one canonical layout; null reads as empty."""
    if not text:
        return ""
    text = text.casefold()
    if ":" not in text and "=" not in text:
        return _values(text)
    if _NESTED.search(text):
        try:
            return _tree(json.loads(text))
        except (ValueError, RecursionError):
            pass
    fields, end = [], 0
    head = None
    for m in _FIELD.finditer(text):
        part = _values(text[end : m.start()])
        if head is None:
            head = part
        else:
            fields.append(f"{name}={part}")
        name, end = m.group(1), m.end()
    if head is None:
        return _values(text)
    fields.append(f"{name}={_values(text[end:])}")
    return head + "{" + _GAP.join(sorted(fields)) + "}"


_CASE = pa.schema([("problem_id", pa.string()), ("input", pa.string()), ("output", pa.string()), ("test_id", pa.string())])
_KEY = ["problem_id", "input", "output", "test_id"]
#: What a scan emits: a copy (n is null), a finished run (copy is null), or how a partition begins and ends (kind 'edge').
_SCAN = pa.schema(
    [("part", pa.int32()), ("kind", pa.string()), ("first", pa.bool_()), ("problem_id", pa.string()), ("kept", pa.string()), ("copy", pa.string()), ("n", pa.int64())]
    + [("begins", pa.binary()), ("ends", pa.binary())]
)
_SCAN_SQL = "part int, kind string, first boolean, problem_id string, kept string, copy string, n long, begins binary, ends binary"


def _rows(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def canonical_cases(problems: DataFrame) -> DataFrame:
    """(problem_id, input, output, test_id): canonical test cases, each once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, None] = {}
            for pid, tests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in tests or ():
                    if t is not None and t["test_id"] is not None:
                        found[pid, canonical_layout(t["input"]), canonical_layout(t["output"]), t["test_id"]] = None
            yield from _rows(found, _CASE)

    rows = problems.where("problem_id IS NOT NULL AND tests IS NOT NULL").select("problem_id", "tests")
    return rows.mapInArrow(run, "problem_id string, input string, output string, test_id string")


def sorted_runs(cases: DataFrame) -> DataFrame:
    """Cases range-partitioned and sorted by full key and test_id, so equal rows are neighbours and a long run may span partitions.

    They are checkpointed first, as the bounds of the ranges are sampled from them before they are shuffled.
    """
    return checkpointed(cases).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)


def _digest(key: tuple) -> bytes:
    return xxhash.xxh3_128_digest("\x1e".join(key).encode("utf-8", "surrogatepass"))


def scan_runs(part: int, rows: Iterable[tuple[str, str, str, str]]) -> Iterator[tuple]:
    """Rows of _SCAN of one partition's sorted (problem_id, input, output, test_id).

    The rows of the partition's first run are marked `first`, and its first test_id comes out as a copy of itself: should the run have
    begun in an earlier partition, all of them are copies of that run's representative.
    """
    key, kept, last, n, first, begins, head = None, "", None, 0, True, b"", ""
    for *now, test in rows:
        if tuple(now) != key:
            if key is not None:
                yield part, "run", first, key[0], kept, None, n, _digest(key), None
                first = False
            key, kept, last, n = tuple(now), test, test, 1
            if first:
                begins, head = _digest(key), test
                yield part, "copy", True, key[0], kept, test, None, None, None
        elif test != last:
            last, n = test, n + 1
            yield part, "copy", first, key[0], kept, test, None, None, None
    if key is not None:
        yield part, "run", first, key[0], kept, None, n, _digest(key), None
        yield part, "edge", first, key[0], head, kept, None, begins, _digest(key)


def carried(edges: Iterable) -> list[tuple[int, str]]:
    """(part, representative) of the partitions that begin inside a run of an earlier one. There is one edge row per partition."""
    out, before, kept = [], None, ""
    for e in sorted(edges, key=lambda e: e.part):
        inherited = kept if e.begins == before else None
        if inherited is not None:
            out.append((e.part, inherited))
        before, kept = e.ends, inherited if e.first and inherited is not None else e.copy
    return out


def scanned(problems: DataFrame) -> DataFrame:
    """(kind, problem_id, kept, copy, n, begins) of copies and parts of runs, one part per partition that a run spans.

    kept is the representative of the whole run, begins a digest of its key in rows of parts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        yield from _rows(scan_runs(TaskContext.get().partitionId(), rows), _SCAN)

    rows = checkpointed(sorted_runs(canonical_cases(problems)).mapInArrow(scan, _SCAN_SQL))
    from_before = carried(rows.where("kind = 'edge'").collect())  # one row per partition
    told = rows.where("kind <> 'edge'")
    if not from_before:
        return told.select("kind", "problem_id", "kept", "copy", "n", "begins").where("copy IS NULL OR copy <> kept")
    carry = problems.sparkSession.createDataFrame(from_before, "part int, _kept string")
    whole = F.when(F.col("first"), F.coalesce("_kept", "kept")).otherwise(F.col("kept"))
    return told.join(carry, "part", "left").select("kind", "problem_id", whole.alias("kept"), "copy", "n", "begins").where("copy IS NULL OR copy <> kept")


def collapse(problems: DataFrame) -> DataFrame:
    """(problem_id, kept_test_id, copies): one row per distinct test case and its exact number of copies.

    A test_id that is delivered again for the same case counts once. Nulls: a null input or output reads as
    empty; a test case without test_id or a problem without problem_id is left out. Of ties the smallest
    test_id is kept. Empty tables and problems without test cases give no row. If a test_id stands for several cases of a problem,
    each of them has a row.
    """
    runs = scanned(problems).where("kind = 'run'")
    return runs.groupBy("problem_id", "kept", "begins").agg(F.sum("n").alias("copies")).select("problem_id", F.col("kept").alias("kept_test_id"), "copies")


def layout_copies(problems: DataFrame) -> DataFrame:
    """(problem_id, kept_test_id, copy_test_id): one row for each test case that is a copy; see `collapse`."""
    copies = scanned(problems).where("kind = 'copy'")
    return copies.select("problem_id", F.col("kept").alias("kept_test_id"), F.col("copy").alias("copy_test_id"))
