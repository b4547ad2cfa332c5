import os
import random

import pytest

from loomline.llm import layout_copies, mixing, queries, tokens
from tests.llm.tables import DOCUMENTS, REASONING, problem, problems, sentence

TARGETS = "mix_name string, source string, target_share double, max_repeats int, tokens long"
needs_ranks = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no rank file")


@pytest.mark.parametrize(
    "a, b, same",
    [
        ('{"n": 1, "nums": [2, 3]}', "nums: 2 3\nn=1", True), ("3\n1 2\n", "3 1  2", True), ("3, 4", "[3]\n[4]", True), ("-5", "5", False), ("1.5", "15", False), ("1.5", "1 5", False), ("12 3", "1 23", False),
        ("YES", "yes!", True), ("1 2", "2 1", False), ("{'a': 'x', 'b': -2}", '{"B": -2, "A": "X"}', True), ("(17)", "17", True), ("a: 1; b: 2", "b=2, a=1", True), ("5.", "5", True),
        ('{"a": {"y": 1, "x": 2}}', '{"a": {"x": 2, "y": 1}}', True), ('{"a": {"x": 1}, "b": 2}', '{"a": {"x": 2}, "b": 1}', False), (None, "", True), ("a b", "ab", False), ("x-5", "x 5", False),
    ],
)
def test_layout(a, b, same):
    assert (layout_copies.canonical_layout(a) == layout_copies.canonical_layout(b)) is same


def case(i, a, b):
    return (i, a, b)


def test_layout_copies(spark):
    tests = [case("c2", "1 2", "YES"), case("c1", "1\n2\n", "yes"), case("c3", "1 2", "no"), case("c4", None, None), case("c5", "", ""), case(None, "1 2", "YES"), case("c1", "1\n2\n", "yes")]
    rows = [problem(1, "a", tests=tests), problem(2, "a", tests=tests), problem(3, "b", tests=[]), problem(4, "c", tests=None), problem(5, None, tests=tests), problem(6, "d", tests=[None, case("x", "9 " * 100_000, "1"), case("w", "9  " * 100_000, "1")])]
    df = problems(spark, rows)
    assert sorted(tuple(r) for r in layout_copies.layout_copies(df).collect()) == [("a", "c1", "c2"), ("a", "c4", "c5"), ("d", "w", "x")]
    assert sorted(tuple(r) for r in layout_copies.collapse(df).collect()) == [("a", "c1", 2), ("a", "c3", 1), ("a", "c4", 2), ("d", "w", 2)]
    twice = problems(spark, [problem(1, "a", tests=[case("t", "1", "x"), case("u", "2", "x")]), problem(2, "a", tests=[case("t", "2", "x")])])
    assert sorted(tuple(r) for r in layout_copies.collapse(twice).collect()) == [("a", "t", 1), ("a", "t", 2)]
    assert layout_copies.layout_copies(problems(spark, [])).count() == 0


def test_layout_copies_of_a_hot_problem(spark):
    """Rows of one problem in many tasks still give one run per test case."""
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(400):
        values = [rng.randrange(5) for _ in range(2)]
        rows.append(problem(k, "hot", tests=[case(f"t{k:03d}", rng.choice([" ", "\n", ", "]).join(map(str, values)), "x")]))
        want.setdefault(tuple(values), []).append(f"t{k:03d}")
    df = problems(spark, rows).repartition(7)
    found = {tuple(r) for r in layout_copies.layout_copies(df).collect()}
    assert found == {("hot", min(g), t) for g in want.values() for t in g if t != min(g)}


def test_a_run_may_span_partitions(spark):
    """A test case that holds a third of all rows is spread over partitions and still has one representative and an exact count."""
    rng = random.Random(3)
    rows = [problem(k, f"p{k % 50}" if k % 3 else "hot", tests=[case(f"t{k:05d}", "1 2" if k % 3 == 0 else str(rng.randrange(4)), "x")]) for k in range(3000)]
    df = problems(spark, rows).repartition(5)
    hot = sorted(r[9][0][0] for r in rows if r[1] == "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {tuple(r) for r in layout_copies.layout_copies(df).where("problem_id = 'hot'").collect()} == {("hot", hot[0], t) for t in hot[1:]}
        collapsed = [tuple(r) for r in layout_copies.collapse(df).collect()]
        assert ("hot", hot[0], len(hot)) in collapsed and sum(r[2] for r in collapsed) == 3000
        parts = layout_copies.sorted_runs(layout_copies.canonical_cases(df)).where("problem_id = 'hot'").selectExpr("spark_partition_id() AS p").distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_layout_copies_equal_brute_force_on_a_whole_table(spark, small):
    groups = {}
    for r in spark.read.parquet(f"{small}/problems.parquet").collect():
        for t in r.tests or []:
            groups.setdefault((r.problem_id, layout_copies.canonical_layout(t.input), layout_copies.canonical_layout(t.output)), set()).add(t.test_id)
    want = {(k[0], min(g), t) for k, g in groups.items() for t in g if t != min(g)}
    assert {tuple(r) for r in queries.p6_found(spark, small).collect()} == want


def document(i, text, source="forum"):
    return (i, text, "en", source, "f", "r", 1, 1, "c")


def answer(i, text, source="s", source_id="train:1"):
    return (i, None, source, source_id, text, "p", True, 0.5, "t")


@needs_ranks
def test_token_cube(spark):
    p = problems(spark, [problem(1, "a", "train:1", "one two three", lang="EN"), problem(2, "a", "train:1", "one two three", lang="EN"), problem(3, "b", "train:2", None), problem(4, "c", "train:3", "<|endoftext|> x", lang="en-XX", topic=None), problem(5, None, "train:4", "lost")])
    r = spark.createDataFrame([answer(1, "alpha beta"), answer(2, "alpha beta"), answer(3, None), answer(4, "gamma", "zz", "q"), answer(5, "word " * 100_000, None, None)], REASONING)
    cube = {(x.field, x.source, x.language, x.topic): (x.texts, x.tokens, x.unique_tokens) for x in tokens.token_cube(p, r).collect()}
    n = lambda t: tokens.count_tokens([t])[0]
    assert cube["prompt", "s", "en", "dp"] == (1, n("one two three"), n("one two three"))
    assert cube["prompt", "s", "en", "unknown"] == (1, n("<|endoftext|> x"), n("<|endoftext|> x"))
    assert cube["reasoning", "s", "en", "dp"] == (2, 2 * n("alpha beta"), n("alpha beta"))
    assert cube["reasoning", "zz", "unknown", "unknown"] == (1, n("gamma"), n("gamma"))
    assert cube["reasoning", "unknown", "unknown", "unknown"][0] == 1
    assert tokens.token_cube(problems(spark, []), spark.createDataFrame([], REASONING)).count() == 0


@needs_ranks
def test_counts_and_cubes_follow_changes(spark):
    """Only unseen contents are encoded; deltas of changed, moved, new and removed documents give the full recount."""
    schema = "key string, source string, text string"
    before = spark.createDataFrame([("a", "x", "one two"), ("b", "x", "three"), ("c", "y", "four five six"), ("d", "y", "one two"), ("e", None, None)], schema)
    after = spark.createDataFrame([("a", "x", "one two changed"), ("b", "z", "three"), ("d", "y", "one two"), ("f", "x", "new text here"), ("g", "x", "")], schema)
    counts = tokens.update_counts(None, before)
    old = {bytes(r.content) for r in counts.collect()}
    updated = tokens.update_counts(counts, after)
    rows = updated.collect()
    assert len(rows) == len({bytes(r.content) for r in rows}) and old < {bytes(r.content) for r in rows}
    snap = lambda df: tokens.contents(df.where("text IS NOT NULL"))
    held = tokens.apply_delta(None, tokens.slice_delta(None, snap(before), ["source"]), ["source"])
    held = tokens.apply_delta(held, tokens.slice_delta(snap(before), snap(after), ["source"]), ["source"])
    full = tokens.apply_delta(None, tokens.slice_delta(None, snap(after), ["source"]), ["source"])
    assert sorted(map(tuple, held.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)
    found = {r.source: (r.texts, r.tokens, r.unique_tokens) for r in tokens.cube(held, updated, ["source"]).collect()}
    n = lambda *texts: sum(tokens.count_tokens(list(texts)))
    assert found == {"x": (3, n("one two changed", "new text here"), n("one two changed", "new text here")), "y": (1, n("one two"), n("one two")), "z": (1, n("three"), n("three"))}


@needs_ranks
def test_budget_after_two_snapshots_equals_the_recount(spark, small):
    """The maintained cube equals the recount, and the second snapshot encodes no content that the count table has."""
    rows = queries.p3_update(spark, small).collect()
    assert rows and all(r.texts == r.recounted_texts and r.tokens == r.recounted_tokens for r in rows)
    p = problems(spark, [problem(1, "a", "train:1", "one two three"), problem(2, "b", "train:2", "gone soon")])
    r = spark.createDataFrame([answer(1, "alpha beta"), answer(2, "alpha beta"), answer(None, "no id")], REASONING)
    budget = tokens.TokenBudget.first(p, r)
    q = problems(spark, [problem(1, "a", "train:1", "one two three", topic="graphs"), problem(3, "c", "train:3", "alpha beta")])
    later = budget.then(q, r.where("reasoning_id = 1"))
    assert sorted(map(tuple, later.cube().collect())) == sorted(map(tuple, tokens.token_cube(q, r.where("reasoning_id = 1")).collect()))
    assert later.counts.count() == budget.counts.count()
    empty = later.then(problems(spark, []), spark.createDataFrame([], REASONING))
    assert empty.cube().count() == 0


@needs_ranks
def test_mix_reaches_shares(spark):
    rng = random.Random(4)
    rows = [document(k, sentence(rng, rng.randrange(5, 60)), rng.choice(["big", "big", "BIG ", "mid", "small"])) for k in range(900)]
    rows += [document(None, "no id"), document(901, None, "mid"), document(902, "", "mid"), document(903, "orphan text", None), document(904, sentence(rng, 20_000), "big")]
    targets = [("m", "big", 0.5, 1, 1), ("m", "mid", 0.3, 2, 1), ("m", "small", 0.2, 3, 1), ("n", "mid", 0.7, 1, 1), ("n", "absent", 0.3, 4, 1), ("o", "small", None, 1, 1), (None, "small", 1.0, 1, 1), ("q", "small", 1.0, None, 1)]
    docs, wanted = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(targets, TARGETS)
    chosen, plan = mixing.mix(docs, wanted)
    taken = chosen.collect()
    assert len(taken) == len({(r.mix_name, r.doc_id) for r in taken})
    limits = {(m, s): r for m, s, _, r, _ in targets}
    assert all(1 <= r.copies <= limits[r.mix_name, r.source] for r in taken)
    assert {r.mix_name for r in taken} == {"m", "n"}
    report = {(r.mix_name, r.source): r for r in mixing.mixing_report(docs, wanted).collect()}
    largest = max(r.tokens for r in taken)
    for s in ("big", "mid", "small"):
        row = report["m", s]
        total = sum(report["m", x].tokens for x in ("big", "mid", "small"))
        assert abs(row.tokens - row.target_share * total) <= 3 * largest
    assert report["n", "mid"].share_reached == 1.0 and report["n", "absent"].tokens == 0
    again, _ = mixing.mix(docs.repartition(7), wanted)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, taken))
    assert mixing.mix(spark.createDataFrame([], DOCUMENTS), wanted)[0].count() == 0
    assert mixing.mix(docs, spark.createDataFrame([], TARGETS))[0].count() == 0


def test_flight_keeps_totals_and_expectations():
    rng = random.Random(11)
    sizes = [rng.randrange(1, 400) for _ in range(60)]
    hits = [0.0] * len(sizes)
    for seed in range(400):
        flight, done = mixing.Flight(str(seed)), []
        for k, s in enumerate(sizes):
            done += flight.add(k, s, 0.35)
        left = [(u[1], u[2]) for u in flight.units]
        assert len(left) <= 2
        count = sum(x for _, _, x in done) + sum(p for _, p in left)
        total = sum(s * x for _, s, x in done) + sum(s * p for s, p in left)
        assert abs(count - 0.35 * len(sizes)) < 1e-6 and abs(total - 0.35 * sum(sizes)) < 1e-4
        for k, _, x in done + flight.land():
            hits[k] += x / 400
    assert all(abs(h - 0.35) < 0.12 for h in hits)
