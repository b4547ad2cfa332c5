import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import gates, joins, overlap, preferences, qualify, rollouts, sequences, splits, validate
from loomline.sources import files, jsonl, ordinal

PROBLEM = "pos long, problem_id string, source string, source_id string, difficulty string, prompt string, reference_code string, tests array<struct<test_id:string,input:string,output:string>>"
REASONING = "reasoning_id long, problem_id string, source string, source_id string, reasoning string"
T = [("t", "1\n", "2\n")]


def stable_hash(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def problem(pos, source_id, prompt="p", tests=T, pid=None):
    return (pos, pid or f"s:{source_id}", "s", source_id, "easy", prompt, "code", tests)


def test_exact_join_reasons(spark):
    p = spark.createDataFrame([problem(k, str(k)) for k in range(1, 6)] + [problem(6, "6", tests=[]), problem(7, "1")], PROBLEM)
    r = spark.createDataFrame([(1, "s:1", None, None, "a"), (2, None, "s", "2", "b"), (3, "s:3", None, None, "c"), (4, "s:3", None, None, "d"), (5, "s:4", None, None, "e"), (6, None, "s", "4", "f"), (7, None, "s", "4", "g")], REASONING)
    got = {x.pos: (x.reject_reason, x.mapping_key, x.reasoning) for x in joins.exact_join(p, r).collect()}
    assert got[1] == (None, "problem_id", "a") == got[7] and got[2] == (None, "source/source_id", "b")
    assert [got[k][0] for k in (3, 4, 5, 6)] == ["ambiguous", "ambiguous", "no_reasoning", "invalid_problem"]
    bad = spark.createDataFrame([(1, None, "s", None, "a")], REASONING)
    with pytest.raises(Exception, match="invalid reasoning"):
        joins.exact_join(p, bad).collect()


def test_first_accepted_equals_the_loop(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("abcd"), rng.random() < 0.4) for k in range(200)]
    seen, want = set(), {}
    for k, key, ok in rows:
        want[k] = "duplicate_problem" if key in seen else None if ok else "rejected"
        if want[k] is None:
            seen.add(key)
    df = spark.createDataFrame(rows, "pos long, key string, ok boolean").repartition(5)
    got = joins.first_accepted(df, ["key"], "pos", F.col("ok"), F.when(~F.col("ok"), "rejected"))
    assert {r.pos: r.reject_reason for r in got.collect()} == want


def test_assemble(spark):
    c = spark.createDataFrame([(1, "s:train:1", "s", "train", 1, "r", " print(1) "), (2, "s:train:2", "s", "train", 2, "r", ""), (3, "s:train:3", "s", "train", 3, "r", None), (4, "s:train:1", "s", "train", 1, "r", "x")], "pos long, problem_id string, dataset string, source_split string, index long, reasoning string, solution string")
    c = c.withColumn("source_id", F.concat_ws(":", "source_split", "index"))
    s = spark.createDataFrame([("s", "train", 1, "train", "train:1", "p", "own", T), ("s", "train", 2, "test", "test:2", "p", "own", T)], "dataset string, source_split string, index long, src_source_split string, src_source_id string, prompt string, reference_code string, tests array<struct<test_id:string,input:string,output:string>>")
    got = {r.pos: (r.reject_reason, r.reference_code) for r in joins.assemble(c, s).collect()}
    assert got[1] == (None, "print(1)") and [got[k][0] for k in (2, 3, 4)] == ["source_split_mismatch", "missing_source_problem", "duplicate_problem"]


@pytest.mark.parametrize("n, want", [(10, (6, 3, 1)), (7087, (4252, 2126, 709)), (1, (1, 0, 0)), (2, (1, 1, 0)), (5, (3, 2, 0)), (0, (0, 0, 0))])
def test_split_counts(n, want):
    assert tuple(splits.split_counts(n, {"sft": 0.6, "pt": 0.3, "dev": 0.1}).values()) == want


def test_split_targets_and_order(spark):
    rows = [problem(k, str(k)) for k in range(60)]
    df = spark.createDataFrame(rows, PROBLEM).repartition(3)
    got = {r.problem_id: r.split for r in splits.assign_splits(df, 5, {"sft": 0.6, "pt": 0.3, "dev": 0.1}, {"sft": 20, "pt": 15, "dev": 5}).collect()}
    order = sorted((r[1] for r in rows), key=lambda p: stable_hash({"problem_id": p, "seed": 5}))
    assert got == {p: "sft" if k < 20 else "pt" if k < 35 else "dev" for k, p in enumerate(order[:40])}
    assert [r.problem_id for r in splits.hash_sample(df, 5, 7).collect()] == order[:7]


def test_reward_heldout_equals_python(spark):
    rng = random.Random(4)
    rows = [problem(k, str(k), tests=[(None if rng.random() < 0.3 else f" t{i} ", str(rng.randrange(9)), "o") for i in range(rng.randrange(1, 25))]) for k in range(40)]
    got = {r.problem_id: r for r in splits.reward_heldout(spark.createDataFrame(rows, PROBLEM), 3, 0.7, 2).collect()}
    for r in rows:
        seen, tests = set(), []
        for i, (t, a, b) in enumerate(r[7]):
            fp = stable_hash({"input": a, "output": b})
            if fp not in seen:
                seen.add(fp)
                tests.append((t.strip() if t and t.strip() else f"case_{i:04d}_{fp[:10]}", a, b))
        tests.sort(key=lambda t: stable_hash({"seed": 3, "problem_id": r[1], "test_id": t[0], "input": t[1], "output": t[2]}))
        found = got[r[1]]
        if len(tests) < 2:
            assert found.reward_tests is None
            continue
        cut = min(max(1, round(len(tests) * 0.7)), len(tests) - 1)
        assert [t.test_id for t in found.reward_tests] == [t[0] for t in tests[:cut]]
        assert [t.test_id for t in found.heldout_tests] == [t[0] for t in tests[cut:]]


def test_until_target(spark):
    df = spark.createDataFrame([(k, k % 3 == 0) for k in range(30)], "pos long, ok boolean")
    assert splits.until_target(df, "pos", F.col("ok"), 4).agg(F.max("pos")).first()[0] == 9
    assert splits.until_target(df, "pos", F.col("ok"), 99).count() == 30


def test_near_pairs_equal_brute_force_and_blocking_clears_overlap(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:k] + ["zz"] + b[k:]) for b in base for k in (5, 58)] + ["é", "ü", "a b"]
    rows = [problem(k, str(k), t) for k, t in enumerate(texts)]
    df = overlap.shingled(spark.createDataFrame(rows, PROBLEM), 5)
    left, right = df.where("cast(split(problem_id, ':')[1] as int) % 2 = 0"), df.where("cast(split(problem_id, ':')[1] as int) % 2 = 1")

    def grams(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {t} if t.isascii() else set()

    want = set()
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            a, b = grams(x), grams(y)
            if i % 2 == 0 and j % 2 == 1 and a and b and len(a & b) / len(a | b) >= 0.8:
                want.add((f"s:{i}", f"s:{j}"))
    assert {(r.left_id, r.right_id) for r in overlap.near_pairs(left, right, 0.8).collect()} == want
    assert want
    gone = overlap.blocked(left, right, 0.8)
    counts = overlap.overlap_counts(left, right.join(gone, "problem_id", "left_anti"), 0.8, "x")
    assert gates.overlap_gate(counts).first().passed
    assert sorted((r.side, r.problem_id) for r in overlap.exact_overlap(df.where("problem_id = 's:36'"), df.where("problem_id = 's:37'")).collect()) == [("left", "s:36"), ("right", "s:37")]


def test_manifest_diff_finds_tampering(spark):
    a = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("c", "z", 1)], "problem_id string, f string, o int")
    b = spark.createDataFrame([("a", "x", 1), ("b", "n", 1), ("d", "z", 1), ("a", "x", 2)], "problem_id string, f string, o int")
    assert sorted(map(tuple, joins.manifest_diff(a, b, ["f"], "o").collect())) == [("a", "duplicate"), ("b", "f"), ("c", "missing"), ("d", "extra")]


ATTEMPTS = "attempts array<struct<attempt_index:int,status:string,pass_rate:double,first_failure:string>>, k int"


def test_best_attempt_and_suspicion(spark):
    rows = [([(1, "WA", 0.96, "t1"), (2, "WA", 0.5, "t1")], 0), ([(1, "WA", 0.5, "t1"), (2, "AC", 1.0, None)], 1), ([(1, "RE", 0.0, "t"), (2, "WA", 0.5, "u"), (3, "WA", 0.5, "v")], 2), ([], 3), (None, 4)]
    got = {r.k: r for r in spark.createDataFrame(rows, ATTEMPTS).select("k", qualify.best_attempt(F.col("attempts")).alias("b"), qualify.suspected_test_issue(F.col("attempts")).alias("s")).collect()}
    assert [got[k].b.attempt_index if got[k].b else None for k in range(5)] == [1, 2, 2, None, None]
    assert [got[k].s for k in range(5)] == [True, False, False, False, False]


def test_override_needs_every_rerun(spark):
    schema = "problem_id string, verifier_status string, response_token_count long"
    old, new = spark.createDataFrame([("a", "WA", 2048), ("b", "AC", 5)], schema), spark.createDataFrame([("a", "AC", 4000), ("b", "WA", 1)], schema)
    got = {r.problem_id: r.verifier_status for r in rollouts.override(old, new, 2048, ["verifier_status", "response_token_count"]).collect()}
    assert got == {"a": "AC", "b": "AC"}
    with pytest.raises(Exception, match="no rerun"):
        rollouts.override(old, new.where("problem_id = 'b'"), 2048, ["verifier_status"]).collect()


def test_ordered_hash_does_not_depend_on_partitions(spark):
    df = spark.range(10_000).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    a, b = (rollouts.ordered_hash(df.repartition(n), "id", F.col("h")).first() for n in (2, 9))
    assert a == b and a.rows == 10_000
    assert rollouts.ordered_hash(df.where("id <> 7"), "id", F.col("h")).first().dataset_hash != a.dataset_hash


def test_preferences(spark):
    rows = [(1, "p", "AC", 4, 4, 10), (2, "p", "WA", 3, 4, 12), (3, "p", "WA", 2, 4, 9), (4, "p", "WA", 0, 4, 30), (5, "p", "TLE", 0, 4, 10), (6, "q", "AC", 2, 2, 5)]
    df = spark.createDataFrame(rows, "rollout_id long, problem_id string, verifier_status string, reward_passed long, reward_total long, response_token_count long")
    pairs = preferences.preference_pairs(df)
    assert sorted((r.chosen_id, r.rejected_id, r.kind, r.margin) for r in pairs.collect()) == [(1, 3, "hard", 0.5), (1, 4, "easy", 1.0)]
    assert preferences.matched_triples(pairs).count() == 1
    assert preferences.length_matched(pairs, df, 8).count() == 1


TOK = sequences.CharTokenizer()
CODE = "print(1)\n"


def build(version, response, longest=200, budget=100, code=CODE):
    return sequences.VERSIONS[version](TOK, "Q", response, code, longest, budget)


def test_sequence_v2_keeps_structure_and_supervises_the_end():
    whole = build(2, "<think>abc</think>\n```python\nprint(1)\n```")
    assert whole["full_fit"] and whole["labels"][-1] == TOK.eos_id and whole["labels"][0] == sequences.IGNORED
    cut = build(2, "<think>" + "r" * 300 + "</think>\n```python\nprint(1)\n```")
    assert cut["reasoning_truncated"] and len(cut["input_ids"]) - cut["prompt_tokens"] <= 100 and cut["final_response"].startswith("<think>r") and cut["final_response"].endswith("</think>\n```python\nprint(1)\n```")
    assert build(2, "no code")["drop_reason"] == "unlocatable_final_code"
    assert build(2, "<think>print(1)\n</think>")["drop_reason"] == "unclosed_or_late_think"
    assert build(2, "```python\nprint(1)\n")["drop_reason"] == "unclosed_code_fence"
    assert build(2, "print(1)\n" + "x" * 200)["drop_reason"] == "mandatory_structural_suffix_over_response_budget"
    assert build(2, "print(1)\n", longest=5)["drop_reason"] == "prompt_plus_response_over_sequence_budget"


def test_sequence_v1_and_v3():
    v1 = build(1, "r" * 300 + CODE, longest=100)
    assert v1["reasoning_truncated"] and v1["final_response"].endswith(CODE) and len(v1["input_ids"]) == 100 and v1["labels"][-1] == sequences.IGNORED
    assert build(1, "x" * 300, longest=100)["drop_reason"] == "unlocatable_final_code"
    assert build(3, "r" * 300 + CODE)["drop_reason"] == "natural_response_over_budget" and not build(3, "abc " + CODE)["dropped"]
    with pytest.raises(ValueError):
        build(3, "x", budget=1)


def test_locate_ignores_white_space():
    assert sequences.locate("a\nprint( 1 )\n\n x", "print( 1 )\n x") == (2, 16, "whitespace_normalized")


def test_labels_and_padding(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3, 9]), (2, 0, [4, 9])], "i int, b int, input_ids array<int>").withColumn("labels", F.col("input_ids"))
    got = {r.i: r for r in sequences.pad_batches(df, "b", 0).collect()}
    assert got[2].input_ids == [4, 9, 0, 0] and got[2].labels == [4, 9, -100, -100] and got[2].attention_mask == [1, 1, 0, 0]
    row = df.select(sequences.response_labels(F.col("input_ids"), F.lit(1), F.lit(2)).alias("l"), sequences.shifted_positions(sequences.response_labels(F.col("input_ids"), F.lit(1), F.lit(2))).alias("s")).first()
    assert row.l == [-100, 2, 3, -100] and row.s == [1, 2]


def test_integrity_passes_built_rows(spark):
    df = spark.createDataFrame([("a", "Q", "<think>" + "r" * 300 + "</think>\n" + CODE, CODE), ("b", "Q", None, None)], "problem_id string, prompt string, response string, code string")
    rows = sequences.build_sequences(df, 2, 200, 100)
    assert sequences.integrity(rows, 200, 100, TOK.eos_id).count() == 0
    assert sequences.integrity(rows, 50, 100, TOK.eos_id).first().failed == ["sequence_budget"]
    assert sequences.construction_stats(rows).first().dropped == 1


def test_jsonl_round_trip_and_failures(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    df = spark.createDataFrame([(2, "b"), (1, 'a"')], "i int, s string")
    jsonl.write_jsonl(df, path, F.to_json(F.struct("i", "s")), order="i", single=True)
    assert [tuple(r) for r in jsonl.read_jsonl(spark, path, "i int, s string").collect()] == [(1, 'a"'), (2, "b")]
    with pytest.raises(Exception, match="already exists"):
        jsonl.write_jsonl(df, path, F.to_json(F.struct("i", "s")))
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"i": 1}\n\n[1]\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(bad), "i int").collect()


def test_ordinals(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"id": 7, "v": "x"}\n\n{"v": "y"}\n{"id": 3, "v": "z"}\n')
    wanted = spark.createDataFrame([(2,), (3,)], "index long")
    assert sorted((r["index"], r.v) for r in ordinal.wanted_lines(spark, str(lines), "id long, v string", wanted).collect()) == [(2, "y"), (3, "z")]
    for k, n in enumerate((4, 6)):
        spark.range(100 * k, 100 * k + n).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        next((tmp_path / f"w{k}").glob("*.parquet")).rename(tmp_path / f"shard-{k}.parquet")
    shards = str(tmp_path / "shard-*.parquet")
    assert {r.ordinal: r.id for r in ordinal.numbered_shards(spark, shards).collect()}[5] == 101
    want = spark.createDataFrame([(1,), (9,)], "index long")
    assert sorted((r.ordinal, r.id) for r in ordinal.wanted_shards(spark, shards, want).collect()) == [(1, 1), (9, 105)]
    assert ordinal.capped(spark.range(10), "id", 4)[1] == "max_records_reached" and ordinal.capped(spark.range(3), "id", 4)[1] == "dataset_exhausted"


def test_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a\n\nb\n")
    assert files.file_hashes(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"a\n\nb\n").hexdigest() and files.line_count(spark, str(tmp_path / "f.txt")) == 2
    a, b = spark.createDataFrame([(1, "x")], "k int, c string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, c string")
    assert files.merge_shards([a, b], "k", "c").count() == 2
    with pytest.raises(Exception, match="disagree"):
        files.merge_shards([a, spark.createDataFrame([(1, "z")], "k int, c string")], "k", "c").collect()
    spark.range(3).write.parquet(str(tmp_path / "data" / "train"))
    df, missing = files.read_splits(spark, str(tmp_path / "data"), ["train", "test"])
    assert df.count() == 3 and missing == ["test"]


def test_gates():
    a, b = {"x": {"lr": 1, "n": 2}, "out": "a"}, {"x": {"lr": 2, "n": 2}, "out": "b"}
    assert gates.config_difference(a, b) == ["out", "x.lr"] and gates.config_difference(a, b, ("out", "x.lr")) == []
    assert [gates.length_policy_status(100, 100, c) for c in (5, 6, None)] == ["completed", "incomplete", "awaiting"]
    with pytest.raises(ValueError):
        splits.least_tests({"min_total_tests_by_split": {"sft": 1}})
    assert splits.least_tests({"min_total_tests": 3}) == {"sft": 3, "pt": 3, "dev": 3}


def test_processed_validity(spark):
    schema = PROBLEM.replace("tests", "reward_tests") + ", heldout_tests array<struct<test_id:string,input:string,output:string>>, reasoning string, split string"
    ok, same_id, same_text = [("b", "3", "4")], [("t", "3", "4")], [("b", "1\n", "2\n")]
    rows = [(1, "s:1", "s", "1", "e", "p", "c", T, h, "r", "sft") for h in (ok, same_id, same_text, [])] + [(1, "s:1", "s", "1", "e", "p", "c", T, ok, "r", "test")]
    assert [r.v for r in spark.createDataFrame(rows, schema).select(validate.valid_processed().alias("v")).collect()] == [True, False, False, False, False]
