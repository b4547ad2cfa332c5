import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import stats, text
from loomline.operators import gates, joins, overlap, qualify, rollouts, sequences, verify
from loomline.sources import files, ordinal

CANDIDATE = "pos long, dataset string, index string, split string, judgement string, pass_rate string, reasoning string"


def test_candidate_cascade_orders_its_reasons(spark):
    rows = [
        (1, "other", "x", "", "wrong", "0", ""), (2, "taco", "x", "", "wrong", "0", ""), (3, "taco", "1", " ", "wrong", "0", ""), (4, "TACO ", "1", "Train", "wrong", "1", "r"), (5, "taco", "1", "train", "Right", "0.5", "r"),
        (6, "taco", "1", "train", "right", "1.0", "  "), (7, "taco", "1", "train", "right", "1.0", "r"), (8, "taco", "1", "train", "wrong", "0", ""), (9, "taco", "2", "train", "right", "nan", "r"), (10, "taco", "3", None, "right", "1", "r"),
        (11, None, "1", "train", "right", "1", "r"), (12, "taco", None, "train", "right", "1", "r"), (13, "taco", "4", "train", "right", None, "r"),
    ]
    got = {r.pos: r.reject_reason for r in joins.candidate_cascade(spark.createDataFrame(rows, CANDIDATE).repartition(3), "pos", ["taco"], "right", 1.0).collect()}
    want = ["dataset_not_selected", "bad_index", "missing_source_split", "bad_judgement", "low_pass_rate", "missing_reasoning", None, "duplicate_problem", None, "missing_source_split", "dataset_not_selected", "bad_index", "low_pass_rate"]
    assert [got[k] for k in range(1, 14)] == want


def test_frozen_selection_fails_on_tampering(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "problem_id string, h string")
    manifest = spark.createDataFrame([("a", "1", True), ("b", "2", False), ("c", "3", None)], "problem_id string, source_response_hash string, member boolean")
    assert [r.problem_id for r in joins.frozen_selection(rows, manifest, F.col("h")).collect()] == ["a"]
    for bad in (manifest.where("problem_id <> 'b'"), manifest.withColumn("source_response_hash", F.lit("x"))):
        with pytest.raises(Exception, match="disagree"):
            joins.frozen_selection(rows, bad, F.col("h")).collect()
    told = gates.frozen_gate(joins.frozen_status(rows, manifest, F.col("h")), 1, "h", "h").first()
    assert (told.selected, told.missing, told.mismatched, told.passed) == (1, 0, 0, True)
    assert not gates.frozen_gate(joins.frozen_status(rows, manifest, F.col("h")), 1, "h", "g").first().passed


def test_data_gate_passes_only_without_any_fault(spark):
    rows = spark.createDataFrame([(True,), (True,)], "ok boolean")
    zero, one = (spark.createDataFrame([("sft_pt", 0, k, 0)], "pair string, ids long, texts long, near long") for k in (0, 1))
    issues = spark.createDataFrame([("a", "missing")], "problem_id string, issue string")
    assert gates.data_gate(rows, F.col("ok"), zero, issues.where("false")).first().passed
    assert not gates.data_gate(rows, F.col("ok"), one, issues.where("false")).first().passed
    assert not gates.data_gate(rows, F.col("ok"), zero, issues).first().passed
    assert not gates.data_gate(rows, ~F.col("ok"), zero, issues.where("false")).first().passed
    assert not gates.data_gate(rows.where("false"), F.col("ok"), zero, issues.where("false")).first().passed


def test_control_and_configuration_gates():
    a = {"training": {"rate": 1e-4, "epochs": 1}, "out": "x", "model": {"name": "m"}}
    b = {"training": {"rate": 2e-4, "epochs": 1}, "out": "y", "model": {"name": "m"}}
    assert gates.control_gate(a, b, ("training.rate", "out"), {"manifest": ("h", "h")})["passed"]
    assert gates.control_gate(a, b, ("out",), {"manifest": ("h", "g")}) == {"unexpected_differences": ["training.rate"], "stale_hashes": ["manifest"], "passed": False}
    assert gates.config_matches(a, {"training.epochs": 1, "model.name": "n", "model.size.x": 3}) == ["model.name", "model.size.x"]
    assert files.generation_config({"do_sample": False, "max_new_tokens": 5, "temperature": 0.1, "name": "x"}) == {"do_sample": False, "max_new_tokens": 5}
    told = files.provenance({"split": 7}, ("pyspark", "no-such-package"))
    assert told["seeds"] == {"split": 7} and told["packages"]["pyspark"] and told["packages"]["no-such-package"] is None


def test_prompts_are_never_cut(spark):
    df = spark.createDataFrame([("a", 10), ("b", 90)], "problem_id string, n int")
    assert sequences.within_context(df, "n", 10, 100).count() == 2
    with pytest.raises(Exception, match="does not fit"):
        sequences.within_context(df, "n", 11, 100).collect()


def test_located_code_equals_the_scalar_version(spark):
    rng = random.Random(4)
    rows = [("a  b\nc", "a b c"), ("xx a b", "a b"), ("a.b (c)", "a.b\t(c)"), ("none", "some"), ("x", " "), ("x", ""), ("q \\E r", "q\n\\E  r"), ("a b", "a b"), ("aab ab", "ab")]
    for _ in range(200):
        rows.append(("".join(rng.choice("ab \n") for _ in range(12)), "".join(rng.choice("ab \n") for _ in range(4))))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, c string").withColumn("x", text.locate_code("t", "c"))
    got = {r.k: r.x for r in df.collect()}
    for k, (t, c) in enumerate(rows):
        want = sequences.locate(t, c)
        assert (tuple(got[k]) if got[k] else None) == want, (t, c)


def test_numbered_lines_over_several_files_and_blocks(spark, tmp_path):
    lines = []
    for f in range(3):
        own = [f"{f}-{k} " + "x" * (k % 50) if k % 7 else "" for k in range(3000)]
        (tmp_path / f"part-{f}").write_text("\n".join(own) + "\n", encoding="utf-8")
        lines += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.ordinal: r.value for r in ordinal.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: line for k, line in enumerate(lines) if line.strip()}


def test_wanted_shards_over_uneven_shards(spark, tmp_path):
    n, rows = 0, []
    for k, size in enumerate((5, 0, 1000, 3, 200)):
        spark.range(n, n + size).coalesce(1).write.mode("append").parquet(str(tmp_path / "all")) if size else None
        n += size
    shards = ordinal.numbered_shards(spark, str(tmp_path / "all"))
    by = {r.ordinal: r.id for r in shards.collect()}
    assert sorted(by) == list(range(n))
    wanted = spark.createDataFrame([(k,) for k in (0, 4, 5, 700, 1004, 1207, 5000, -3)], "index long")
    got = {r.ordinal: r.id for r in ordinal.wanted_shards(spark, str(tmp_path / "all"), wanted).collect()}
    assert got == {k: by[k] for k in (0, 4, 5, 700, 1004, 1207)} and not rows


def test_hashes_of_ordered_rows(spark):
    texts = [f"é\"{k}\n" for k in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(5)
    whole = rollouts.list_hash(df, "k", F.col("t")).first()
    assert (whole.rows, whole.list_hash) == (200, hashlib.sha256(json.dumps(texts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest())
    assert rollouts.list_hash(df.where("false"), "k", F.col("t")).first().list_hash == hashlib.sha256(b"[]").hexdigest()
    hashes = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(9000)]
    level = hashes
    while True:
        level = [hashlib.sha256(",".join(level[i : i + 4096]).encode()).hexdigest() for i in range(0, len(level), 4096)]
        if len(level) == 1:
            break
    got = rollouts.ordered_hash(spark.range(9000).repartition(7), "id", F.sha2(F.col("id").cast("string"), 256)).first()
    assert (got.rows, got.dataset_hash) == (9000, level[0])
    assert rollouts.ordered_hash(spark.range(0), "id", F.lit("x")).first().dataset_hash == hashlib.sha256(b"").hexdigest()


def test_containment_equals_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 40))) for _ in range(60)]
    rows = [(f"d{k}", k, t) for k, t in enumerate(texts)]
    df = overlap.shingled(spark.createDataFrame(rows, "problem_id string, pos long, prompt string"), 2)
    left, right = df.where("cast(substring(problem_id, 2, 9) AS int) % 3 > 0"), df.where("cast(substring(problem_id, 2, 9) AS int) % 3 = 0")

    def grams(t):
        w = t.split()
        return set(zip(w, w[1:]))

    for least in (0.1, 0.5, 1.0):
        want = {(f"d{i}", f"d{j}") for i, a in enumerate(texts) for j, b in enumerate(texts) if i % 3 and not j % 3 and len(grams(a) & grams(b)) / len(grams(b)) >= least}
        assert {(r.left_id, r.right_id) for r in overlap.containment_pairs(left, right, least).collect()} == want


def test_diagnosed_programs(spark):
    tests = [("t1", "1 2\n", "3\n"), ("t2", "2 2\n", "4\n")]
    code = {"ok": "a, b = map(int, input().split())\nprint(a + b)", "space": "a, b = map(int, input().split())\nprint('', a + b)", "wrong": "print(0)", "crash": "import nosuchmodule", "syntax": "def"}
    schema = "problem_id string, code string, tests array<struct<test_id:string,input:string,output:string>>, prompt string"
    df = spark.createDataFrame([(k, c, tests, "Print any valid pair" if k == "wrong" else "p") for k, c in code.items()], schema)
    got = {r.problem_id: (r.status, r.failure_class, r.wa_category, r.first_failure) for r in verify.diagnosed(df, verify.Sandbox(wall_time_seconds=2.0)).collect()}
    assert got["ok"] == ("AC", "accepted", None, None)
    assert got["space"][0] == "WA" and got["space"][2:] == ("whitespace_tokenization_mismatch", "t1")
    assert got["wrong"][2:] == ("unsupported_multiple_output_style_problem", "t1")
    assert got["crash"][:2] == ("RE", "unsupported_dependency") and got["syntax"][0] == "CE"
    flags = qualify.candidate_flags(F.lit(True), F.lit(True), F.lit(None).cast("boolean"))
    assert set(flags) == {"sft_candidate", "pt_candidate", "dev_candidate"}


def test_reports(spark):
    df = spark.createDataFrame([(1, "a", 2048, False), (2, "b", 10, True)], "rollout_id long, s string, response_token_count long, hit_max_new_tokens boolean")
    assert [r.hit_max_new_tokens for r in rollouts.final_policy(df, 2048, 2).orderBy("rollout_id").collect()] == [True, False]
    with pytest.raises(Exception, match="another number"):
        rollouts.final_policy(df, 2048, 3).collect()
    assert rollouts.capped(df, 2048, exactly=True).count() == 1 and rollouts.capped(df, 5).count() == 2
    told = {(r.rule, r.value): (r["count"], r.share, r.delta) for r in stats.subset_summary(df, {"x": F.col("s") == "a", "none": F.lit(False)}, "s").collect()}
    assert told["x", "a"] == (1, 1.0, 0.5) and told["x", "b"] == (1, 0.0, -0.5) and told["none", "a"] == (0, 0.0, -0.5)
    values = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.f for r in values.select(stats.is_finite(F.col("v")).alias("f")).collect()] == [True, False, False, False]


RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no rank file")
def test_sequences_under_a_rank_file(spark):
    """Budgets hold in tokens of a real tokenizer, offsets cover the text, and what is kept decodes to parts of the response."""
    tok = sequences.RankTokenizer(RANKS, 50256)
    text = "Größe 12, 名前 and\n```python\nprint('é')\n```\n"
    ids, offsets = tok.encode(text)
    assert tok.decode(ids) == text and offsets[0][0] == 0 and offsets[-1][1] == len(text) and all(a <= b for a, b in zip([o[0] for o in offsets], [o[0] for o in offsets][1:]))
    code = "x = int(input())\nprint(x * 2)\n"
    response = "We double the weight. " * 80 + "\n```python\n" + code + "```\n"
    for version, build in sequences.VERSIONS.items():
        for longest, budget in ((4000, 3000), (200, 120), (60, 50), (30, 20)):
            row = build(tok, "### Problem\np\n", response, code, longest, budget)
            assert row["dropped"] or (len(row["input_ids"]) <= longest and row["input_ids"][-1] == tok.eos_id and code in row["final_response"] and len(row["labels"]) == len(row["input_ids"]))
            assert row["dropped"] or version == 1 or len(row["input_ids"]) - row["prompt_tokens"] <= budget
    df = spark.createDataFrame([("a", "p", response, code), ("b", None, None, None)], "problem_id string, prompt string, response string, code string")
    kept = {r.problem_id: r for r in sequences.build_sequences(df, 2, 200, 120, tok).collect()}
    assert kept["a"].reasoning_truncated and kept["b"].drop_reason == "unlocatable_final_code"
    counts = {r.problem_id: r.n for r in sequences.token_counts(df, {"n": "response"}, tok).collect()}
    assert counts == {"a": len(tok.encode(response)[0]), "b": 0}


def test_files_of_a_run(spark, tmp_path):
    from loomline.sources import jsonl

    (tmp_path / "b.py").write_bytes(b"two")
    (tmp_path / "a.py").write_bytes(b"one")
    assert files.code_hash([tmp_path / "b.py", tmp_path / "a.py"]) == hashlib.sha256(b"a.py\0one\0b.py\0two\0").hexdigest()
    (tmp_path / "c.json").write_text('{"seed": 7}')
    assert files.load_config(tmp_path / "c.json") == {"seed": 7}
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError, match="no mapping"):
        files.load_config(tmp_path / "d.json")
    assert files.resolve("x", "/r").as_posix() == "/r/x" and files.resolve("/x", "/r").as_posix() == "/x"
    jsonl.write_json({"b": 1, "a": "é"}, tmp_path / "deep" / "r.json")
    assert (tmp_path / "deep" / "r.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n' and jsonl.read_json(tmp_path / "deep" / "r.json") == {"a": "é", "b": 1}
    log = files.logger("loomline-test", str(tmp_path / "logs" / "run.log"))
    log.info("told")
    assert "told" in (tmp_path / "logs" / "run.log").read_text()
    with pytest.raises(ValueError, match="backend"):
        verify.verify_program("print(1)", [], verify.Sandbox(backend="other"))
    df = spark.createDataFrame([("a",)], "problem_id string")
    line = F.concat(F.lit('{"problem_id":"'), "problem_id", F.lit('"}'))
    jsonl.write_jsonl(df, str(tmp_path / "out"), line)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        jsonl.write_jsonl(df, str(tmp_path / "out"), line)
    jsonl.write_jsonl(df, str(tmp_path / "out"), line, overwrite=True)
    found, missing = files.read_splits(spark, str(tmp_path), ["absent"])
    assert found is None and missing == ["absent"]
