import json
import random

import pytest

from loomline.plans import curate

CONFIG = {"seed": 20260904, "ratios": {"sft": 0.6, "pt": 0.3, "dev": 0.1}, "min_total_tests_by_split": {"sft": 2, "pt": 4, "dev": 4}, "ngram": 5, "threshold": 0.8}


def raw(rng):
    words = [f"w{k}" for k in range(500)]
    problems, reasoning = [], []
    for k in range(40):
        text = " ".join(rng.choice(words) for _ in range(40))
        if k % 10 == 9:
            text = problems[k - 1][5] + " tail"  # a near duplicate of its neighbour
        tests = [(None, f"{k} {i}\n", f"{i}\n") for i in range(3 if k % 7 == 6 else 8)]
        problems.append((k, None, "s", f"train:{k}", "easy", text, "print(1)", tests))
        if k % 8 != 7:
            reasoning.append((k, None, "s", f"train:{k}", "because"))
    return problems, reasoning


def test_pipeline(spark, tmp_path):
    problems, reasoning = raw(random.Random(3))
    p = spark.createDataFrame(problems, "pos long, " + curate.PROBLEM)
    r = spark.createDataFrame(reasoning, "reasoning_id long, " + curate.REASONING)
    result = curate.curate(p, r, CONFIG)
    report = curate.write(result, str(tmp_path / "out"))
    assert report["gate_passed"] and report["dropped"]["no_reasoning"] == 5
    assert sum(report["counts"].values()) + sum(report["dropped"].values()) == 40
    lines = [json.loads(x) for s in ("sft", "pt", "dev") for f in (tmp_path / "out" / s).glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == sum(report["counts"].values())
    for row in lines:
        assert sorted(row) == ["difficulty", "heldout_tests", "problem_id", "prompt", "reasoning", "reference_code", "reward_tests", "source", "source_id", "split"]
        assert not {t["test_id"] for t in row["reward_tests"]} & {t["test_id"] for t in row["heldout_tests"]}
    with pytest.raises(Exception, match="already exists"):
        curate.write(result, str(tmp_path / "out"))
