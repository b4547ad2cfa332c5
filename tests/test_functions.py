import hashlib
import json
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import json_tests, keys, stats, text


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.v for r in spark.createDataFrame(rows, f"i int, x {kind}").select("i", expression.alias("v")).orderBy("i").collect()]


def stable(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


SWEEP = ["".join(map(chr, range(a, a + 64))) for a in [*range(1, 0x800, 64), 0x2000, 0xFB00, 0xFF00, 0x1F600]]


def test_stable_json_equals_python_on_a_sweep(spark):
    values = [*SWEEP, 'a"b\\c\n', "\\u000b", "", "\x0b\x1f"]
    assert column(spark, values, keys.json_string("x")) == [stable(v) for v in values]
    found = column(spark, values, keys.split_order_key("x", 7))
    assert found == [hashlib.sha256(stable({"seed": 7, "problem_id": v}).encode()).hexdigest() for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"], blacklist_characters="\0")), min_size=40, max_size=80))
def test_text_functions_equal_python(spark, values):
    assert column(spark, values, text.strip("x")) == [v.strip() for v in values]
    assert column(spark, values, text.is_text("x")) == [bool(v.strip()) for v in values]
    assert column(spark, values, text.words("x")) == [v.split() for v in values]
    assert column(spark, values, text.normalize("x")) == [" ".join(re.sub(r"[^a-z0-9_]+", " ", v.lower()).split()) for v in values]


def lines_of(value):
    lines = [x.rstrip(" \t") for x in value.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while lines and lines[-1] == "":
        lines.pop()
    return "\n".join(lines)


def test_normalize_output(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("ab \t\r\n\u0085 ") for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    assert column(spark, values, text.normalize_output("x")) == [lines_of(v) for v in values]


def test_ngrams_and_jaccard(spark):
    got = column(spark, ["a b c d e f", "a b", "", "x x x x x x"], text.ngram_set(text.tokens_of(text.normalize("x")), 5))
    assert got == [["a b c d e", "b c d e f"], ["a b"], [], ["x x x x x"]]
    rows = spark.createDataFrame([(0, 0, 0), (0, 3, 0), (2, 3, 3)], "c int, l int, r int").select(text.jaccard(F.col("c"), F.col("l"), F.col("r")).alias("j")).collect()
    assert [r.j for r in rows] == [1.0, 0.0, 0.5]


@pytest.mark.parametrize(
    "response, code, strategy",
    [
        ("x\n```python\nprint(1)\n```", "print(1)\n", "fenced:python"), ("```\na\n```\n```py\nb\n```", "b\n", "fenced:py"), ("```js\na\n```", "a\n", "fenced:untyped"), ("<think>\n```python\nz\n```\n</think>\nprint(2)", "print(2)\n", "direct"),
        ("", "", "empty"), ("<think>open ```python\nq\n```", "q\n", "fenced:python"), ("```x```", "x\n", "fence-stripped"), ("  print(3) ", "print(3)\n", "direct"),
    ],
)
def test_extract_code(spark, response, code, strategy):
    found = column(spark, [response], text.extract_code("x"))[0]
    assert (found.code, found.strategy) == (code, strategy)


@pytest.mark.parametrize(
    "response, valid, kind",
    [
        ("<think>a</think>\n```python\nx\n```", True, "think_fenced"), ("<think>a", False, "unclosed_think"), ("<think>```python\nx\n```</think>", False, "think_fenced"), ("```\nx", False, "fenced"), ("x", True, "plain"),
        ("<think>a</think> x", True, "think_unfenced"),
    ],
)
def test_format_flags(spark, response, valid, kind):
    found = column(spark, [response], text.format_flags("x", F.lit(True)))[0]
    assert (found.format_valid, found.format_class) == (valid, kind)


def rank(values, q):
    ordered = sorted(map(float, values))
    return ordered[round(q / 100 * (len(ordered) - 1))]


def test_percentiles_are_nearest_rank_with_halves_to_even(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(50)) for g in range(40) for _ in range(rng.randrange(1, 30))]
    found = {r.g: r for r in stats.numeric_stats(spark.createDataFrame(rows, "g int, v int"), "v", (5, 25, 50, 75, 95), ("g",)).collect()}
    for g in range(40):
        values = [v for x, v in rows if x == g]
        assert [found[g][f"p{q}"] for q in (5, 25, 50, 75, 95)] == [rank(values, q) for q in (5, 25, 50, 75, 95)]
        assert found[g]["count"] == len(values) and found[g]["max"] == max(values)
    empty = stats.numeric_stats(spark.createDataFrame([], "v int"), "v", (50,)).collect()[0]
    assert (empty["count"], empty["p50"], empty["max"]) == (0.0, 0.0, 0.0)


def test_pass_at_k(spark):
    rows = [(n, c) for n in range(1, 12) for c in range(n + 1)]
    for k in (1, 3, 5):
        got = spark.createDataFrame(rows, "n long, c long").select("n", "c", stats.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect()
        for r in got:
            want = None if r.n < k else 1 - math.comb(r.n - r.c, k) / math.comb(r.n, k)
            assert r.p is None and want is None or abs(r.p - want) < 1e-12


def test_json_tests(spark):
    values = ['{"inputs": ["1", "2"], "outputs": ["3", "4"]}', '{"inputs": ["1"], "outputs": []}', '{"inputs": [1, "2"], "outputs": ["a", "b"]}', "no json", None, "", "[]"]
    found = column(spark, values, json_tests.tests("x"))
    assert [[(t.input, t.output) for t in f] if f is not None else None for f in found][:3] == [[("1", "3"), ("2", "4")], [], [("2", "b")]]
    assert all(not f for f in found[3:])
    assert column(spark, ['["a", 1, " ", "b"]', "x", None], json_tests.solutions("x")) == [["a", "b"], [], []]
    assert column(spark, [None, "NaN", "v"], json_tests.as_text("x")) == ["", "", "v"]
