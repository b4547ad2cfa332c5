import ast
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators import verify

BOX = verify.Sandbox(wall_time_seconds=0.5, cpu_time_seconds=1, memory_mb=256, output_limit_bytes=100_000)
SUM = [{"test_id": "t", "input": "2 3\n", "output": "5\n"}]


@pytest.mark.parametrize(
    "code, status, error",
    [
        ("print(sum(map(int, input().split())))", "AC", None), ("def broken(:\n", "CE", "SyntaxError"), ("raise RuntimeError('x')", "RE", "RuntimeError"), ("while True: pass", "TLE", None), ("print(6)", "WA", None),
        ("print('5   ')\nprint()", "AC", None), ("import socket\nsocket.socket()", "RE", "RuntimeError"), ("import subprocess\nsubprocess.Popen(['ls'])", "RE", "RuntimeError"), ("import os\nos.system('ls')", "RE", "RuntimeError"),
        ("open('/etc/passwd').read()", "RE", "PermissionError"), ("print('x' * 200000)", "RE", "OutputLimitExceeded"), ("x = 'a' * 10**9", "RE", "MemoryError"), ("import sys\nsys.exit(3)", "RE", None), ("import os\nos._exit(0)", "RE", "NoReport"),
        ("return 1", "CE", "SyntaxError"),
    ],
)
def test_verdicts(code, status, error):
    found = verify.verify_program(code, SUM, BOX)
    assert (found.status, found.error_type) == (status, error)


def test_internal_white_space_counts_and_no_tests_pass():
    assert verify.verify_program("print('1 2')", [{"input": "", "output": "1\n2\n"}], BOX).status == "WA"
    assert verify.verify_program("x = 1", [], BOX).status == "AC"
    with pytest.raises(ValueError):
        verify.verify_program("x = 1", [], verify.Sandbox(backend="none"))


def test_roll_up_and_order():
    assert verify.roll_up(["AC", "WA", "RE", "TLE"]) == "TLE" and verify.roll_up(["WA", "RE"]) == "RE" and verify.roll_up([]) == "AC"
    v = verify.verify_program("import sys\nx = input()\nif x == 'r': raise IndexError(x)\nprint(x)", [{"input": "a", "output": "a"}, {"input": "r", "output": ""}, {"input": "b", "output": "c"}], BOX)
    assert (v.status, v.passed, [r["status"] for r in v.runs]) == ("RE", 1, ["AC", "RE", "WA"])


def test_frames(spark):
    tests = [("t", "2 3\n", "5\n")]
    df = spark.createDataFrame([("a", "```python\nprint(5)\n```", tests), ("b", None, tests), ("c", "print(", tests)], "problem_id string, response string, tests array<struct<test_id:string,input:string,output:string>>")
    got = {r.problem_id: r for r in verify.verify_responses(df, "response", "tests", BOX).withColumn("f", verify.failure_class(F.col("status"), F.col("error_type"), F.col("error_message"))).collect()}
    assert [got[k].status for k in "abc"] == ["AC", "WA", "CE"] and got["a"].strategy == "fenced:python" and got["c"].f == "bad_reference_solution_or_extraction"
    tries = spark.createDataFrame([("a", ["print(1)", "print(5)", "print(5)"], tests), ("b", None, tests), ("s", ["import time\ntime.sleep(0.8)\nprint(5)"], tests)], "problem_id string, s array<string>, tests array<struct<test_id:string,input:string,output:string>>")
    out = {r.problem_id: r.attempts for r in verify.attempts(tries, "s", "tests", BOX, slow=verify.Sandbox(wall_time_seconds=3.0)).collect()}
    assert [a.status for a in out["a"]] == ["WA", "AC"] and out["b"] == [] and (out["s"][0].status, out["s"][0].slow_status) == ("TLE", "AC")


def _key(v):
    return v.status, v.passed, v.error_type, v.error_message, [{k: x for k, x in r.items() if k != "runtime_ms"} for r in v.runs]


def test_many_programs_take_less_than_a_start_of_python_each():
    verify.verify_program("x = 1", SUM, BOX)  # the server
    began = time.monotonic()
    for k in range(100):
        assert verify.verify_program(f"def f(x):\n    return sum(map(int, x.split()))\nprint(f(input()) + {k})", SUM * 8, BOX).status == ("WA" if k else "AC")
    took, began = time.monotonic() - began, time.monotonic()
    for _ in range(3):
        subprocess.run([sys.executable, "-c", "import socket, subprocess, tempfile"], check=True)
    assert took < 100 * (time.monotonic() - began) / 3


@pytest.mark.parametrize(
    "code",
    [
        "print(sum(map(int, input().split())))", "import sys\nprint(sys.stdin.buffer.read())\nprint('a', file=sys.stderr)", "import sys\nsys.stdin.write('x')", "import sys\nfor x in sys.stdout: pass", "import sys\nsys.exit('bad')",
        "def f(n):\n    return n and 1 + f(n - 1)\nprint(f(990), f(996))", "def f(n):\n    try:\n        return f(n + 1)\n    except RecursionError:\n        return n\nprint(f(0))", "x = [0] * 10**8", "print('x' * 200000)", "1 / 0", "print(int(input()))",
        "print('\\ud800')", "print(undefined)", "x = 0\nwhile x < 10**6: x += 1\nprint(x)", "from heapq import *", "print(len(set(input())))", "print(list({'b', 'a', 'c'}))",
    ],
)
def test_plain_programs_have_the_verdicts_of_processes_of_their_own(code, monkeypatch):
    tests = [{"input": x, "output": "5\n"} for x in ("2 3\n", "4\r\n5\r", "", "\u00e9")]
    box = verify.Sandbox(wall_time_seconds=2.0, cpu_time_seconds=2, memory_mb=256, output_limit_bytes=100_000)
    found = _key(verify.verify_program(code, tests, box))
    monkeypatch.setattr(verify, "is_plain", lambda tree: False)
    assert found == _key(verify.verify_program(code, tests, box))


@pytest.mark.parametrize(
    "code, plain",
    [
        ("import sys\nfrom collections import deque\nprint(deque(sys.stdin.readline().split()).popleft())", True), ("f = lambda x: [y for y in x if y]\nprint(f'{f([1])}')", True), ("print(undefined)", True), ("if __name__ == '__main__':\n    print(1)", True),
        ("import os", False), ("from sys import modules", False), ("from sys import *", False), ("import sys\nsys.stdout = 1", False), ("import heapq\nheapq.heappush = 1", False), ("().__class__", False), ("open('x')", False), ("eval('1')", False), ("getattr(1, 'x')", False),
        ("class A:\n    pass", False), ("def f():\n    yield 1", False), ("import sys\nsys.path.append(1)", False), ("print(__builtins__)", False), ("import sys\nsys.setrecursionlimit(9)", False), ("'{0.modules}'.format(1)", False), ("def __x(): pass", False),
        ("with x: pass", False), ("import collections.abc", False), ("exit()", False), ("import sys\ndel sys.stdin", False),
    ],
)
def test_plain_programs(code, plain):
    assert verify.is_plain(ast.parse(code)) is plain


def test_a_program_leaves_nothing_to_the_next():
    tests, writes = [{"input": "1", "output": "1"}], "open('a', 'x').write('1')\nprint(input())"
    for code, status in (
        ("x = 5\nwhile True: pass", "TLE"), ("print(x)", "RE"), ("import os\nos.kill(os.getppid(), 9)", "RE"), ("print(input())", "AC"), ("import os\nos.kill(os.getsid(0), 9)", "RE"), ("import os\nprint(input())", "AC"), (writes, "AC"), (writes, "AC"),
    ):
        assert verify.verify_program(code, tests, BOX).status == status, code
    process = verify._server().process
    process.kill()  # as the kernel does when memory is short
    process.wait()
    assert verify.verify_program(writes, tests, BOX).status == "AC"
    assert verify.verify_program("print(open('/dev/stdin').read())", tests, BOX).status == "AC"


def test_many_responses_take_less_than_a_start_of_python_each(spark):
    rows = [(str(k), f"```python\nimport sys\nsys.stdout.write('{k}')\n```", [("t", "", str(k - k % 2))]) for k in range(400)]
    df = spark.createDataFrame(rows, "problem_id string, response string, tests array<struct<test_id:string,input:string,output:string>>")
    verify.verify_responses(df.limit(4), "response", "tests", BOX).collect()
    began = time.monotonic()
    got = {r.problem_id: r.status for r in verify.verify_responses(df, "response", "tests", BOX).collect()}
    took, began = time.monotonic() - began, time.monotonic()
    assert got == {str(k): "WA" if k % 2 else "AC" for k in range(400)}
    for _ in range(3):
        subprocess.run([sys.executable, "-c", "import socket, subprocess, tempfile"], check=True)
    assert took < 100 * (time.monotonic() - began) / 3


REPEATING = [
    "while True:\n    pass\n", "n = int(input().split()[0])\ni = 0\nwhile i < n:\n    j = i * 2", "x = 2\nwhile x != 1: x = (x * x + 1) % 1000", "import sys\nwhile True:\n    line = sys.stdin.readline()\n    if not line.strip(): continue",
    "from collections import deque\ndef f(q, n):\n    d = {}\n    while q:\n        x = q.popleft()\n        q.append((x + 1) % n)\n        d[x] = 1\nf(deque([0]), 7)",
    "def g(a, t):\n    lo, hi = 0, len(a)\n    while lo < hi:\n        mid = (lo + hi) // 2\n        if a[mid] < t: lo = mid\n        else: hi = mid\n    return lo\nprint(g([1, 2, 3, 4], 4))",
]


def test_a_program_in_a_state_that_it_has_been_in_is_late_at_once(monkeypatch):
    box, whole = verify.Sandbox(wall_time_seconds=4.0, cpu_time_seconds=2), time.monotonic()
    found = [_key(verify.verify_program(code, SUM * 2, box)) for code in REPEATING]
    assert time.monotonic() - whole < 8 and {f[0] for f in found} == {"TLE"}  # in full, 24 s
    monkeypatch.setattr(verify, "may_repeat", lambda tree: False)
    assert found[0] == _key(verify.verify_program(REPEATING[0], SUM * 2, box)) and found[1] == _key(verify.verify_program(REPEATING[1], SUM * 2, box))


def test_programs_known_to_be_late_count_in_the_time_of_all_test_cases():
    box, whole = verify.Sandbox(wall_time_seconds=2.0, cpu_time_seconds=1), time.monotonic()
    assert [(v.status, v.error_type, len(v.runs)) for v in (verify.verify_program(REPEATING[0], SUM * n, box) for n in (50, 61))] == [("TLE", None, 50), ("TLE", "harness_timeout", 0)]
    assert time.monotonic() - whole < 30


@pytest.mark.parametrize(
    "code",
    [  # what they get on with is in the place of a `for` loop, an iterator, a cell, a default, a bound method, a set, a cache, a stream or a global
        "for _ in [0] * 300000:\n    while True: break\nprint(5)", "it = iter([0] * 300000)\nx = 0\nwhile x == 0: x = next(it, 5)\nprint(x)", "def g(a=[]):\n    a.append(1)\n    return len(a)\nwhile g() < 300000: pass\nprint(5)",
        "def f():\n    n = 0\n    def g():\n        nonlocal n\n        n += 1\n        return n\n    while g() < 300000: pass\n    print(5)\nf()", "a = []\nadd = a.append\ndef f():\n    add(1)\n    return len(a)\nwhile f() < 300000: pass\nprint(5)",
        "s = set()\nwhile len(s) < 300000: s.add(len(s))\nprint(5)", "n = 0\ndef f():\n    global n\n    n += 1\ndef g():\n    while n < 300000: f()\ng()\nprint(5)", "import sys\nprint(5)\nwhile sys.stdin.read(1): pass", "from itertools import count\nc = count()\nwhile next(c) < 300000: pass\nprint(5)",
        "def f(n):\n    while n: return f(n - 1)\nfor _ in range(3000): f(90)\nprint(5)", "x = 0\nwhile True:\n    x += 1\n    if x > 300000: break\nprint(5)", "from functools import lru_cache\n@lru_cache(maxsize=None)\ndef f(x): return [0]\nwhile f(0)[0] < 300000: f(0)[0:] = [f(0)[0] + 1]\nprint(5)",
        "def f(n):\n    while n > 0: n = f(n - 1) or -1\n    return n\nf(900)\nx = [5, 1]\nwhile x[0] < 300000: x = [x[0] + 1, x]\nprint(5)",
    ],
)
def test_programs_that_only_look_as_if_they_repeated_are_run(code):
    box = verify.Sandbox(wall_time_seconds=10.0, cpu_time_seconds=10)
    assert verify.may_repeat(ast.parse(code)) and verify.is_plain(ast.parse(code))
    assert verify.verify_program(code, [{"input": "0" * 300000, "output": "5\n"}], box).status == "AC"


def test_what_catches_exceptions_or_compares_identities_is_not_compared_with_itself():
    for code, may in (("while x is None: pass", True), ("while x is y: pass", False), ("while 1 is True: pass", True), ("while x is 1: pass", False), ("for x in y: pass", False), ("try:\n    while 1: pass\nexcept ValueError: pass", False)):
        assert verify.may_repeat(ast.parse(code)) is may, code


def test_a_server_ends_with_its_owner_and_clears_up():
    code = f"from loomline.operators import verify\nverify.verify_program('x = 1', [{{}}], verify.Sandbox())\ns = verify._server()\nprint(s.process.pid, s.folder, flush=True)\ns.send({{'code': 'import time; time.sleep(1)', 'tests': [{{'test_id': 't', 'input': '', 'output': ''}}], 'whole_seconds': 5, 'plain': False, 'limits': {verify.Sandbox().__dict__!r}}})\nimport os\nos._exit(0)"
    pid, folder = subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout.split()
    until = time.monotonic() + 20
    while (os.path.exists(folder) or os.path.exists(f"/proc/{pid}/exe")) and time.monotonic() < until:
        time.sleep(0.1)
    assert not os.path.exists(folder) and not os.path.exists(f"/proc/{pid}/exe")
