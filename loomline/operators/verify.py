"""The verifier: programs against test cases in a process per program and a forked child per test case.

A task feeds programs to `verify_program`, which never executes anything in the Spark worker itself. Each worker has one server, a process with
only the harness loaded, which forks a process per program; that one compiles the program, then forks a child per test case that has its
own limits, files and guards, so a test case can neither outlive its limit nor touch the next one. Programs that by their syntax tree can
reach nothing but their own names and streams (`is_plain`) first run one after the other in one process that the server keeps for them. What does
not end at once there, or lacks memory, stack or room for its output, is not judged by it: it is run again as any other program. One exception:
a plain program that comes back to the very state it was in before, in the same `while` loop, does the same for ever, so its time limit is sure to
be exceeded and it is a TLE at once (`may_repeat`; the records are those of the limit, but `runtime_ms` is the time it really ran; that a program
reads memory addresses out of texts of its functions is left out of account). The guards are best effort and no security boundary. Times are not
deterministic and stay out of hashes.
"""

from __future__ import annotations

import ast
import builtins
import json
import os
import select
import shutil
import subprocess
import sys
import tempfile
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_code
from .qualify import wrong_answer_category

HARNESS = r"""
import ast, bisect, builtins, collections, functools, gc, heapq, io, itertools, json, math, os, operator, pickle, re, resource, select, shutil, signal, socket, string, subprocess, sys, tempfile, time, types

fork, memfd, low, opened, killpg, sizeof = os.fork, os.memfd_create, os.open, io.open, os.killpg, lambda fd: os.fstat(fd).st_size
jobs, replies, base = os.dup(0), os.dup(1), os.getcwd()
for fd in (0, 1):
    os.dup2(low(os.devnull, os.O_RDWR), fd)
sys.argv = ["<program>"]


def ended(pid, seconds):
    # The status of a child, None if it was killed for being late.
    end = time.monotonic() + seconds
    try:
        watch = os.pidfd_open(pid)
    except OSError:
        watch = None
    try:
        if watch is not None:
            poll = select.poll()
            poll.register(watch, select.POLLIN)
            poll.poll(max(0, seconds) * 1000)
        while True:
            done, status = os.waitpid(pid, os.WNOHANG)
            if done:
                return status
            if time.monotonic() >= end:
                break
            time.sleep(0.002)
    finally:
        if watch is not None:
            os.close(watch)
    os.kill(pid, signal.SIGKILL)
    os.waitpid(pid, 0)
    return None


def guard(root, limit):
    def disabled(*args, **kwargs):
        raise RuntimeError("operation disabled by the sandbox")

    if limit["network_disabled"]:
        for name in ("socket", "create_connection", "getaddrinfo", "gethostbyname"):
            setattr(socket, name, disabled)
    subprocess.Popen = disabled
    for name in dir(os):
        if name == "system" or name.startswith(("fork", "spawn", "exec", "posix_spawn")):
            setattr(os, name, disabled)
    if limit["restricted_filesystem"]:
        allowed = tuple({os.path.realpath(p) for p in (root, sys.prefix, sys.base_prefix)})
        streams = ("/dev/null", "/memfd:stdin (deleted)", "/memfd:stdout (deleted)", "/memfd:stderr (deleted)")  # what /dev/stdin and the like are

        def check(path):
            if not isinstance(path, int):
                p = os.path.realpath(os.fspath(path))
                if p not in streams and not any(p == a or p.startswith(a + os.sep) for a in allowed):
                    raise PermissionError("filesystem restricted by the sandbox: " + str(path))

        def safe(path, *args, **kwargs):
            check(path)
            return opened(path, *args, **kwargs)

        def safe_low(path, *args, **kwargs):
            check(path)
            return low(path, *args, **kwargs)

        builtins.open = io.open = safe
        os.open = safe_low


def child(program, streams, note, limit):
    for fd, stream in enumerate(streams):
        os.dup2(stream, fd)
        os.close(stream)
    sys.stdin = io.TextIOWrapper(io.BufferedReader(io.FileIO(0, closefd=False)), encoding="utf-8", errors="replace")
    sys.stdout = io.TextIOWrapper(io.BufferedWriter(io.FileIO(1, "w", closefd=False)), encoding="utf-8", errors="replace", line_buffering=False)
    sys.stderr = io.TextIOWrapper(io.BufferedWriter(io.FileIO(2, "w", closefd=False)), encoding="utf-8", errors="replace")
    memory = limit["memory_mb"] << 20
    resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
    resource.setrlimit(resource.RLIMIT_CPU, (limit["cpu_time_seconds"], limit["cpu_time_seconds"] + 1))
    size = 4 * limit["output_limit_bytes"] + (1 << 20)
    resource.setrlimit(resource.RLIMIT_FSIZE, (size, size))
    signal.signal(signal.SIGXFSZ, signal.SIG_IGN)
    note = opened(note, "w", encoding="utf-8")
    code, error = 0, None
    try:
        exec(program, {"__name__": "__main__", "__builtins__": builtins})
    except SystemExit as e:
        code = e.code if isinstance(e.code, int) else 0 if e.code is None else 1
    except BaseException as e:
        code, error = 1, [type(e).__name__, str(e)]
    try:
        sys.stdout.flush()
    except BaseException as e:
        code, error = code or 1, error or [type(e).__name__, str(e)]
    json.dump([code, error], note)
    note.close()


def run(program, test, limit, end, report):
    # One test case in a process of its own with memory files as streams; None if the time of the whole program is over.
    streams = [memfd(name) for name in ("stdin", "stdout", "stderr")]
    note = memfd("note")
    try:
        given = memoryview(test["input"].encode())
        while given:
            given = given[os.write(streams[0], given) :]
        os.lseek(streams[0], 0, os.SEEK_SET)
        began = time.monotonic()
        pid = fork()
        if not pid:
            raise Child(program, streams, note, limit, report)
        status = ended(pid, min(limit["wall_time_seconds"], end - began))
        try:
            killpg(pid, signal.SIGKILL)
        except OSError:
            pass
        late, took = status is None, int((time.monotonic() - began) * 1000)
        if late and time.monotonic() >= end:
            return None
        sizes = [sizeof(fd) for fd in streams[1:]]
        text = os.pread(streams[1], limit["output_limit_bytes"] + 1, 0).decode("utf-8", "replace")
        told = os.pread(note, sizeof(note), 0)
        code, error = None, None
        if late or os.WIFSIGNALED(status):
            ending = signal.SIGKILL if late else os.WTERMSIG(status)
            late = late or ending == signal.SIGXCPU or (ending == signal.SIGKILL and took >= 1000 * limit["cpu_time_seconds"])
            code, error = -ending, None if late else ["Signal", str(ending)]
        elif told:
            code, error = json.loads(told)
        else:
            code, error = 1, ["NoReport", "the program left without a report"]
        over = max(sizes) > limit["output_limit_bytes"]
        return {"test_id": test["test_id"], "stdout": text, "exit_code": code, "error": error, "timeout": late, "truncated": over, "runtime_ms": took, "stdout_size": sizes[0], "stderr_size": sizes[1]}
    finally:
        if own == os.getpid():
            for fd in (*streams, note):
                os.close(fd)


def prepared(test, limit):
    # Streams for a test case of a plain program, which from now on has little time.
    out, err = io.BytesIO(), io.BytesIO()
    sys.stdin = io.TextIOWrapper(io.BufferedReader(io.BytesIO(test["input"].encode())), encoding="utf-8", errors="replace")
    sys.stdout = io.TextIOWrapper(io.BufferedWriter(out), encoding="utf-8", errors="replace", line_buffering=False)
    sys.stderr = io.TextIOWrapper(io.BufferedWriter(err), encoding="utf-8", errors="replace")
    signal.setitimer(signal.ITIMER_REAL, min(0.05, limit["wall_time_seconds"] / 4, limit["cpu_time_seconds"] / 4))
    return out, err


def quick(program, test, limit, base, seconds=0):
    # One test case of a plain program in this very process; None if it has to be run on its own, SLOW if it takes more than some CPU seconds.
    # SIGALRM ends this process if it takes long.
    out, err = prepared(test, limit)
    names = {"__name__": "__main__", "__builtins__": builtins}
    began, code, error = time.monotonic(), 0, None
    try:
        try:
            timed(seconds)
            exec(program, names)
        finally:
            timed(0)
    except Slow:
        return SLOW
    except SystemExit as e:
        code = e.code if isinstance(e.code, int) else 0 if e.code is None else 1
    except (MemoryError, RecursionError):
        return None
    except BaseException as e:
        code, error = 1, [type(e).__name__, str(e)]
    sys.stdout.flush()
    names.clear()
    signal.setitimer(signal.ITIMER_REAL, 0)
    sizes, took = [len(out.getvalue()), len(err.getvalue())], int((time.monotonic() - began) * 1000)
    if max(sizes) > limit["output_limit_bytes"] or pages() > base + 1024:
        return None
    return {"test_id": test["test_id"], "stdout": out.getvalue().decode("utf-8", "replace"), "exit_code": code, "error": error, "timeout": False, "truncated": False, "runtime_ms": took, "stdout_size": sizes[0], "stderr_size": sizes[1]}


class Slow(BaseException):
    pass


class Repeated(BaseException):
    pass


class Unfit(BaseException):
    pass


SLOW, clock = object(), 0


def timed(seconds):
    # Slow is raised in the program after so many CPU seconds, never if 0.
    global clock
    clock = seconds
    signal.setitimer(signal.ITIMER_PROF, seconds)


def rang(*_):
    if clock:
        raise Slow


class State(pickle.Pickler):
    # All that a program can reach, byte for byte. What can't be changed, and functions, are named by their addresses; `kept` holds them, so that
    # nothing else gets these. Sets, whose order depends on their past, iterators, caches and numbers that don't equal themselves are refused.
    VALUES = frozenset((type(None), bool, int, str, bytes, tuple, list, dict, range, collections.deque, collections.Counter, collections.OrderedDict, collections.defaultdict))
    FIXED = frozenset((type, types.ModuleType, types.MethodDescriptorType))

    def __init__(self, file, kept):
        super().__init__(file, 5)
        self.kept, self.met = kept, set()

    def persistent_id(self, x):
        kind = type(x)
        if kind in self.VALUES or kind is float and x == x:
            return None
        self.kept.append(x)
        if kind in self.FIXED or id(x) in self.met or any(x is a or x is a.buffer for a in (sys.stdin, sys.stdout, sys.stderr)):
            return "at", id(x)
        self.met.add(id(x))
        if kind is types.FunctionType:
            return "function", id(x), x.__defaults__, x.__kwdefaults__, [c.cell_contents for c in x.__closure__ or ()]
        if kind is types.BuiltinFunctionType:
            return "builtin", x.__name__, x.__self__
        raise Unfit


def state(frame):
    # The state at this frame, and objects that have to live as long as it is compared to others. Who has written is not judged here.
    if sys.stdout.tell() or sys.stderr.tell():
        raise Unfit
    kept, file = [], io.BytesIO()
    own = None if frame.f_locals is frame.f_globals else dict(frame.f_locals)
    State(file, kept).dump((own, frame.f_globals, sys.stdin.tell(), sys.stdin.buffer.tell()))
    return file.getvalue(), kept


loops = {}


def enter(k):
    # Loop k is entered anew: what surrounds it, as the place of a `for` loop, may be another now.
    loops.pop(k, None)


def probe(k):
    # Each pass of loop k compares with a state before; that one is renewed after 1, 2, 4, 8 ... passes, so that no length of the cycle is missed.
    frame = sys._getframe(1)
    now, last = state(frame), loops.get(k)
    if last is None or last[0] is not frame:
        loops[k] = [frame, now, 1, 1]
        return
    if now[0] == last[1][0]:
        raise Repeated
    last[2] -= 1
    if not last[2]:
        last[1:] = now, 2 * last[3], 2 * last[3]


class Probes(ast.NodeTransformer):
    number = 0

    def visit_While(self, loop):
        self.generic_visit(loop)
        self.number += 1
        first, each = (ast.Expr(ast.Call(ast.Name("__" + f.__name__, ast.Load()), [ast.Constant(self.number)], [])) for f in (enter, probe))
        loop.body.insert(0, each)
        return [first, loop]


def probed(code):
    # Plain programs have no names of this kind.
    builtins.__enter, builtins.__probe = enter, probe
    return compile(ast.fix_missing_locations(Probes().visit(ast.parse(code))), "<program>", "exec")


def endless(program, test, limit, base):
    # The record of a test case if the program, with probes, gets into a state that it has been in; else None.
    prepared(test, limit)
    names, repeats, began = {"__name__": "__main__", "__builtins__": builtins}, False, time.monotonic()
    try:
        try:
            timed(0.02)
            exec(program, names)
        finally:
            timed(0)
    except Repeated:
        repeats = True
    except BaseException:
        pass
    signal.setitimer(signal.ITIMER_REAL, 0)
    loops.clear()
    names.clear()
    if not repeats or pages() > base + 1024:
        return None
    ending = signal.SIGKILL if limit["wall_time_seconds"] <= limit["cpu_time_seconds"] else signal.SIGXCPU
    return {"timeout": True, "test_id": test["test_id"], "stdout": "", "exit_code": -ending, "error": None, "truncated": False, "runtime_ms": int((time.monotonic() - began) * 1000), "stdout_size": 0, "stderr_size": 0}


def pages():
    # Of address space, 4 KB each.
    return int(os.pread(space, 100, 0).split()[0])


def write(report, value):
    line = memoryview(json.dumps(value).encode() + b"\n")
    while line:
        line = line[os.write(report, line) :]


def serve(job, program, root, end, report):
    # The test cases of a program, each in a process of its own.
    guard(root, job["limits"])
    for test in job["tests"]:
        told = run(program, test, job["limits"], end, report)
        write(report, {"harness": "harness_timeout"} if told is None else told)
        if told is None:
            return


class Child(BaseException):
    pass


def together(job):
    # The lines of a plain program from the process that runs such programs, and whether they are all.
    global runner
    if runner is None:
        (get, ask), (told, tell) = os.pipe(), os.pipe()
        pid = fork()
        if not pid:
            os.close(ask)
            os.close(told)
            raise Child(opened(get, "rb"), tell)
        os.close(get)
        os.close(tell)
        runner = pid, opened(ask, "wb"), opened(told, "rb")
    pid, ask, told = runner
    try:
        ask.write(json.dumps(job).encode() + b"\n")
        ask.flush()
    except OSError:
        pass
    lines = []
    while (line := told.readline()).endswith(b"\n"):
        if line == b"end\n":
            return lines, True
        lines.append(line[:-1])
    os.waitpid(pid, 0)
    for pipe in (ask, told):
        try:
            pipe.close()
        except OSError:
            pass
    runner = None
    return lines, False


def apart(job, root, end):
    # What the process of a program wrote: its lines, and its status.
    os.mkdir(root, 0o700)
    report = memfd("report")
    try:
        pid = fork()
        if not pid:
            raise Child(job, root, end, report)
        status = ended(pid, max(0, end - time.monotonic()) + 1)
        return os.pread(report, sizeof(report), 0).split(b"\n")[:-1], status
    finally:
        if own == os.getpid():
            os.close(report)
            try:
                os.rmdir(root)
            except OSError:
                shutil.rmtree(root, ignore_errors=True)


def answer(job, root):
    end = time.monotonic() + job["whole_seconds"]
    lines, all_ = together(job) if job["plain"] else ([], False)
    # Test cases known to be endless take what they would have taken of the time of the whole program.
    known = sum(line.startswith(b'{"timeout"') for line in lines)
    end -= known * min(job["limits"]["wall_time_seconds"], job["limits"]["cpu_time_seconds"])
    if known and time.monotonic() >= end:
        return b'{"harness": "harness_timeout"}'
    if not all_:
        more, status = apart(job | {"tests": job["tests"][len(lines) :]}, root, end)
        if status != 0:
            return b'{"harness": "harness_timeout"}' if status is None else b'{"harness": "missing_result"}'
        lines += more
    if lines and lines[-1].startswith((b'{"harness"', b'{"compile_error"')):
        return lines[-1]
    return b'{"runs": [' + b", ".join(lines) + b"]}"


# Programs run two frames below this one, wherever they are started from.
gc.collect()
gc.freeze()
own, runner, source, sink = os.getpid(), None, opened(jobs, "rb"), opened(replies, "wb")
try:
    for n, line in enumerate(source):
        try:
            sink.write(answer(json.loads(line), os.path.join(base, str(n))) + b"\n")
            sink.flush()
            continue
        except Child as e:
            given = e.args
        try:
            own = os.getpid()
            os.close(jobs)
            os.close(replies)
            if len(given) == 2:
                plain, report = given
                os.setpgid(0, 0)
                space = low("/proc/self/statm", os.O_RDONLY)
                signal.signal(signal.SIGPROF, rang)
                first = pages()
                for line in plain:
                    job, probes = json.loads(line), None
                    resource.setrlimit(resource.RLIMIT_AS, (job["limits"]["memory_mb"] << 20, resource.getrlimit(resource.RLIMIT_AS)[1]))
                    signal.setitimer(signal.ITIMER_REAL, 0.2)
                    try:
                        program = compile(job["code"], "<program>", "exec")
                    except BaseException:
                        os._exit(1)
                    for test in job["tests"]:
                        told = quick(program, test, job["limits"], first, 0.002 if job["may_repeat"] else 0)
                        if told is SLOW:
                            try:
                                probes = probes or probed(job["code"])
                            except BaseException:
                                os._exit(1)
                            told = endless(probes, test, job["limits"], first) or quick(program, test, job["limits"], first)
                        if told is None:
                            os._exit(1)
                        write(report, told)
                    signal.setitimer(signal.ITIMER_REAL, 0)
                    os.write(report, b"end\n")
                os._exit(0)
            if runner is not None:
                for pipe in runner[1:]:
                    os.close(pipe.fileno())
            job, root, end, report = given
            os.setsid()
            try:
                program = compile(job["code"], "<program>", "exec")
            except BaseException as e:
                write(report, {"compile_error": [type(e).__name__, str(e)]})
                os._exit(0)
            os.chdir(root)
            os.environ["HOME"] = os.environ["TMPDIR"] = root
            try:
                serve(job, program, root, end, report)
                os._exit(0)
            except Child as e:
                program, streams, note, limit, report = e.args
            try:
                os.setpgid(0, 0)
                os.close(report)
                child(program, streams, note, limit)
            finally:
                os._exit(0)
        finally:
            os._exit(1)
finally:
    shutil.rmtree(base, ignore_errors=True)
"""


@dataclass(frozen=True)
class Sandbox:
    """Limits of a run; the whole of a program's test cases has a limit of its own, see `whole_seconds`."""

    wall_time_seconds: float = 2.0
    cpu_time_seconds: int = 2
    memory_mb: int = 1024
    output_limit_bytes: int = 1_000_000
    network_disabled: bool = True
    restricted_filesystem: bool = True
    backend: str = "local"

    def whole_seconds(self, tests: int) -> float:
        return max(1.0, min(self.wall_time_seconds * max(1, tests) + 5.0, 60.0))


@dataclass
class Verdict:
    status: str
    passed: int
    total: int
    runs: list[dict] = field(default_factory=list)
    error_type: str | None = None
    error_message: str | None = None

    @property
    def pass_rate(self) -> float:
        return self.passed / self.total if self.total else 0.0


def lines_of(output: str) -> str:
    """An output without blanks at line ends and empty lines at the end, with LF line ends."""
    return "\n".join(x.rstrip(" \t") for x in output.replace("\r\n", "\n").replace("\r", "\n").split("\n")).rstrip("\n")


def run_verdict(run: dict, expected: str) -> str:
    if run["timeout"]:
        return "TLE"
    if run["truncated"] or run["exit_code"] not in (0, None) or run["error"]:
        return "RE"
    return "AC" if lines_of(run["stdout"]) == lines_of(expected) else "WA"


def roll_up(statuses: list[str]) -> str:
    """TLE before RE before WA; nothing to run is accepted."""
    return next((s for s in ("TLE", "RE", "WA") if s in statuses), "AC")


class _Server:
    """A process that has only the harness loaded and forks one process per program; it never executes any program itself and ends with its owner."""

    def __init__(self):
        self.folder = folder = tempfile.mkdtemp(prefix="loomline-verify-")
        env = {"PATH": os.environ.get("PATH", ""), "HOME": folder, "TMPDIR": folder, "LANG": "C.UTF-8", "PYTHONHASHSEED": "0", "PYTHONIOENCODING": "utf-8"}
        self.owner = os.getpid()
        self.process = subprocess.Popen([sys.executable, "-B", "-c", HARNESS], cwd=folder, env=env, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0, start_new_session=True)

    def send(self, job: dict) -> None:
        left = memoryview(json.dumps(job).encode() + b"\n")
        while left:
            left = left[self.process.stdin.write(left) :]

    def reply(self, seconds: float) -> dict:
        end, parts, poll = time.monotonic() + seconds, [], select.poll()
        poll.register(self.process.stdout, select.POLLIN)
        while not parts or not parts[-1].endswith(b"\n"):
            if not poll.poll(max(0.0, end - time.monotonic()) * 1000):
                self.stop()
                return {"harness": "harness_timeout"}
            parts.append(self.process.stdout.read(1 << 20))
            if not parts[-1]:
                self.stop()
                return {"harness": "missing_result"}
        return json.loads(b"".join(parts))

    def stop(self) -> None:
        self.owner = None
        self.process.kill()
        self.process.communicate()
        shutil.rmtree(self.folder, ignore_errors=True)


_LOCAL = threading.local()


def _server() -> _Server:
    """The thread's server, a new one after a fork and if it has ended."""
    found = getattr(_LOCAL, "server", None)
    if found is not None and found.owner == os.getpid() and found.process.poll() is not None:
        found.stop()
    if found is None or found.owner != os.getpid():
        found = _LOCAL.server = _Server()
    return found


# What a plain program may use: it can neither change nor tell anything outside its own names and its streams, so its test cases may share a process.
_NODES = frozenset(
    getattr(ast, n)
    for n in """Module Expr Assign AugAssign AnnAssign Name Constant Load Store Del Delete For While If IfExp Break Continue Pass FunctionDef Return arguments arg keyword Lambda Call Attribute Subscript Slice
    Starred List Tuple Set Dict ListComp SetComp DictComp GeneratorExp comprehension BoolOp BinOp UnaryOp Compare NamedExpr JoinedStr FormattedValue Import ImportFrom alias Global Nonlocal Raise Assert Try
    ExceptHandler""".split()
) | {kind for base in (ast.boolop, ast.operator, ast.unaryop, ast.cmpop) for kind in base.__subclasses__()}
_BUILTINS = frozenset(
    """abs all any ascii bin bool bytes chr complex dict divmod enumerate filter float frozenset hex input int isinstance iter len list map max min next oct ord pow print range repr reversed round set slice
    sorted str sum tuple zip ArithmeticError AssertionError AttributeError EOFError Exception IndexError KeyError LookupError NameError NotImplementedError OverflowError RuntimeError StopIteration SystemExit
    TypeError UnicodeDecodeError UnicodeError ValueError ZeroDivisionError""".split()
)
_FOREIGN = frozenset(dir(builtins)) - _BUILTINS - {"__name__"}
_MODULES = {
    "sys": "stdin stdout stderr exit maxsize", "math": "ceil comb cos dist exp fabs factorial floor fmod fsum gcd hypot inf isclose isinf isnan isqrt lcm log log10 log2 nan perm pi pow prod sin sqrt tan trunc",
    "heapq": "heapify heappop heappush heappushpop heapreplace merge nlargest nsmallest", "bisect": "bisect bisect_left bisect_right insort insort_left insort_right", "collections": "Counter OrderedDict defaultdict deque",
    "itertools": "accumulate chain combinations combinations_with_replacement compress count cycle dropwhile filterfalse groupby islice pairwise permutations product repeat starmap takewhile zip_longest",
    "functools": "cache cmp_to_key lru_cache partial reduce", "string": "ascii_letters ascii_lowercase ascii_uppercase digits hexdigits punctuation",
}
_ATTRIBUTES = frozenset(
    """add append appendleft bit_count bit_length buffer capitalize casefold center clear copy count decode difference difference_update discard elements encode endswith expandtabs extend extendleft find fromkeys
    from_iterable get index insert intersection intersection_update isalnum isalpha isdecimal isdigit isdisjoint islower isnumeric isspace issubset issuperset istitle isupper items join keys ljust lower lstrip
    maketrans most_common move_to_end partition pop popitem popleft read readline readlines remove replace reverse rfind rindex rjust rotate rpartition rsplit rstrip setdefault sort split splitlines startswith
    strip subtract swapcase symmetric_difference symmetric_difference_update title translate union update upper values write writelines zfill""".split()
) | {n for names in _MODULES.values() for n in names.split()}
_IMPORTS = {module: frozenset(names.split()) for module, names in _MODULES.items()}


def is_plain(tree: ast.AST) -> bool:
    """Whether a program is made of nothing but the nodes, builtins, modules and attributes above; attributes are only read, classes and generator functions left out."""
    for x in ast.walk(tree):
        if type(x) not in _NODES:
            return False
        if isinstance(x, ast.Name):
            if x.id in _FOREIGN or x.id.startswith("__") and x.id != "__name__":
                return False
        elif isinstance(x, ast.Attribute):
            if x.attr not in _ATTRIBUTES or not isinstance(x.ctx, ast.Load):
                return False
        elif isinstance(x, ast.Import):
            if any(a.name not in _IMPORTS for a in x.names):
                return False
        elif isinstance(x, ast.ImportFrom):
            if x.level or x.module not in _IMPORTS or any(a.name not in _IMPORTS[x.module] for a in x.names):
                return False
        elif isinstance(x, (ast.FunctionDef, ast.arg, ast.alias, ast.ExceptHandler, ast.Global, ast.Nonlocal)):
            named = getattr(x, "names", None) or [getattr(x, "name", None) or getattr(x, "arg", None), getattr(x, "asname", None)]
            if any(n and n.startswith("__") for n in named):
                return False
    return True


def may_repeat(tree: ast.AST) -> bool:
    """Whether a plain program has a `while` loop whose states may be compared: it catches nothing, so a probe that fails ends it, and tells no equal objects apart."""
    loops = False
    for x in ast.walk(tree):
        if isinstance(x, ast.Try):
            return False
        if isinstance(x, ast.Compare) and any(isinstance(op, (ast.Is, ast.IsNot)) and not (isinstance(y, ast.Constant) and any(y.value is v for v in (None, True, False))) for op, y in zip(x.ops, x.comparators)):
            return False
        loops = loops or isinstance(x, ast.While)
    return loops


def _sandboxed(code: str, tests: list[dict], sandbox: Sandbox, plain: bool, repeats: bool = False) -> dict:
    whole = sandbox.whole_seconds(len(tests))
    limits = {k: getattr(sandbox, k) for k in ("wall_time_seconds", "cpu_time_seconds", "memory_mb", "output_limit_bytes", "network_disabled", "restricted_filesystem")}
    job = {"code": code, "tests": tests, "limits": limits, "whole_seconds": whole, "plain": plain, "may_repeat": repeats}
    server = _server()
    try:
        server.send(job)
    except BrokenPipeError:  # it was killed just now
        server.stop()
        server = _server()
        server.send(job)
    return server.reply(whole + 10)


def verify_program(code: str, tests: list[dict] | None, sandbox: Sandbox = Sandbox()) -> Verdict:
    """CE, TLE, RE, WA or AC of a program; a test case without id is case_<index>, null input and output read as empty."""
    if sandbox.backend != "local":
        raise ValueError(f"unknown sandbox backend {sandbox.backend!r}")
    cases = [{"test_id": t.get("test_id") or f"case_{k:04d}", "input": t.get("input") or "", "output": t.get("output") or ""} for k, t in enumerate(tests or [])]
    try:
        tree = ast.parse(code)
        plain = is_plain(tree)
        repeats = plain and may_repeat(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return Verdict("CE", 0, len(cases), [], type(e).__name__, str(e))
    result = _sandboxed(code, cases, sandbox, plain, repeats)
    if "compile_error" in result:
        return Verdict("CE", 0, len(cases), [], *result["compile_error"])
    if "harness" in result:
        return Verdict("TLE" if result["harness"] == "harness_timeout" else "RE", 0, len(cases), [], result["harness"], "the sandbox gave no complete result")
    runs = []
    for run, case in zip(result["runs"], cases):
        status = run_verdict(run, case["output"])
        alike = status == "WA" and run["stdout"].split() == case["output"].split()
        error = run["error"] or (["OutputLimitExceeded", "output limit exceeded"] if run["truncated"] else [None, None])
        runs.append({**{k: run[k] for k in ("test_id", "exit_code", "runtime_ms", "stdout", "stdout_size", "stderr_size")}, "status": status, "token_equal": alike, "error_type": error[0], "error_message": error[1]})
    seen = {r["test_id"] for r in runs}
    for case in cases:
        if case["test_id"] not in seen:
            runs.append({"test_id": case["test_id"], "exit_code": None, "runtime_ms": 0, "stdout": "", "stdout_size": 0, "stderr_size": 0, "status": "TLE", "token_equal": False, "error_type": "HarnessStoppedEarly", "error_message": "not run"})
    status = roll_up([r["status"] for r in runs])
    first = next((r for r in runs if r["status"] == status), None) if status != "AC" else None
    return Verdict(status, sum(r["status"] == "AC" for r in runs), len(cases), runs, first and first["error_type"], first and first["error_message"])


RUN = "struct<test_id:string,status:string,token_equal:boolean,exit_code:int,runtime_ms:long,error_type:string,error_message:string>"
VERDICT = f"status string, passed int, total int, pass_rate double, error_type string, error_message string, runs array<{RUN}>"


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Many partitions by key: programs are small rows of long work, which size-based coalescing would put into one task."""
    spark = df.sparkSession
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(partitions or least, key)


def verify_codes(df: DataFrame, code: str = "code", tests: str = "tests", sandbox: Sandbox = Sandbox(), key: str = "problem_id", partitions: int | None = None) -> DataFrame:
    """df with the verdict's columns; rows are spread over many small partitions by key, as run times differ widely."""
    kept = df.columns
    clash = {"status", "passed", "total", "pass_rate", "error_type", "error_message", "runs"} & set(kept)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are already there")
    rows = spread(df, key, partitions)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + VERDICT
    run_type = pa.struct([("test_id", pa.string()), ("status", pa.string()), ("token_equal", pa.bool_()), ("exit_code", pa.int32()), ("runtime_ms", pa.int64()), ("error_type", pa.string()), ("error_message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verify_program(c or "", t, sandbox) for c, t in zip(batch.column(code).to_pylist(), batch.column(tests).to_pylist())]
            runs = [[{k: r[k] for k in ("test_id", "status", "token_equal", "exit_code", "runtime_ms", "error_type", "error_message")} for r in v.runs] for v in found]
            columns = [
                pa.array([v.status for v in found], pa.string()), pa.array([v.passed for v in found], pa.int32()), pa.array([v.total for v in found], pa.int32()),
                pa.array([v.pass_rate for v in found], pa.float64()), pa.array([v.error_type for v in found], pa.string()), pa.array([v.error_message for v in found], pa.string()),
                pa.array(runs, pa.list_(run_type)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, "status", "passed", "total", "pass_rate", "error_type", "error_message", "runs"])

    return rows.mapInArrow(run, out_schema)


def verify_responses(df: DataFrame, response: str, tests: str, sandbox: Sandbox = Sandbox(), key: str = "problem_id") -> DataFrame:
    """Extract the code of each response, then verify it; adds `code`, `strategy` and the verdict's columns."""
    rows = df.withColumn("_code", extract_code(response))
    rows = rows.withColumns({"code": F.coalesce("_code.code", F.lit("")), "strategy": F.coalesce("_code.strategy", F.lit("empty"))}).drop("_code")
    return verify_codes(rows, "code", tests, sandbox, key)


def attempts(df: DataFrame, solutions: str, tests: str, sandbox: Sandbox = Sandbox(), most: int = 3, slow: Sandbox | None = None, key: str = "problem_id") -> DataFrame:
    """(key, attempts): up to `most` solutions of a problem, stopping at the first accepted one; a timeout may be run again with `slow`."""
    schema = f"`{key}` string, attempts array<struct<attempt_index:int,status:string,passed:int,total:int,pass_rate:double,first_failure:string,slow_status:string>>"
    kind = pa.list_(pa.struct([("attempt_index", pa.int32()), ("status", pa.string()), ("passed", pa.int32()), ("total", pa.int32()), ("pass_rate", pa.float64()), ("first_failure", pa.string()), ("slow_status", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, cases in zip(batch.column(solutions).to_pylist(), batch.column(tests).to_pylist()):
                tried = []
                for k, code in enumerate((codes or [])[:most], 1):
                    v = verify_program(code or "", cases, sandbox)
                    failure = next((r["test_id"] for r in v.runs if r["status"] == v.status and v.status != "AC"), None)
                    again = verify_program(code or "", cases, slow).status if slow and v.status == "TLE" else None
                    tried.append({"attempt_index": k, "status": v.status, "passed": v.passed, "total": v.total, "pass_rate": v.pass_rate, "first_failure": failure, "slow_status": again})
                    if v.status == "AC":
                        break
                out.append(tried)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, kind)], names=[key, "attempts"])

    return spread(df.select(key, solutions, tests), key).mapInArrow(run, schema)


def first_failure(status: Column, runs: Column) -> Column:
    """The first run with the verdict's own status, else the first that is not accepted; null for an accepted program."""
    same, any_ = F.filter(runs, lambda r: r["status"] == status), F.filter(runs, lambda r: r["status"] != "AC")
    return F.when(status != "AC", F.coalesce(F.get(same, F.lit(0)), F.get(any_, F.lit(0))))


def diagnosed(df: DataFrame, sandbox: Sandbox = Sandbox(), key: str = "problem_id") -> DataFrame:
    """df (key, code, tests, prompt) with the verdict's columns, `failure_class`, `first_failure` (a test_id) and, of wrong answers, `wa_category`."""
    out = verify_codes(df, sandbox=sandbox, key=key)
    wrong = F.filter("runs", lambda r: r["status"] == "WA")
    category = wrong_answer_category(F.size(wrong), F.size(F.filter(wrong, lambda r: r["token_equal"])), "prompt")
    return out.withColumns(
        {
            "failure_class": failure_class(F.col("status"), F.col("error_type"), F.col("error_message")), "first_failure": first_failure(F.col("status"), F.col("runs"))["test_id"],
            "wa_category": F.when(F.col("status") == "WA", category),
        }
    )


def failure_class(status: Column, error_type: Column, error_message: Column) -> Column:
    """The class of a failure by verdict and error text."""
    text = F.concat_ws(" ", error_type, error_message)

    def says(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | text.contains(p)
        return out

    return (
        F.when(status == "AC", "accepted").when(status == "CE", "bad_reference_solution_or_extraction").when(status == "TLE", "timeout_or_resource_limit")
        .when(status == "WA", "wrong_output_source_data_or_judging_mismatch")
        .when(says("ModuleNotFoundError", "ImportError", "No module named"), "unsupported_dependency")
        .when(says("filesystem restricted", "PermissionError", "FileNotFoundError"), "unsupported_filesystem_io")
        .when(says("operation disabled", "network"), "unsupported_process_or_network_use")
        .when(says("EOFError", "invalid literal", "not enough values", "IndexError"), "unsupported_io_format_or_bad_test_input")
        .otherwise("runtime_error_requires_inspection")
    )
