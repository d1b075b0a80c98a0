"""Runs candidate programs, each in a forked process of its own.

The source of this module is handed to a child interpreter, which loads the preset
names once and then reads one JSON task a line; the fork that runs a program has a
memory limit, a timer for each test and nothing of the server's pipes, so that a
program that fails, hangs or exits takes no other with it.  The array libraries,
which make a start and every fork several times dearer, are loaded for the first
program whose text names them; until then their names stand for them."""

import io
import json
import os
import re
import resource
import select
import signal
import sys
import time
import traceback
import types
from decimal import Decimal, InvalidOperation

TOLERANCE = 1e-3

# What programs may use without importing it.
PRESET = """
from itertools import accumulate, chain, combinations, count, permutations, product, groupby, islice, repeat
from copy import deepcopy
from string import ascii_lowercase, ascii_uppercase
from math import floor, log2, log10, sqrt, comb, gcd, ceil, inf, isqrt, factorial, atan2, pi
from collections import defaultdict, deque, Counter
from bisect import bisect, bisect_left, bisect_right, insort
from heapq import heappush, heappop, heapify, merge, nlargest, nsmallest, heapreplace
from functools import reduce, cache, lru_cache, cmp_to_key, reduce
from random import randrange, shuffle
from operator import itemgetter, sub, xor, or_
from re import search as re_search
from os.path import commonprefix
from typing import List, Tuple, Dict, Set, Optional, Union, Any, Callable, Iterable, Iterator, Generator, Deque
import copy
import string
import math
import collections
import bisect
import heapq
import functools
import random
import itertools
import operator
import re
import datetime
from time import time
from math import log, prod
from collections import deque, defaultdict, Counter, OrderedDict
from itertools import accumulate, permutations, combinations, product, groupby, islice, chain, repeat, zip_longest, cycle, pairwise
from functools import lru_cache, reduce, partial
from operator import iand
import sys
import io, os
"""
# The preset names of the array libraries, and their modules.
ARRAYS = {"np": "numpy", "pd": "pandas"}
_NAMED = re.compile(r"\b(?:np|pd|numpy|pandas)\b")


# --- comparing ---------------------------------------------------------------


def token_lines(text):
    """The tokens of every line that isn't blank."""
    return [line.split() for line in text.strip().splitlines() if line.strip()]


def close_numbers(a, b):
    """Tokens that are all numbers, as many, none further apart than the tolerance."""
    if not a or len(a) != len(b):
        return False
    try:
        return all(abs(Decimal(x) - Decimal(y)) <= Decimal(TOLERANCE) for x, y in zip(a, b))
    except (InvalidOperation, ValueError):
        return False


def outputs_match(expected, actual):
    """What a program printed against what it should have: one pair of quotes around
    the expectation is taken off; white space around lines and tokens and blank
    lines don't count, nor do small differences of numbers or the case of a
    boolean."""
    want, got = expected.strip(), actual.strip()
    if want.startswith('"') and want.endswith('"'):
        want = want[1:-1]
    a, b = token_lines(want), token_lines(got)
    if got == want.strip() or a == b or close_numbers(sum(a, []), sum(b, [])):
        return True
    return got.lower() == want.lower() and got.lower() in ("true", "false")


def results_match(expected, value):
    """A function's result against JSON text: equal, or equal to the first entry of a
    list; tuples are lists at the top and one level below. Against other text, as
    text."""
    try:
        want = json.loads(expected)
    except (ValueError, TypeError):
        return str(value) == expected.strip()
    if isinstance(value, tuple):
        value = list(value)
    forms = [value]
    if isinstance(value, list) and value and isinstance(value[0], tuple):
        try:
            forms.append([list(x) for x in value])
        except TypeError:
            pass
    wanted = [want, want[0]] if isinstance(want, list) and want else [want]
    return any(bool(f == w) for f in forms for w in wanted)


# --- running -----------------------------------------------------------------


class Late(BaseException):
    pass


def _late(*_):
    raise Late()


def _no_exit(code=0):
    raise SystemExit(code)


def _timed(seconds, call):
    """(state, value): ok, late or error."""
    if seconds:
        signal.signal(signal.SIGALRM, _late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return "ok", call()
    except Late:
        return "late", None
    except (Exception, SystemExit):
        return "error", None
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)


def _printed(code, scope, text):
    """What a script prints on an input; an exit ends it as it is."""
    out = io.StringIO()
    old = sys.stdin, sys.stdout, sys.stderr
    sys.stdin, sys.stdout, sys.stderr = io.StringIO(text), out, io.StringIO()
    try:
        exec(code, dict(scope, __name__="__main__"))
    except SystemExit:
        pass
    finally:
        sys.stdin, sys.stdout, sys.stderr = old
    return out.getvalue()


def scored(task, preset):
    """Passed, total and the indices of the tests that were late. A function is
    called on a new instance for each test; a program without it is a script."""
    os._exit = _no_exit
    code = compile(task["code"], "<candidate>", "exec")
    inputs, outputs, name = task["inputs"], task["outputs"], task["fn_name"]
    scope = None
    if name:
        scope = dict(preset, __name__="__solution__")
        exec(code, scope)
        if "Solution" not in scope and name not in scope:
            scope = None
    passed, late = 0, []
    for i, (text, want) in enumerate(zip(inputs, outputs)):
        if scope is not None:

            def call(text=text):
                args = [eval(line, {}) for line in text.split("\n")]
                holder = scope["Solution"]() if "Solution" in scope else None
                return getattr(holder, name)(*args) if holder is not None else scope[name](*args)

        else:

            def call(text=text):
                return _printed(code, preset, text)

        state, value = _timed(task["seconds"], call)
        if state == "late":
            late.append(i)
        elif state == "ok":
            passed += bool(results_match(want, value) if scope is not None else outputs_match(want, value))
    return {"passed": passed, "total": len(inputs), "late": late}


def shown(task, preset):
    """A snippet by itself: whether it ended well, its output and its errors."""
    out, err, ok = io.StringIO(), io.StringIO(), True
    sys.stdin, sys.stdout, sys.stderr = io.StringIO(), out, err
    os._exit = _no_exit
    try:
        exec(compile(task["code"], "<interact>", "exec"), dict(preset, __name__="__main__"))
    except SystemExit as e:
        ok = e.code in (None, 0)
        if not (ok or isinstance(e.code, int)):
            err.write(f"{e.code}\n")
    except BaseException:
        ok = False
        kind, value, trace = sys.exc_info()
        err.write("".join(traceback.format_exception(kind, value, trace.tb_next)))
    return {"ok": ok, "stdout": out.getvalue(), "stderr": err.getvalue()}


def forked(task, preset):
    """The result of a task's fork, or null if it failed or took too long as a whole."""
    read, write = os.pipe()
    child = os.fork()
    if not child:
        leave = os._exit
        try:
            os.setsid()
            os.close(read)
            null = os.open(os.devnull, os.O_RDWR)
            for stream in (0, 1, 2):
                os.dup2(null, stream)
            resource.setrlimit(resource.RLIMIT_AS, (task["memory"], task["memory"]))
            sys.stdin, sys.stdout, sys.stderr = io.StringIO(), io.StringIO(), io.StringIO()
            result = (scored if task["kind"] == "tests" else shown)(task, preset)
            data = json.dumps(result).encode()
            while data:
                data = data[os.write(write, data) :]
        finally:
            leave(0)
    os.close(write)
    data, end = b"", time.monotonic() + task["overall"]
    while True:
        left = end - time.monotonic()
        ready = left > 0 and select.select([read], [], [], left)[0]
        part = os.read(read, 1 << 16) if ready else b""
        if not part:
            break
        data += part
    timed_out = not ready
    try:
        os.killpg(child, signal.SIGKILL)
    except (ProcessLookupError, PermissionError):
        pass
    os.close(read)
    os.waitpid(child, 0)
    try:
        return json.loads(data)
    except ValueError:
        return {"timed_out": True} if timed_out else None


# --- a process for each test -------------------------------------------------

#: Bytes that a test may print; more is wrong.
PRINTED = 64 << 20


def stdout_matches(expected, printed):
    """Equal but for white space around lines and tokens and blank lines, or tokens
    that are numbers and close."""
    a, b = token_lines(expected), token_lines(printed)
    return expected.strip() == printed.strip() or a == b or close_numbers(sum(a, []), sum(b, []))


def value_matches(expected, printed):
    """What a function's wrapper printed, a JSON object alone, against JSON text:
    the result equals it, or the first entry of a list."""
    try:
        got, want = json.loads(printed.strip()), json.loads(expected)
        return bool(got.get("success")) and (got["result"] == want or isinstance(want, list) and got["result"] == want[0])
    except (ValueError, KeyError, IndexError, AttributeError, TypeError, RecursionError):
        return False


def _dies_with_parent():
    try:
        import ctypes

        ctypes.CDLL(None).prctl(1, signal.SIGKILL)
    except (AttributeError, OSError):  # not on this system; the timer ends it
        pass


def _case(task, preset, text):
    """Runs a program on one test, as a script of its own."""
    scope = dict(preset, __name__="__main__")
    exec(compile(task["code"], "<candidate>", "exec"), scope)
    name = task["fn_name"]
    if name:
        try:
            holder = scope["Solution"]() if "Solution" in scope else None
            call = getattr(holder, name) if holder is not None else scope[name]
            shown = json.dumps({"success": True, "result": call(*text)})
        except Exception as e:
            shown = json.dumps({"success": False, "error": repr(e)})
        print(shown)


def case_forked(task, preset, text):
    """(pid, where its output is read) of a test's process."""
    given = os.memfd_create("given")
    if isinstance(text, str):
        os.write(given, text.encode())
        os.lseek(given, 0, 0)
    read, write = os.pipe()
    try:
        pid = os.fork()
    except OSError:
        for fd in (given, read, write):
            os.close(fd)
        raise
    if pid:
        os.close(write)
        os.close(given)
        return pid, read
    leave, code = os._exit, 1
    try:
        os.setsid()
        _dies_with_parent()
        signal.setitimer(signal.ITIMER_REAL, task["seconds"] + 5)
        null = os.open(os.devnull, os.O_RDWR)
        os.dup2(given, 0), os.dup2(write, 1), os.dup2(null, 2)
        os.closerange(3, 1024)
        resource.setrlimit(resource.RLIMIT_AS, (task["memory"], task["memory"]))
        sys.stdin, sys.stdout, sys.stderr = open(0, closefd=False), open(1, "w", closefd=False), open(2, "w", closefd=False)
        try:
            _case(task, preset, text)
            code = 0
        except SystemExit as e:
            code = e.code if isinstance(e.code, int) else int(e.code is not None)
        sys.stdout.flush()
    finally:
        leave(code & 255)


def literals(text):
    """Arguments from lines of literals; None if they are anything else."""
    import ast

    try:
        return [ast.literal_eval(line) for line in text.split("\n")]
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def cases(task, preset, send):
    """Runs the tests, so many processes at a time, and sends each one's verdict as
    it ends: true, false (wrong, failed or late) or null, if no process could be
    made for it."""
    name, seconds = task["fn_name"], task["seconds"]
    given = [literals(x) if name else x for x in task["inputs"]]
    if any(x is None for x in given):
        send({"error": "inputs"})
        return
    waiting, running = list(range(len(given)))[::-1], {}
    poll = select.poll()
    while waiting or running:
        while waiting and len(running) < task["parallel"]:
            i = waiting.pop()
            try:
                pid, fd = case_forked(task, preset, given[i])
            except OSError as e:
                if running:  # one that ends makes room
                    waiting.append(i)
                    break
                send({"test": i, "verdict": None, "late": False, "ms": 0, "error": f"fork: {e.strerror}"})
                continue
            poll.register(fd, select.POLLIN | select.POLLHUP)
            running[fd] = [i, pid, time.monotonic(), bytearray()]
        if not running:
            continue
        left = min(r[2] for r in running.values()) + seconds - time.monotonic()
        ready = [fd for fd, _ in poll.poll(max(left, 0) * 1000 + 1)]
        now = time.monotonic()
        for fd, (i, pid, began, data) in list(running.items()):
            part = os.read(fd, 1 << 16) if fd in ready else None
            late = part != b"" and now - began >= seconds
            if part:
                data += part
            if part == b"" or late or len(data) > PRINTED:
                poll.unregister(fd)
                os.close(fd)
                del running[fd]
                status = _ended(pid, None if late or part else began + seconds)
                late = late or status is None
                try:
                    printed = data.decode()
                    ok = not late and part == b"" and status == 0 and (value_matches if name else stdout_matches)(task["outputs"][i], printed)
                except UnicodeDecodeError:
                    ok = False
                send({"test": i, "verdict": bool(ok), "late": late, "ms": round(1000 * (time.monotonic() - began)), "error": None})


def _ended(pid, until):
    """A process's exit code, once it and its group are gone; None if it hadn't
    ended by *until* (one that closes its output may go on)."""
    while until is not None and time.monotonic() < until:
        done, status = os.waitpid(pid, os.WNOHANG)
        if done:
            _kill_group(pid)
            return os.waitstatus_to_exitcode(status)
        time.sleep(0.001)
    _kill_group(pid)
    os.waitpid(pid, 0)
    return None


def _kill_group(pid):
    try:
        os.killpg(pid, signal.SIGKILL)
    except (ProcessLookupError, PermissionError):
        pass


class Later(types.ModuleType):
    """A module by name, loaded when something of it is asked for."""

    def __getattr__(self, name):
        return getattr(__import__(self.__name__), name)


def preset_names():
    preset = {}
    exec(PRESET, preset)
    return {**preset, **{k: Later(m) for k, m in ARRAYS.items()}}


def with_arrays(preset, code):
    """Loads the array libraries, once, if a program's text names one."""
    if isinstance(preset["np"], Later) and _NAMED.search(code):
        preset.update({k: __import__(m) for k, m in ARRAYS.items()})


def serve():
    preset = preset_names()
    results = os.fdopen(os.dup(1), "w")

    def send(x):
        results.write(json.dumps(x) + "\n")
        results.flush()

    for line in sys.stdin:
        task = json.loads(line)
        with_arrays(preset, task["code"])
        if task["kind"] == "cases":
            cases(task, preset, send)
            send({"done": True})
        else:
            send(forked(task, preset))


if __name__ == "__main__":
    serve()
