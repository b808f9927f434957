"""Golden tests of commands: a file says what to run and what must come out.

Lines: #command WORDS, #stdin, #infile NAME, #stdout, #stderr, #outfile NAME, #status N, #nonewline, and "# " comments; what follows a
section line is its text. $TMP in a command is a fresh folder with the input files. A #stdout or #stderr with words after it expects
a matcher of the text (glob, infix, regex, prefix, suffix, exact, empty) instead of the text itself.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import shlex
import tempfile
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession


def parse(text: str) -> dict:
    """The parts of a golden test."""
    out: dict = {"command": [], "stdin": "", "infile": {}, "outfile": {}, "stdout": "", "stderr": None, "status": 0}
    where, lines = None, []

    def close() -> None:
        if where is None:
            return
        kind, name, newline = where
        body = "\n".join(lines) + ("\n" if lines and newline else "")
        if kind in ("infile", "outfile"):
            out[kind][name] = body
        elif not (kind in ("stdout", "stderr") and name):
            out[kind] = body

    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        m = re.match(r"#(command|stdin|infile|outfile|stdout|stderr|status|nonewline)(?: (.*))?$", line)
        if line.startswith("# "):
            continue
        if not m:
            lines.append(line)
            continue
        kind, rest = m[1], m[2] or ""
        if kind == "nonewline":
            where = (*where[:2], False) if where else None
            continue
        close()
        where, lines = None, []
        if kind == "command":
            out["command"] = shlex.split(rest)
        elif kind == "status":
            out["status"] = int(rest)
        else:
            where = (kind, rest, True)
            if kind in ("stdout", "stderr") and rest:
                out[kind] = ("matcher", rest)
    close()
    return out


def matches(spec: str, text: str) -> bool:
    head, _, pattern = spec.partition(",")
    method, *mods = head.split(".")
    text = text.rstrip("\n")
    if "case" in mods:
        text, pattern = text.lower(), pattern.lower()
    found = {"glob": lambda: fnmatchcase(text, pattern), "infix": lambda: pattern in text, "prefix": lambda: text.startswith(pattern), "suffix": lambda: text.endswith(pattern), "exact": lambda: text == pattern, "empty": lambda: not text}
    ok = found.get(method, lambda: re.search(pattern if method in ("regex", "") else spec, text) is not None)()
    return not ok if "not" in mods else ok


def check(text: str, spark: SparkSession) -> list[str]:
    """What differs from what a golden test expects; nothing if it passes."""
    from colsmith.cli import main

    test, problems = parse(text), []
    with tempfile.TemporaryDirectory() as tmp:
        for name, body in test["infile"].items():
            with open(os.path.join(tmp, name), "w", encoding="utf-8", newline="") as f:
                f.write(body)
        argv = [w.replace("$TMP", tmp) for w in test["command"]]
        out, err = io.StringIO(), io.StringIO()
        with contextlib.redirect_stderr(err):
            try:
                status = main(argv, spark, test["stdin"].split("\n"), out)
            except (ValueError, SystemExit) as e:
                err.write(f"{e}\n")
                status = 1
        if status != test["status"]:
            problems.append(f"status {status}, not {test['status']}: {err.getvalue()[:300]}")
        for name, got, want in (("stdout", out.getvalue(), test["stdout"]), ("stderr", err.getvalue(), test["stderr"])):
            if isinstance(want, tuple):
                if not matches(want[1], got):
                    problems.append(f"{name} {got!r} doesn't match {want[1]!r}")
            elif want is not None and got != want:
                problems.append(f"{name} is {got!r}, not {want!r}")
        for name, want in test["outfile"].items():
            path = os.path.join(tmp, name)
            got = open(path, encoding="utf-8", newline="").read() if os.path.exists(path) else None
            if got != want:
                problems.append(f"{name} is {got!r}, not {want!r}")
        extra = set(os.listdir(tmp)) - set(test["infile"]) - set(test["outfile"])
        if extra:
            problems.append(f"files left over: {sorted(extra)}")
    return problems


def check_file(path: str, spark: SparkSession) -> list[str]:
    with open(path, encoding="utf-8", newline="") as f:
        return check(f.read(), spark)
