"""The tools as commands: python -m colsmith TOOL [flags] [files]; - is standard input, <<text a literal.

Commands are for text files and terminals; programs use the operators. A command prints to standard output and returns its status.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsmith.operators import filter as flt
from colsmith.operators import generate as gen
from colsmith.operators import join as jn
from colsmith.operators import sort as st
from colsmith.operators import terminal
from colsmith.operators.count import count, count_columns
from colsmith.operators.project import cut, rename
from colsmith.operators.sample import sample_even, sample_every, sample_ranges
from colsmith.operators.search import search
from colsmith.operators.transpose import transpose
from colsmith.operators.unique import distinct_lines, unique
from colsmith.operators.zip import paste
from colsmith.plans import columns as C
from colsmith.sources import scan, sink
from colsmith.sources.spec import MARK, Format, parse

TOOLS: dict[str, Callable] = {}


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__.rstrip("_").replace("_", "-")] = f
    return f


class Run:
    """One command: its session, its streams, and the header that its inputs had."""

    def __init__(self, spark: SparkSession, stdin: Sequence[str], out) -> None:
        self.spark, self.stdin, self.out, self.header = spark, stdin, out, "none"
        self.format, self.eol = Format(), None

    def table(self, name: str) -> DataFrame:
        f = self.format
        if name == "-":
            first = self.stdin[0] if self.stdin else None
            df = scan.read_lines(self.spark, list(self.stdin), f)
        elif name.startswith("<<"):
            first = scan.inline(name)[0]
            df = scan.read_lines(self.spark, name, f)
        else:
            first = scan._first_line(self.spark, name)
            df = scan.read_text(self.spark, name, f)
            self.eol = self.eol or scan.eol_of(self.spark, name)
        if first is not None and first.startswith(MARK):
            self.header = "marked"
            self.format = scan.header_of(first, f)[1]
        elif f.header:
            self.header = "plain"
        return df

    def tables(self, names: Sequence[str]) -> list[DataFrame]:
        return [self.table(n) for n in names or ["-"]]

    def all(self, names: Sequence[str]) -> DataFrame:
        return flt.concat(self.tables(names))

    def show(self, df: DataFrame, header: str | None = None, to: str = "-") -> None:
        o = replace(sink.derived(self.format, eol=self.eol), header=self.header if header is None else header)
        order = [c for c in ("_file_no", "_row") if c in df.columns]
        text = sink.to_text(df.orderBy(*order) if order else df, o)
        if to == "-":
            self.out.write(text)
        elif to == "--":
            sys.stderr.write(text)
        else:
            with open(to, "w", encoding="utf-8", newline="") as f:
                f.write(text)


class Ordered(argparse.Action):
    """Keeps (flag, value) in command-line order."""

    def __call__(self, parser, namespace, values, option_string=None):
        namespace.steps = [*getattr(namespace, "steps", []), (self.dest, values)]


def _parser(name: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=name, add_help=True, conflict_handler="resolve")
    p.add_argument("-I", dest="input", default="")
    return p


def _many(p: argparse.ArgumentParser, *flags: str, **kw) -> None:
    p.add_argument(*flags, action="append", default=[], **kw)


@tool
def cut_(p, run, argv):
    for flag, dest in (("-f", "f"), ("-g", "g"), ("-e", "e"), ("-c", "c")):
        p.add_argument(flag, dest=dest, action=Ordered)
    p.add_argument("-D", dest="dup", default="fail")
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    for t in [a.run.all(a.files)]:
        a.run.show(cut(t, *getattr(a, "steps", []), duplicates=a.dup))


@tool
def cgrep(p, run, argv):
    _many(p, "-p", dest="patterns")
    p.add_argument("-o", dest="any_of", action="store_true")
    p.add_argument("-v", dest="invert", action="store_true")
    p.add_argument("-V", dest="others")
    p.add_argument("-l", dest="location")
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    both = flt.grep_split(a.run.all(a.files), *a.patterns, any_of=a.any_of, invert=a.invert)
    named = (lambda d: flt.location(d, a.location)) if a.location else (lambda d: d)
    a.run.show(named(both.matching))
    if a.others:
        a.run.show(named(both.others), to=a.others)


@tool
def cat(p, run, argv):
    p.add_argument("-n", dest="number")
    p.add_argument("-b", dest="begin", action="store_true")
    p.add_argument("-e", dest="end", action="store_true")
    _many(p, "-r", dest="remove")
    _many(p, "-s", dest="skip")
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    df = a.run.all(a.files)
    df = flt.remove(df, *a.remove) if a.remove else df
    if a.number or a.begin or a.end:
        name, start, where = ((a.number or "").split(",") + ["", "", ""])[:3]
        df = flt.number(df, ["_file_no", "_row"], name or "number", int(start or 1), a.skip, where or ("end" if a.end else "begin"))
    a.run.show(df)


@tool
def sort(p, run, argv):
    _many(p, "-k", dest="keys")
    for flag, dest in (("-u", "unique"), ("-m", "merge"), ("-c", "check"), ("-a", "alt"), ("-A", "alt_merge")):
        p.add_argument(flag, dest=dest, action="store_true")
    p.add_argument("-C", dest="number", type=int)
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    df = a.run.all(a.files)
    if a.check or a.number:
        bad = st.check(df, ["_file_no", "_row"], a.keys, a.unique, a.number or 1)
        a.run.show(bad, to="--")
        return int(bad.count() > 0)
    rows = st.sort(df, a.keys, ["_file_no", "_row"], a.unique)
    a.run.show(rows.drop("_file_no", "_row"))


@tool
def join(p, run, argv):
    _many(p, "-k", dest="keys")
    p.add_argument("-o", dest="output", default="")
    _many(p, "-a", dest="also")
    p.add_argument("-f", dest="to", default="-")
    p.add_argument("files", nargs="+")
    a = run(p, argv)
    left, right = (a.run.table(f) for f in a.files[:2])
    j = jn.join(left, right, a.keys, a.output, ["_row"])
    a.run.show(j.matching, to=a.to)
    for spec in a.also:
        n, _, to = spec.partition(",")
        a.run.show(j.left_only if n == "1" else j.right_only, to=to or "-")


@tool
def uniq(p, run, argv):
    _many(p, "-k", dest="keys")
    p.add_argument("-w", dest="which", default="first")
    p.add_argument("-c", dest="count", default="")
    _many(p, "-a", "--agg", dest="replace")
    _many(p, "--agg-pre", dest="before")
    _many(p, "--agg-post", dest="after")
    p.add_argument("--hash", action="store_true")
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    df = a.run.all(a.files)
    by = ["_file_no", "_row"]
    if a.hash:
        a.run.show(distinct_lines(df.select(*C.data_columns(df), *by), by))
        return
    out = unique(df, a.keys, by, a.which, a.count, a.replace, a.before, a.after)
    a.run.show(out)


@tool
def wc(p, run, argv):
    for flag in "lbcw":
        p.add_argument(f"-{flag}", dest="kinds", action="append_const", const=flag)
    _many(p, "-a", "--agg", dest="aggs")
    p.add_argument("-C", dest="columns", action="store_true")
    p.add_argument("-f", dest="file", default="maybe")
    p.add_argument("-h", dest="header", default="no")
    p.add_argument("-t", dest="total", default="maybe")
    p.add_argument("-F", dest="fmt", default="plain")
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    specs = [*(a.kinds or []), *a.aggs]
    df = a.run.all(a.files)
    head = "plain" if a.header.split(",")[0] == "yes" else "none"
    if a.columns:
        a.run.show(count_columns(df, specs, fmt=a.fmt), head)
        return
    shown, _, name = a.file.partition(",")
    out = count(df, specs, totals=a.total, filename=name or "file", fmt=a.fmt)
    if shown == "no" or (shown == "maybe" and len(a.files) < 2):
        out = out.drop(name or "file")
    a.run.show(out, head)


@tool
def paste_(p, run, argv):
    p.add_argument("-e", dest="end", default="exact")
    _many(p, "-d", dest="defaults")
    p.add_argument("-l", dest="last", action="store_true")
    _many(p, "-r", dest="renames")
    p.add_argument("-R", dest="sloppy", action="store_true")
    p.add_argument("-D", dest="dup", default="fail")
    p.add_argument("files", nargs="+")
    a = run(p, argv)
    tables = a.run.tables(a.files)
    try:
        out = paste(tables, [["_row"]] * len(tables), a.end, a.defaults, a.last, a.renames, a.sloppy, a.dup, numbered=True)
    except ValueError as e:
        if a.end != "exact" or "rows" not in str(e):
            raise
        # Unequal tables: what they have in common is still written.
        a.run.show(paste(tables, [["_row"]] * len(tables), "early", a.defaults, a.last, a.renames, a.sloppy, a.dup, numbered=True))
        sys.stderr.write(f"{e}\n")
        return 1
    a.run.show(out)


@tool
def sample(p, run, argv):
    p.add_argument("-s", dest="size", type=int)
    p.add_argument("-f", dest="every")
    p.add_argument("-r", dest="ranges")
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    df, by = a.run.all(a.files), ["_file_no", "_at"]
    df = df.withColumnRenamed("_row", "_at")
    if a.every:
        step, first, last = (a.every.split(",") + ["", ""])[:3]
        out = sample_every(df, by, int(step), int(first or 1), int(last) if last else None)
    elif a.ranges:
        out = sample_ranges(df, by, a.ranges)
    else:
        out = sample_even(df, by, a.size or 24)
    a.run.show(out.withColumnRenamed("_at", "_row"))


@tool
def transpose_(p, run, argv):
    p.add_argument("-n", dest="most", type=int, default=1000)
    p.add_argument("-h", dest="head", action="store_true")
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    df = a.run.all(a.files)
    out = transpose(df, ["_row"], a.most)
    named = a.run.header != "none"
    a.run.show(out if named else out.drop("column"), "none")


@tool
def binsearch(p, run, argv):
    _many(p, "-k", dest="keys")
    p.add_argument("-C", dest="context", default="0,0")
    p.add_argument("-H", dest="file")
    p.add_argument("--sub-delim", dest="cut", default=",")
    p.add_argument("value")
    p.add_argument("files", nargs="+")
    a = run(p, argv)
    out = []
    for k, f in enumerate(a.files):
        df = a.run.table(f).withColumnRenamed("_row", "_at").withColumn("_file_no", F.lit(k))
        hit = search(df, a.keys or ["1"], a.value, ["_at"], a.context, a.cut)
        if a.file:
            name, _, parts = a.file.partition(":")
            hit = hit.select(F.substring_index("_file", "/", -int(parts or 1)).alias(name or "filename"), "*")
        out.append(hit.withColumnRenamed("_at", "_row"))
    a.run.show(flt.concat(out))


@tool
def verify(p, run, argv):
    _many(p, "-p", dest="rules")
    _many(p, "-k", dest="keys")
    p.add_argument("--sort", dest="sorted", action="store_true")
    p.add_argument("--unique", action="store_true")
    p.add_argument("--first", default="")
    p.add_argument("--last", default="")
    p.add_argument("--report", type=int, default=5)
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    df = a.run.all(a.files)
    keys = (a.keys or ["1"]) if a.sorted or a.unique or a.first or a.last else []
    bad = flt.verify(df, ["_file_no", "_row"], a.rules, len(C.data_columns(df)), keys if a.sorted or a.unique else [], a.unique, a.first, a.last, a.report)
    found = [f"{r['rule']} line {r['_row']}: {r['line']}" for r in bad.collect()]
    sys.stderr.write("".join(x + "\n" for x in found))
    return int(bool(found))


@tool
def filegen(p, run, argv):
    p.add_argument("-n", dest="lines", type=int)
    p.add_argument("-c", dest="steps", action=Ordered)
    p.add_argument("-m", dest="steps", action=Ordered)
    p.add_argument("-h", dest="head", action="store_true")
    p.add_argument("-F", dest="full")
    p.add_argument("--seed", type=int)
    p = _repeating(p)
    a = run(p, argv)
    if a.full:
        kind, _, arg = a.full.partition(",")
        if kind == "bytes":
            a.run.out.write(gen.random_bytes(int(arg), a.seed).decode("latin-1"))
            return
        one, _, two = arg.partition(",")
        words = a.run.spark.read.text(one)
        made = {"rank": lambda: gen.rank_words(words, a.run.spark.read.text(two)), "anagram": lambda: gen.anagrams(words, two), "sub-anagram": lambda: gen.sub_anagrams(words, two)}
        a.run.show(made[kind](), "none")
        return
    specs = [f"{v.replace(',', '*', 1)}" if flag == "repeat" else v for flag, v in getattr(a, "steps", None) or [("column", "grid")]]
    a.run.show(gen.generate(a.run.spark, specs, a.lines, a.seed), "marked" if a.head else "none")


def _repeating(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
    p.add_argument("-c", dest="column", action=Ordered)
    p.add_argument("-m", dest="repeat", action=Ordered)
    return p


@tool
def calc(p, run, argv):
    p.add_argument("-d", dest="degrees", action="store_true")
    p.add_argument("expressions", nargs="+")
    a = run(p, argv)
    for v in terminal.calc(a.run.spark, a.expressions, a.degrees):
        a.run.out.write(f"{v}\n")


@tool
def tabs(p, run, argv):
    p.add_argument("-w", dest="width", type=int, default=80)
    p.add_argument("-n", dest="height", type=int, default=24)
    p.add_argument("files", nargs="*")
    a = run(p, argv)
    a.run.out.write("".join(x + "\n" for x in terminal.tabs(a.run.all(a.files).orderBy("_file_no", "_row"), a.width, a.height)))


@tool
def help_(p, run, argv):
    p.add_argument("topic", nargs="?", default="")
    a = run(p, argv)
    a.run.out.write("".join(f"{n}\t{about}\n" for n, about in terminal.describe(a.topic)))


@tool
def tooltest(p, run, argv):
    p.add_argument("files", nargs="+")
    a = run(p, argv)
    from colsmith.golden import check_file

    failed = 0
    for f in a.files:
        problems = check_file(f, a.run.spark)
        failed += bool(problems)
        a.run.out.write("".join(f"{f}: {x}\n" for x in problems))
    return int(failed > 0)


def main(argv: Sequence[str], spark: SparkSession | None = None, stdin: Sequence[str] | None = None, out=None) -> int:
    """Run one command and return its status."""
    out = out or sys.stdout
    if not argv or argv[0] not in TOOLS:
        sys.stderr.write(f"tools: {', '.join(sorted(TOOLS))}\n")
        return 1
    if spark is None:
        from colsmith.session import local_session

        spark = local_session(partitions=4, app=argv[0])
        spark.sparkContext.setLogLevel("ERROR")
    if stdin is None:
        stdin = [] if sys.stdin is None or sys.stdin.isatty() else sys.stdin.read().split("\n")
    if stdin and stdin[-1] == "":
        stdin = stdin[:-1]
    state = Run(spark, stdin, out)

    def start(p: argparse.ArgumentParser, args: Sequence[str]) -> argparse.Namespace:
        a = p.parse_intermixed_args(list(args))
        state.format = parse(a.input)
        a.run = state
        return a

    return TOOLS[argv[0]](_parser(argv[0]), start, argv[1:]) or 0


__all__ = ["TOOLS", "main", "rename"]
