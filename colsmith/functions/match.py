"""Matchers: named predicates on one value, with modifiers, combiners and determiners.

Spec: method.modifiers,pattern. Modifiers: utf8 (characters, not bytes), case (ignore case), not, trim (the value first), null (an
empty value matches too), and / or (several patterns, cut at the pattern's first character).
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions import text as T
from colsmith.functions.keys import Comparator
from colsmith.functions.registry import Registry

MATCHERS = Registry("matcher")
MODIFIERS = {"utf8", "case", "not", "trim", "null", "and", "or"}


@dataclass(frozen=True)
class Options:
    utf8: bool = False
    case: bool = False


def _fold(c: Column, pattern: str, o: Options) -> tuple[Column, str]:
    if not o.case:
        return c, pattern
    folded = pattern.lower() if o.utf8 else "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in pattern)
    return T.lower(c, o.utf8), folded


def java_regex(pattern: str) -> str:
    """A pattern without look-around or back references, with named groups written for Java."""
    if re.search(r"\(\?<?[=!]", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError(f"regex {pattern!r}: look-around and back references aren't supported")
    return pattern.replace("(?P<", "(?<")


@MATCHERS.push("regex", aliases=("",))
def _regex(c: Column, p: str, o: Options) -> Column:
    """The pattern is found somewhere."""
    flags = ("i" + "u" * o.utf8 if o.case else "") + ("U" if o.utf8 else "")
    return c.rlike((f"(?{flags})" if flags else "") + java_regex(p))


@MATCHERS.push("prefix")
def _prefix(c: Column, p: str, o: Options) -> Column:
    """Begins with the pattern."""
    c, p = _fold(c, p, o)
    return c.startswith(p)


@MATCHERS.push("suffix")
def _suffix(c: Column, p: str, o: Options) -> Column:
    """Ends with the pattern."""
    c, p = _fold(c, p, o)
    return c.endswith(p)


@MATCHERS.push("infix", aliases=("substr", "substring"))
def _infix(c: Column, p: str, o: Options) -> Column:
    """Holds the pattern."""
    c, p = _fold(c, p, o)
    return c.contains(p)


@MATCHERS.push("exact")
def _exact(c: Column, p: str, o: Options) -> Column:
    """Is the pattern."""
    c, p = _fold(c, p, o)
    return c == F.lit(p)


@MATCHERS.push("glob")
def _glob(c: Column, p: str, o: Options) -> Column:
    """Whole value, * for any run, ? for any one."""
    c, p = _fold(c, p, o)
    body = "".join(".*" if ch == "*" else "." if ch == "?" else T.quoted(ch) for ch in p)
    return c.rlike(f"(?s)\\A{body}\\z")


def _all(preds: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, preds, F.lit(True))


@MATCHERS.push("keep")
def _keep(c: Column, p: str, o: Options) -> Column:
    """Every character of the pattern is there, as often at least."""
    c, p = _fold(c, p, o)
    return _all([T.occurrences(c, ch) >= n for ch, n in sorted(Counter(p).items())])


@MATCHERS.push("reject")
def _reject(c: Column, p: str, o: Options) -> Column:
    """No character of the pattern is there as often."""
    c, p = _fold(c, p, o)
    return _all([T.occurrences(c, ch) < n for ch, n in sorted(Counter(p).items())])


_SYMBOLS = [("<=", operator.le), (">=", operator.ge), ("==", operator.eq), ("!=", operator.ne), ("<", operator.lt), (">", operator.gt), ("=", operator.eq)]
_WORDS = {"LT": operator.lt, "LE": operator.le, "GT": operator.gt, "GE": operator.ge, "EQ": operator.eq, "NE": operator.ne}


def bounds(spec: str) -> tuple[Comparator, list[tuple[Callable, str]]]:
    """(comparator, tests) of <=dog>cat, float,>1<=5 or LE,dog,GT,cat."""
    first, _, rest = spec.partition(",")
    if rest and first not in _WORDS and not first.startswith(("<", ">", "=", "!")):
        comparator, spec = Comparator.parse(first), rest
    else:
        comparator = Comparator.parse("plain")
    if spec.split(",")[0] in _WORDS:
        parts = spec.split(",")
        if len(parts) not in (2, 4):
            raise ValueError(f"range {spec!r}: one or two bounds")
        return comparator, [(_WORDS[parts[i]], parts[i + 1]) for i in range(0, len(parts), 2)]
    out = []
    for m in re.finditer(r"(<=|>=|==|!=|<|>|=)([^<>=!]*)", spec):
        out.append((dict(_SYMBOLS)[m[1]], m[2]))
    if not 1 <= len(out) <= 2:
        raise ValueError(f"range {spec!r}: one or two bounds")
    return comparator, out


def _flipped(op: Callable, rev: bool) -> Callable:
    turn = {operator.lt: operator.gt, operator.gt: operator.lt, operator.le: operator.ge, operator.ge: operator.le}
    return turn.get(op, op) if rev else op


def in_range(c: Column, spec: str, other: Callable[[str], Column] = F.lit) -> Column:
    comparator, tests = bounds(spec)
    rev = "rev" in comparator.mods
    return _all([_flipped(op, rev)(comparator.key(c), comparator.key(other(v))) for op, v in tests])


@MATCHERS.push("range")
def _range(c: Column, p: str, o: Options) -> Column:
    """Within one or two bounds under a comparator."""
    return in_range(c, p)


def _span(p: str) -> tuple[int, int]:
    a, _, b = p.partition(",")
    return int(a), int(b) if b else int(a)


@MATCHERS.push("length")
def _length(c: Column, p: str, o: Options) -> Column:
    """Length, or from and to, in bytes or characters."""
    return T.length(c, o.utf8).between(*_span(p))


@MATCHERS.push("empty")
def _empty(c: Column, p: str, o: Options) -> Column:
    """Nothing at all."""
    return c == ""


@MATCHERS.push("blank")
def _blank(c: Column, p: str, o: Options) -> Column:
    """Nothing but white space."""
    return T.trim(c, o.utf8) == ""


@MATCHERS.push("comment")
def _comment(c: Column, p: str, o: Options) -> Column:
    """Blank, or begins with the pattern after white space."""
    bare = T.trim(c, o.utf8)
    folded, p = _fold(bare, p, o)
    return (bare == "") | folded.startswith(p)


@MATCHERS.push("hash")
def _hash(c: Column, p: str, o: Options) -> Column:
    """A comment with #."""
    return _comment(c, "#", o)


@MATCHERS.push("slash")
def _slash(c: Column, p: str, o: Options) -> Column:
    """A comment with //."""
    return _comment(c, "//", o)


def _shape(name: str, regex: str, about: str) -> None:
    MATCHERS.push(name, lambda c, p, o: c.rlike(regex), about)


_shape("float", "\\A-?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?\\z", "A decimal number, exponent allowed.")
_shape("integer", "\\A-?\\d+\\z", "A whole number.")
_shape("number", "\\A-?\\d+(?:\\.\\d+)?\\z", "A decimal number without exponent.")
_OCTET = "(?:[1-9]?\\d|1\\d\\d|2[0-4]\\d|25[0-5])"
_shape("ip", f"\\A({_OCTET}\\.){{3}}{_OCTET}\\z", "Four numbers of 0 to 255 with dots.")


@MATCHERS.push("yes")
def _yes(c: Column, p: str, o: Options) -> Column:
    """Always."""
    return F.lit(True)


@MATCHERS.push("no")
def _no(c: Column, p: str, o: Options) -> Column:
    """Never."""
    return F.lit(False)


@MATCHERS.push("file-exact", aliases=("fileexact",))
def _file_exact(c: Column, p: str, o: Options) -> Column:
    """Is a line of a small file, read on the driver; joins.in_file is the form for large ones."""
    with open(p, encoding="utf-8") as f:
        lines = f.read().split("\n")
    lines = lines[:-1] if lines and lines[-1] == "" else lines
    c, _ = _fold(c, "", o)
    return c.isin(*[_fold(c, x, o)[1] for x in lines])


@MATCHERS.push("solve")
def _solve(c: Column, p: str, o: Options) -> Column:
    """Word puzzles: a wrong letter in lower case, a misplaced one in upper case, +x for one in place; guesses apart by commas."""
    preds, size = [], None
    for guess in p.split(","):
        letters = re.findall(r"\+[a-z]|[a-z]|[A-Z]", guess)
        if not guess or "".join(letters) != guess:
            raise ValueError(f"solve: can't read {guess!r}")
        if size not in (None, len(letters)):
            raise ValueError("solve: guesses must have one length")
        size = len(letters)
        at = lambda i: F.substring(c, i + 1, 1)
        exact = {i: g[1] for i, g in enumerate(letters) if g[0] == "+"}
        wanted = Counter(g.lower() for g in letters if g.isupper())
        preds += [at(i) == ch for i, ch in exact.items()]
        preds += [at(i) != g.lower() for i, g in enumerate(letters) if g.isupper()]
        # A letter's free places: those not held by an exact letter. Misplaced ones use theirs up, a wrong one allows no more.
        free = lambda ch: functools.reduce(operator.add, [F.when(at(i) == ch, 1).otherwise(0) for i in range(size) if i not in exact], F.lit(0))
        preds += [free(ch) >= n for ch, n in sorted(wanted.items())]
        preds += [free(ch) <= wanted[ch] for ch in sorted({g for g in letters if g.islower() and len(g) == 1})]
    return (F.char_length(c) == size) & _all(preds)


def matcher(spec: str) -> Callable[[Column], Column]:
    """A predicate on a value from a spec; a value of null counts as empty."""
    head, _, pattern = spec.partition(",")
    mods = [p for p in head.split(".") if p in MODIFIERS]
    names = [p for p in head.split(".") if p not in MODIFIERS]
    if len(names) > 1:
        raise ValueError(f"matcher {spec!r}: one of {names} is no modifier")
    name = names[0] if names else ""
    build, o = MATCHERS.get(name), Options("utf8" in mods, "case" in mods)

    def run(c: Column) -> Column:
        c = T.empty_if_null(c)
        value = T.trim(c, o.utf8) if "trim" in mods else c
        if "or" in mods or "and" in mods:
            parts = pattern[1:].split(pattern[0]) if pattern else [""]
            found = functools.reduce(operator.or_ if "or" in mods else operator.and_, [build(value, p, o) for p in parts])
        else:
            found = build(value, pattern, o)
        if "not" in mods:
            found = ~found
        return found | (value == "") if "null" in mods else found

    return run


def determiner(spec: str) -> Callable[[Sequence[Column]], Column]:
    """How many of several predicates must hold: all some none notall mixed uniform, atmost.N atleast.N exactly.N, the same with no before
    N counting those that fail; N below 1 is a share."""
    name, _, arg = spec.partition(".")
    name, count_no = (name[:-2], True) if name.endswith("no") and name[:-2] in ("atmost", "atleast", "exactly") else (name, False)

    def run(preds: Sequence[Column]) -> Column:
        n = len(preds)
        yes = functools.reduce(operator.add, [p.cast("int") for p in preds], F.lit(0))
        if name in ("", "some"):
            return yes > 0
        if name in ("all", "none", "notall", "mixed", "uniform"):
            return {"all": yes == n, "none": yes == 0, "notall": yes < n, "mixed": (yes > 0) & (yes < n), "uniform": (yes == 0) | (yes == n)}[name]
        if name not in ("atmost", "atleast", "exactly"):
            raise ValueError(f"no determiner {spec!r}")
        want = float(arg)
        want = round(want * n) if "." in arg and want < 1 else int(want)
        counted = F.lit(n) - yes if count_no else yes
        return {"atmost": counted <= want, "atleast": counted >= want, "exactly": counted == want}[name]

    return run


def in_file(df: DataFrame, column: str, lines: DataFrame, value: str = "value", negate: bool = False) -> DataFrame:
    """Rows whose value is (or isn't) a line of another table: a semi or anti join that Spark plans by size."""
    keys = lines.select(F.col(value).alias("_line")).distinct()
    return df.join(keys, df[column] == keys["_line"], "left_anti" if negate else "left_semi")
