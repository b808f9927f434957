"""Column sets: which columns, in which order, under which names.

one,3,+2 names, positions, positions from the end; a-b, -b, a-, - ranges; new:range renames; ~range leaves out; (matcher) picks names
by a matcher, ~(matcher) leaves them out. A suffix +transform changes the values; ::agg+agg folds them into one column each.
Columns whose names begin with _ are row metadata and not counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions import text as T
from colsmith.functions.agg import aggregator, as_text
from colsmith.functions.expr import compile_expr
from colsmith.functions.trans import transform


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def valid_name(name: str) -> str:
    """A name that begins with a letter and goes on with letters, digits and _."""
    name = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return name if re.match(r"[A-Za-z]", name) else f"X{name}" if name.startswith("_") else f"X_{name}"


def _top_level(spec: str, sep: str) -> list[str]:
    """Parts between separators that stand outside of parentheses."""
    out, depth, now = [], 0, ""
    for ch in spec:
        depth += (ch == "(") - (ch == ")")
        if ch == sep and depth == 0:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


_NAME_TESTS: dict[str, Callable[[str, str], bool]] = {
    "prefix": lambda n, p: n.startswith(p), "suffix": lambda n, p: n.endswith(p), "infix": lambda n, p: p in n, "exact": lambda n, p: n == p,
    "glob": lambda n, p: fnmatchcase(n, p.replace("[", "[[]")), "regex": lambda n, p: re.search(p, n) is not None, "yes": lambda n, p: True,
    "length": lambda n, p: int(p.split(",")[0]) <= len(n.encode()) <= int(p.split(",")[-1]), "empty": lambda n, p: not n, "integer": lambda n, p: re.fullmatch(r"-?[0-9]+", n) is not None,
}


def _name_test(spec: str) -> Callable[[str], bool]:
    """A matcher over column names, decided here and not in a job."""
    head, _, pattern = spec.partition(",")
    method, *mods = head.split(".")
    method = {"substr": "infix", "substring": "infix", "": "regex"}.get(method, method)
    fold = (lambda s: s.lower()) if "case" in mods else (lambda s: s)
    if method == "range":
        tests = re.findall(r"(<=|>=|==|!=|<|>|=)([^<>=!]*)", pattern)
        ops = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "=": "__eq__", "==": "__eq__", "!=": "__ne__"}
        found = lambda n: all(getattr(fold(n).encode(), ops[o])(v.encode()) for o, v in tests)
    elif method in _NAME_TESTS:
        patterns = pattern[1:].split(pattern[0]) if {"or", "and"} & set(mods) and pattern else [pattern]
        pick = all if "and" in mods else any
        found = lambda n: pick(_NAME_TESTS[method](fold(n), fold(p)) for p in patterns)
    else:
        raise ValueError(f"matcher {spec!r} can't be used on column names")
    return (lambda n: not found(n)) if "not" in mods else found


def position(spec: str, columns: Sequence[str]) -> int:
    if spec in columns:
        return list(columns).index(spec)
    if m := re.fullmatch(r"(\+?)(\d+)", spec):
        n = len(columns) - int(m[2]) if m[1] else int(m[2]) - 1
        if 0 <= n < len(columns):
            return n
        raise ValueError(f"column {spec} is out of range; there are {len(columns)}")
    if (m := re.fullmatch(r"c(\d+)", spec)) and 1 <= int(m[1]) <= len(columns):
        return int(m[1]) - 1
    raise ValueError(f"no column {spec!r} among {', '.join(columns)}")


def one_range(spec: str, columns: Sequence[str]) -> list[int]:
    if spec in columns:
        return [list(columns).index(spec)]
    if spec.startswith("(") and spec.endswith(")"):
        test = _name_test(spec[1:-1])
        return [i for i, n in enumerate(columns) if test(n)]
    if "-" in spec:
        a, _, b = spec.partition("-")
        first = position(a, columns) if a else 0
        last = position(b, columns) if b else len(columns) - 1
        if first > last:
            raise ValueError(f"range {spec!r} begins after its end")
        return list(range(first, last + 1))
    return [position(spec, columns)]


def resolve(spec: str, columns: Sequence[str]) -> list[tuple[str, str]]:
    """(new name, column) of each column of a set, in order, repetitions kept."""
    picked: list[tuple[str, int]] = []
    left_out: set[int] = set()
    only_out = True
    for part in _top_level(spec, ","):
        part = part.strip()
        if not part:
            continue
        if part.startswith("~"):
            left_out |= set(one_range(part[1:], columns))
            continue
        only_out = False
        new = ""
        if part not in columns and ":" in part and not part.startswith("("):
            new, _, part = part.partition(":")
        for i in one_range(part, columns):
            picked.append((new or columns[i], i))
    if only_out:
        picked = [(n, i) for i, n in enumerate(columns)]
    return [(n, columns[i]) for n, i in picked if i not in left_out]


@dataclass(frozen=True)
class Output:
    name: str
    value: Column


def expression(df: DataFrame, text: str, degrees: bool = False, seed: int | None = None, numeric: Callable[[Column], Column] | None = None) -> Column:
    """An expression over a table's columns as numbers: typed ones are cast, text is read leniently."""
    columns, types = data_columns(df), dict(df.dtypes)

    def number(name: str) -> Column:
        if numeric:
            return numeric(col(name))
        return F.coalesce(col(name).cast("double"), F.lit(0.0)) if types[name] != "string" else T.lossy_double(col(name))

    def find(name: str) -> Column | None:
        try:
            return number(columns[position(name, columns)])
        except ValueError:
            return None

    return compile_expr(text, find, lambda r: [number(c) for _, c in resolve(r, columns)], degrees, seed)


def fields(df: DataFrame, spec: str, as_string: bool = True) -> list[Output]:
    """The columns that a set makes of a table."""
    columns = data_columns(df)
    if "::" in spec:
        where, _, aggs = spec.partition("::")
        values = [col(c) for _, c in resolve(where, columns)]
        out = []
        for a in aggs.split("+"):
            new, _, a = a.rpartition(":") if ":" in a.split(",")[0] else ("", "", a)
            agg = aggregator(a)
            value = agg.across(values)
            out.append(Output(new or a.split(",")[0].split(".")[0], as_text(agg, value) if as_string else value))
        return out
    where, chain = spec, ""
    if m := re.search(r"\+(?=[A-Za-z])", _outside(spec)):
        where, chain = spec[: m.start()], spec[m.end() :]
    change = transform(chain) if chain else (lambda c: c)
    return [Output(n, change(T.empty_if_null(col(c)) if chain else col(c))) for n, c in resolve(where, columns)]


def _outside(spec: str) -> str:
    """The spec with what stands in parentheses blanked."""
    return re.sub(r"\([^()]*\)", lambda m: "_" * len(m[0]), spec)


def group(df: DataFrame, spec: str) -> list[Output]:
    """.name:1-3 joins columns by the delimiter that comes first."""
    cut, (name, _, which) = spec[0], spec[1:].partition(":")
    return [Output(name, F.concat_ws(T.unescape_char(cut) if cut.isalpha() else cut, *[T.empty_if_null(col(c)) for _, c in resolve(which, data_columns(df))]))]


def computed(df: DataFrame, spec: str) -> list[Output]:
    """name:expression."""
    name, _, text = spec.partition(":")
    return [Output(name, expression(df, text))]


def composite(df: DataFrame, spec: str) -> list[Output]:
    """name:text with ^{column} or ^3 in it; ^^ is a ^."""
    name, _, template = spec.partition(":")
    columns, parts, at = data_columns(df), [], 0
    for m in re.finditer(r"\^(?:\^|\{([^}]*)\}|(\d))", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit("^") if m[0] == "^^" else T.empty_if_null(col(columns[position(m[1] or m[2], columns)])))
        at = m.end()
    return [Output(name, F.concat(*parts, F.lit(template[at:])))]


def settle(outputs: Sequence[Output], duplicates: str = "fail") -> list[Column]:
    """Columns under final names; duplicates: fail, allow, or numeric (append 1, 2, ...)."""
    seen: set[str] = set()
    out = []
    for o in outputs:
        name = o.name
        if name in seen:
            if duplicates == "fail":
                raise ValueError(f"two columns would be named {name!r}")
            if duplicates == "numeric":
                k = 1
                while f"{name}{k}" in seen:
                    k += 1
                name = f"{name}{k}"
        seen.add(name)
        out.append(o.value.alias(name))
    return out
