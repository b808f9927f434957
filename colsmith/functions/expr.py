"""The numeric expression language, compiled to one Column.

Text goes through a lexer and a precedence parser to a small tree, and the tree to an ANSI-safe double expression: division by zero
gives infinities or NaN, logarithms outside their domain likewise, as IEEE arithmetic does. Names are constants first, then columns,
then c1, c2 ... by position; [range] stands for the columns of a column range as a comma list.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY, _MAX = 2.2250738585072014e-308, 1.7976931348623157e308
CONSTANTS: dict[str, float] = {
    "pi": math.pi, "PI": math.pi, "e": math.e, "E": math.e, "EULER_GAMMA": 0.5772156649015329, "FRAC_1_PI": 1 / math.pi, "FRAC_1_SQRT_2": 0.7071067811865476,
    "FRAC_2_SQRT_PI": 1.1283791670955126, "FRAC_PI_2": math.pi / 2, "FRAC_PI_3": math.pi / 3, "FRAC_PI_4": math.pi / 4, "FRAC_PI_6": math.pi / 6, "FRAC_PI_8": math.pi / 8,
    "FRAC_2_PI": 2 / math.pi, "GOLDEN_RATIO": 1.618033988749895, "LN_2": math.log(2), "LN_10": math.log(10), "LOG2_10": math.log2(10), "LOG2_E": math.log2(math.e),
    "LOG10_2": math.log10(2), "LOG10_E": math.log10(math.e), "SQRT_2": math.sqrt(2), "TAU": math.tau, "DIGITS": 15.0, "EPSILON": 2.220446049250313e-16, "INFINITY": math.inf,
    "MANTISSA_DIGITS": 53.0, "MAX": _MAX, "MAX_10_EXP": 308.0, "MAX_EXP": 1024.0, "MIN": -_MAX, "MIN_10_EXP": -307.0, "MIN_EXP": -1021.0, "MIN_POSITIVE": _TINY,
    "NAN": math.nan, "NEG_INFINITY": -math.inf, "RADIX": 2.0,
}


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Span:
    text: str


@dataclass(frozen=True)
class Dice:
    count: int
    sides: int


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


_LEX = re.compile(
    r"\s*(?:(?P<radix>0[bB][01]+|0[oO][0-7]+|0[xX][0-9a-fA-F]+)|(?P<roman>0[rR][IVXLCDMivxlcdm]+)|(?P<dice>[0-9]+d[0-9]+)"
    r"|(?P<num>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[KMGTPEZYRQkmgtpezyrq]?(?![A-Za-z0-9_]))|(?P<name>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<span>\[[^\]]*\])|(?P<op><=|>=|==|!=|[-+*/%^!<>(),]))"
)
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(text: str) -> int:
    total, last = 0, 0
    for ch in reversed(text.upper()):
        v = _ROMAN[ch]
        total += v if v >= last else -v
        last = max(last, v)
    return total


def _number(text: str) -> float:
    unit = 1.0
    if text[-1] in "KMGTPEZYRQ":
        unit, text = 1024.0 ** ("KMGTPEZYRQ".index(text[-1]) + 1), text[:-1]
    elif text[-1] in "kmgtpezyrq":
        unit, text = 1000.0 ** ("kmgtpezyrq".index(text[-1]) + 1), text[:-1]
    return float(text) * unit


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"expression: can't read {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    """Postfix ! binds tightest, then ^ (to the right), signs, * / %, + -, comparisons."""

    LEVELS = [("<", ">", "<=", ">=", "==", "!="), ("+", "-"), ("*", "/", "%")]

    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, lex(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise ValueError(f"expression {self.text!r}: expected {op!r}")
        self.at += 1

    def parse(self):
        tree = self.binary(0)
        if self.at != len(self.tokens):
            raise ValueError(f"expression {self.text!r}: something follows its end")
        return tree

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.sign()
        left = self.binary(level + 1)
        while (op := self.peek()) in self.LEVELS[level]:
            self.at += 1
            left = Call(op, (left, self.binary(level + 1)))
        return left

    def sign(self):
        if (op := self.peek()) in ("+", "-"):
            self.at += 1
            inner = self.sign()
            return inner if op == "+" else Call("neg", (inner,))
        return self.power()

    def power(self):
        base = self.postfix()
        if self.peek() == "^":
            self.at += 1
            return Call("^", (base, self.sign()))
        return base

    def postfix(self):
        inner = self.primary()
        while self.peek() == "!":
            self.at += 1
            inner = Call("!", (inner,))
        return inner

    def primary(self):
        if self.at >= len(self.tokens):
            raise ValueError(f"expression {self.text!r} ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Number(_number(text))
        if kind == "radix":
            return Number(float(int(text, 0)))
        if kind == "roman":
            return Number(float(roman_value(text[2:])))
        if kind == "dice":
            n, sides = text.split("d")
            return Dice(int(n), int(sides))
        if kind == "span":
            return Span(text[1:-1])
        if kind == "name":
            if self.peek() == "(":
                self.at += 1
                args = []
                while self.peek() != ")":
                    args.append(self.binary(0))
                    if self.peek() == ",":
                        self.at += 1
                self.take(")")
                return Call(text, tuple(args))
            return Name(text)
        if text == "(":
            tree = self.binary(0)
            self.take(")")
            return tree
        raise ValueError(f"expression {self.text!r}: {text!r} is out of place")


# ---- code generation ----


def _d(x: float) -> Column:
    return F.lit(float(x))


def _signed(x: Column) -> Column:
    """Whether the sign bit is set (-0.0 included)."""
    return F.when(F.isnan(x), F.lit(False)).otherwise((x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-"))))


def _bool(c: Column) -> Column:
    return F.when(c, _d(1)).otherwise(_d(0))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != _d(math.inf))


def divide(a: Column, b: Column) -> Column:
    at_zero = F.when((a == 0) | F.isnan(a), _d(math.nan)).when((a > 0) != _signed(b), _d(math.inf)).otherwise(_d(-math.inf))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def remainder(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == _d(math.inf)), _d(math.nan)).when(F.abs(b) == _d(math.inf), a).otherwise(F.try_mod(a, b))


def _whole(x: Column, f: Callable[[Column], Column]) -> Column:
    """f through BIGINT where it fits; larger numbers, infinities and NaN are whole already."""
    return F.when(_finite(x) & (F.abs(x) < _d(2.0**53)), f(x).cast("double")).otherwise(x)


def trunc(x: Column) -> Column:
    return _whole(x, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)))


def _log(f: Callable[[Column], Column], edge: float = 0.0):
    return lambda x: F.when(F.isnan(x) | (x < edge), _d(math.nan)).when(x == edge, _d(-math.inf)).otherwise(f(x))


def _domain(f: Callable[[Column], Column], ok: Callable[[Column], Column]):
    return lambda x: F.when(ok(x), f(x)).otherwise(_d(math.nan))


def _no_nan(f: Callable[..., Column]):
    """Minimum or maximum that passes over NaN; NaN if there is nothing else."""

    def build(*args: Column) -> Column:
        clean = [F.when(F.isnan(a), F.lit(None).cast("double")).otherwise(a) for a in args]
        return F.coalesce(f(*clean) if len(clean) > 1 else clean[0], _d(math.nan))

    return build


def _factorial(x: Column) -> Column:
    table = F.array(*[_d(float(math.factorial(k))) for k in range(171)])
    n = _whole(x, F.floor)
    return F.when(F.isnan(x), _d(math.nan)).when(x < 0, _d(0)).when(n > 170, _d(math.inf)).otherwise(F.element_at(table, F.least(F.greatest(n, _d(0)), _d(170)).cast("int") + 1))


def _round(x: Column) -> Column:
    return _whole(x, lambda v: F.when(v < 0, -F.floor(-v + 0.5)).otherwise(F.floor(v + 0.5)))


def _rem_euclid(a: Column, b: Column) -> Column:
    r = remainder(a, b)
    return F.when(r < 0, r + F.abs(b)).otherwise(r)


def _div_euclid(a: Column, b: Column) -> Column:
    q = trunc(divide(a, b))
    return F.when(remainder(a, b) < 0, F.when(b > 0, q - 1).otherwise(q + 1)).otherwise(q)


def _total(x: Column) -> Column:
    """Rank of kinds: below zero, -0, 0, above zero, NaN."""
    return F.when(F.isnan(x), 4).when(x < 0, 0).when(x > 0, 3).when(_signed(x), 1).otherwise(2)


def _total_cmp(a: Column, b: Column) -> Column:
    ka, kb = _total(a), _total(b)
    return F.when(ka < kb, _d(-1)).when(ka > kb, _d(1)).when(a < b, _d(-1)).when(a > b, _d(1)).otherwise(_d(0))


def _neighbour(x: Column, up: bool) -> Column:
    """The next double above or below, by numpy in Arrow batches: no built-in gives the bits of a double."""
    @F.pandas_udf("double")
    def step(s: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(s.to_numpy(), np.inf if up else -np.inf))

    return step(x)


def _fused(a: Column, b: Column, c: Column) -> Column:
    @F.pandas_udf("double")
    def fma(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([math.fma(p, q, r) if all(map(math.isfinite, (p, q, r))) else p * q + r for p, q, r in zip(x, y, z)], dtype="float64")

    return fma(a, b, c)


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs),
    "acos": (1, F.acos),
    "acosh": (1, F.acosh),
    "asin": (1, F.asin),
    "asinh": (1, F.asinh),
    "atan": (1, F.atan),
    "atan2": (2, lambda x, y: F.atan2(y, x)),  # the first argument is x, the second y
    "atanh": (1, F.atanh),
    "cbrt": (1, F.cbrt),
    "ceil": (1, lambda x: _whole(x, F.ceil)),
    "clamp": (3, lambda x, lo, hi: F.when(F.isnan(x), x).otherwise(F.greatest(lo, F.least(x, hi)))),
    "copysign": (2, lambda x, y: F.abs(x) * F.when(_signed(y), _d(-1)).otherwise(_d(1))),
    "cos": (1, F.cos),
    "cosh": (1, F.cosh),
    "div_euclid": (2, _div_euclid),
    "exp": (1, F.exp),
    "exp2": (1, lambda x: F.pow(_d(2), x)),
    "exp_m1": (1, F.expm1),
    "floor": (1, lambda x: _whole(x, F.floor)),
    "fract": (1, lambda x: x - trunc(x)),
    "hypot": (2, F.hypot),
    "is_finite": (1, lambda x: _bool(_finite(x))),
    "is_infinite": (1, lambda x: _bool(F.abs(x) == _d(math.inf))),
    "is_nan": (1, lambda x: _bool(F.isnan(x))),
    "is_normal": (1, lambda x: _bool(_finite(x) & (F.abs(x) >= _d(_TINY)))),
    "is_sign_negative": (1, lambda x: _bool(_signed(x))),
    "is_sign_positive": (1, lambda x: _bool(~_signed(x))),
    "is_subnormal": (1, lambda x: _bool((F.abs(x) > 0) & (F.abs(x) < _d(_TINY)))),
    "ln": (1, _log(F.ln)),
    "ln_1p": (1, _log(F.log1p, -1.0)),
    "log": (2, lambda x, base: divide(_log(F.ln)(x), _log(F.ln)(base))),
    "log2": (1, _log(F.log2)),
    "log10": (1, _log(F.log10)),
    "max": (-1, _no_nan(F.greatest)),
    "midpoint": (2, lambda a, b: (a + b) / 2),
    "min": (-1, _no_nan(F.least)),
    "mul_add": (3, _fused),
    "next_down": (1, lambda x: _neighbour(x, False)),
    "next_up": (1, lambda x: _neighbour(x, True)),
    "powf": (2, F.pow),
    "powi": (2, lambda x, n: F.pow(x, trunc(n))),
    "recip": (1, lambda x: divide(_d(1), x)),
    "rem_euclid": (2, _rem_euclid),
    "round": (1, _round),
    "round_ties_even": (1, F.rint),
    "signum": (1, lambda x: F.when(F.isnan(x), x).when(_signed(x), _d(-1)).otherwise(_d(1))),
    "sin": (1, F.sin),
    "sinh": (1, F.sinh),
    "sqrt": (1, _domain(F.sqrt, lambda x: x >= 0)),
    "tan": (1, F.tan),
    "tanh": (1, F.tanh),
    "trunc": (1, trunc),
    "to_degrees": (1, F.degrees),
    "to_radians": (1, F.radians),
    "total_cmp": (2, _total_cmp),
    "if": (3, lambda c, a, b: F.when(c != 0, a).otherwise(b)),
    "avg": (-1, lambda *xs: sum(xs[1:], xs[0]) / len(xs)),
}
_OPERATORS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
    "%": remainder,
    "^": F.pow,
    "<": lambda a, b: _bool((a < b) & ~F.isnan(b)),
    ">": lambda a, b: _bool((a > b) & ~F.isnan(a)),
    "<=": lambda a, b: _bool((a <= b) & ~F.isnan(b)),
    ">=": lambda a, b: _bool((a >= b) & ~F.isnan(a)),
    "==": lambda a, b: _bool((a == b) & ~F.isnan(a)),
    "!=": lambda a, b: _bool((a != b) | F.isnan(a)),
    "neg": lambda a: -a,
    "!": _factorial,
}
_INVERSE_TRIG, _TRIG = {"asin", "acos", "atan", "atan2"}, {"sin", "cos", "tan"}


def compile_expr(text: str, resolve: Callable[[str], Column | None], spans: Callable[[str], Sequence[Column]] | None = None, degrees: bool = False, seed: int | None = None) -> Column:
    """A double Column. resolve gives a name's double Column or None; spans the double Columns of a [range]."""
    drawn = iter(range(seed, seed + 10_000)) if seed is not None else None

    def many(trees) -> list[Column]:
        out: list[Column] = []
        for t in trees:
            if isinstance(t, Span):
                if spans is None:
                    raise ValueError(f"expression {text!r}: no columns for [{t.text}]")
                out += spans(t.text)
            else:
                out.append(one(t))
        return out

    def one(tree) -> Column:
        if isinstance(tree, Number):
            return _d(tree.value)
        if isinstance(tree, Dice):
            rolls = [F.floor((F.rand(next(drawn)) if drawn else F.rand()) * tree.sides) + 1 for _ in range(tree.count)]
            return sum(rolls[1:], rolls[0]).cast("double") if rolls else _d(0)
        if isinstance(tree, Span):
            found = many([tree])
            if len(found) != 1:
                raise ValueError(f"expression {text!r}: [{tree.text}] must be one column here")
            return found[0]
        if isinstance(tree, Name):
            if tree.name in CONSTANTS:
                return _d(CONSTANTS[tree.name])
            found = resolve(tree.name)
            if found is None:
                raise ValueError(f"expression {text!r}: no column or constant {tree.name!r}")
            return found
        args = many(tree.args)
        if tree.name in _OPERATORS:
            return _OPERATORS[tree.name](*args)
        if tree.name not in FUNCTIONS:
            raise ValueError(f"expression {text!r}: no function {tree.name!r}")
        arity, build = FUNCTIONS[tree.name]
        if len(args) != arity and (arity >= 0 or not args):
            raise ValueError(f"expression {text!r}: {tree.name} takes {arity if arity >= 0 else 'at least 1'} arguments, not {len(args)}")
        if degrees and tree.name in _TRIG:
            args = [F.radians(a) for a in args]
        out = build(*args)
        return F.degrees(out) if degrees and tree.name in _INVERSE_TRIG else out

    return one(Parser(text).parse())


def names_in(text: str) -> set[str]:
    """Names of an expression that aren't constants."""
    found: set[str] = set()

    def walk(t) -> None:
        if isinstance(t, Name) and t.name not in CONSTANTS:
            found.add(t.name)
        if isinstance(t, Call):
            for a in t.args:
                walk(a)

    walk(Parser(text).parse())
    return found
