"""Numbers as text: plain, float, short, power2, power10, rational, roman, dyadic."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS2, _LETTERS10 = "KMGTPEZYRQ", "kmgtpezyrq"


def _digits(x: Column) -> tuple[Column, Column]:
    """(significant digits, exponent of the first one) of a finite number other than 0, from its shortest form."""
    text = F.abs(x).cast("string")
    mantissa = F.regexp_extract(text, "^([0-9.]+)", 1)
    exponent = F.coalesce(F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.when(F.instr(mantissa, ".") > 0, F.substring_index(mantissa, ".", -1)).otherwise("")
    part = F.when(part == "0", "").otherwise(part)
    all_digits = F.concat(whole, part)
    bare = F.regexp_replace(all_digits, "^0+", "")
    leading = F.char_length(all_digits) - F.char_length(bare)
    digits = F.regexp_replace(bare, "0+$", "")
    return digits, exponent + F.char_length(whole) - 1 - leading


def _special(x: Column, finite: Column) -> Column:
    return F.when(F.isnan(x), "NaN").when(x == F.lit(math.inf), "inf").when(x == F.lit(-math.inf), "-inf").otherwise(finite)


def _sign(x: Column) -> Column:
    return F.when((x < 0) | F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")


def plain(x: Column, places: int | None = None) -> Column:
    """Shortest text that reads back as the same number, never with an exponent; or a fixed number of decimals."""
    if places is not None:
        return _special(x, F.format_string(f"%.{places}f", x))
    digits, exp = _digits(x)
    n = F.char_length(digits)
    big = F.rpad(digits, exp + 1, "0")
    mid = F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, n))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    body = F.when(x == 0, "0").when(exp < 0, small).when(n <= exp + 1, big).otherwise(mid)
    # From 0.001 to 10,000,000 the shortest form has no exponent and is the text itself; only other numbers are taken apart.
    text, a = x.cast("string"), F.abs(x)
    bare = F.when(F.endswith(text, F.lit(".0")), F.substring(text, F.lit(1), F.char_length(text) - 2)).otherwise(text)
    return F.when((a >= 0.001) & (a < 1e7), bare).otherwise(_special(x, F.concat(_sign(x), body)))


def floating(x: Column, places: int | None = None) -> Column:
    """Mantissa, e, exponent: 27 is 2.7e1."""
    if places is not None:
        text = F.format_string(f"%.{places}e", x)
        body = F.concat(F.regexp_extract(text, "^([^e]*)e", 1), F.lit("e"), F.regexp_extract(text, "e(.*)$", 1).try_cast("int").cast("string"))
        return _special(x, body)
    digits, exp = _digits(x)
    rest = F.substring(digits, F.lit(2), F.char_length(digits))
    body = F.concat(F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), exp.cast("string"))
    return _special(x, F.concat(_sign(x), F.when(x == 0, "0e0").otherwise(body)))


def short(x: Column, places: int | None = None) -> Column:
    a = F.abs(x)
    return F.when((a == 0) | ((a >= 0.0001) & (a < 1000)), plain(x, places)).otherwise(floating(x, places))


def _power(x: Column, base: float, letters: str) -> Column:
    """At most five characters, rounded up: 1025 is 1.1K."""
    a = F.abs(x)
    out = F.when(a < 1000, F.rint(F.least(a, F.lit(1000.0))).cast("bigint").cast("string"))
    unit = 1.0
    for k in range(11):
        letter = letters[k - 1] if k else "0"
        small = F.least(a, F.lit(999.0 * unit))  # branches are computed for all rows under some plans; none may overflow
        tenths = F.ceil(small * 10.0 / F.lit(unit)).cast("double") / 10.0
        out = out.when((a <= 999.0 * unit) & (a > 9.9 * unit), F.concat(F.format_string("%.0f", F.ceil(small / F.lit(unit)).cast("double")), F.lit(letter)))
        out = out.when((a <= 999.0 * unit) & (a > unit), F.concat(F.format_string("%.1f", tenths), F.lit(letter)))
        out = out.when(a <= 999.0 * unit, F.lit("1" + letter))
        if k < 10:
            unit *= base
    out = out.otherwise(F.concat(F.rint(a / F.lit(unit)).cast("decimal(38,0)").cast("string"), F.lit(letters[-1])))
    return _special(x, F.concat(F.when(x < 0, "-").otherwise(""), out))


def power2(x: Column) -> Column:
    return _power(x, 1024.0, _LETTERS2)


def power10(x: Column) -> Column:
    return _power(x, 1000.0, _LETTERS10)


def roman(x: Column) -> Column:
    """I to MMMCMXCIX, N for 0, a bracketed message beyond."""
    n = F.rint(x).try_cast("bigint")
    tables = [["", "M", "MM", "MMM"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]]
    safe = F.when((n >= 1) & (n <= 3999), n).otherwise(F.lit(1))
    parts = [F.element_at(F.array(*map(F.lit, t)), ((F.floor(safe / d) % 10) + 1).cast("int")) for t, d in zip(tables, (1000, 100, 10, 1))]
    return F.when(n == 0, "N").when((n >= 1) & (n <= 3999), F.concat(*parts)).otherwise(F.concat(F.lit("["), n.cast("string"), F.lit(" is out of range]")))


def rational_text(x: float, digits: int = 3) -> str:
    """The fraction with the least part that is within 10^-digits of x, relatively."""
    if not math.isfinite(x):
        return {math.inf: "inf", -math.inf: "-inf"}.get(x, "NaN")
    if x == 0:
        return "0/1"
    a, slop = abs(x), 10.0**-digits
    k = 1
    while True:
        other = math.floor(k / a + 0.5) if a < 1 else math.floor(a * k + 0.5)
        p, q = (k, other) if a < 1 else (other, k)
        if q and abs(a - p / q) <= slop * a:
            return f"{'-' if x < 0 else ''}{p}/{q}"
        k += 1


def dyadic_text(x: float, mode: str = "") -> str:
    """Whole and binary fraction as a carpenter writes it: 2.375 is 2+3/8; mode: pulled writes one fraction, a number the bits kept."""
    if not math.isfinite(x):
        return {math.inf: "inf", -math.inf: "-inf"}.get(x, "NaN")
    bits = int(mode) if mode.isdigit() else 6
    n = math.floor(abs(x) * (1 << bits) + 0.5)
    den = 1 << bits
    while den > 1 and n % 2 == 0:
        n, den = n // 2, den // 2
    sign = "-" if x < 0 else ""
    if mode == "debug":
        return f"{sign}{n}/2^{den.bit_length() - 1}"
    if den == 1:
        return f"{sign}{n}"
    if mode == "pulled" or n < den:
        return f"{sign}{n}/{den}"
    return f"{sign}{n // den}+{n % den}/{den}"


def _batched(f, *args):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(float(v), *args) for v in s], dtype="object")

    return run


def format_num(x: Column, spec: str = "plain") -> Column:
    """x as text by a spec such as plain.2, float, short, power2 (p2), power10 (p10), rational.4, roman or dyadic,pulled."""
    m = re.fullmatch(r"([a-z]+[0-9]*?)(?:\.(\d+))?(?:,(.*))?", spec or "plain")
    name, places, arg = (m[1], int(m[2]) if m[2] else None, m[3] or "") if m else (spec, None, "")
    x = x.cast("double")
    if name in ("plain", "float", "short"):
        return {"plain": plain, "float": floating, "short": short}[name](x, places)
    if name in ("power2", "p2", "power10", "p10"):
        return power2(x) if name in ("power2", "p2") else power10(x)
    if name == "roman":
        return roman(x)
    if name == "rational":
        return _batched(rational_text, 3 if places is None else places)(x)
    if name == "dyadic":
        return _batched(dyadic_text, arg)(x)
    raise ValueError(f"no number format {spec!r}")


def is_format(spec: str) -> bool:
    return re.fullmatch(r"(plain|float|short|power2|power10|p2|p10|rational|roman|dyadic)(\.\d+)?(,.*)?", spec) is not None
