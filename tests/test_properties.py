"""Properties over generated values, each example one Spark job over a whole list."""

import math
import os
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from colsmith.functions import expr as X
from colsmith.functions import numfmt
from colsmith.functions import text as T
from colsmith.functions.keys import Comparator
from colsmith.functions.match import matcher

FEW = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
WORDS = s.lists(s.text(alphabet="ab1.-+eEkK 9ñ,", max_size=8), min_size=1, max_size=60)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def each(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("i").select(*cols).collect()]


def lenient(text):
    m = re.match(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text)
    if not m:
        return 0.0 * (1 if not text else 1)
    unit = text[m.end() : m.end() + 1]
    scale = 1024.0 ** ("KMGTPEZYRQ".index(unit) + 1) if unit and unit in "KMGTPEZYRQ" else 1000.0 ** ("kmgtpezyrq".index(unit) + 1) if unit and unit in "kmgtpezyrq" else 1.0
    return float(m[0]) * scale


@FEW
@given(WORDS)
def test_lenient_numbers(spark, words):
    for got, w in zip(each(column(spark, words), T.lossy_double(F.col("v"))), words):
        assert got == lenient(w) or math.isclose(got, lenient(w), rel_tol=1e-12), w


@FEW
@given(WORDS)
def test_common_affixes(spark, words):
    got = column(spark, words).agg(T.common_prefix(F.min("v"), F.max("v")), T.common_suffix(F.min(F.reverse("v")), F.max(F.reverse("v")))).first()
    assert tuple(got) == (os.path.commonprefix(words), os.path.commonprefix([w[::-1] for w in words])[::-1])


@FEW
@given(s.lists(s.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=60))
def test_formats_read_back(spark, numbers):
    for (p, f), n in zip(each(column(spark, numbers, "double"), numfmt.plain(F.col("v")), numfmt.floating(F.col("v"))), numbers):
        assert float(p) == n and float(f) == n and "e" not in p.lower() and re.fullmatch(r"-?[0-9](\.[0-9]+)?e-?[0-9]+", f)


@FEW
@given(WORDS, s.text(alphabet="ab1", min_size=1, max_size=3))
def test_matchers_as_python(spark, words, p):
    got = each(column(spark, words), *[matcher(m + p)(F.col("v")) for m in ("prefix,", "suffix,", "infix,", "exact,", "range,>", "keep,")])
    for g, w in zip(got, words):
        assert g == (w.startswith(p), w.endswith(p), p in w, w == p, w.encode() > p.encode(), all(w.count(c) >= p.count(c) for c in p)), w


@FEW
@given(s.lists(s.tuples(s.integers(-(10**30), 10**30), s.integers(0, 999)), min_size=2, max_size=40))
def test_numeric_order(spark, pairs):
    from decimal import Decimal

    texts = [f"{a}.{b:03d}" for a, b in pairs]
    df = column(spark, texts)
    got = [r["v"] for r in df.orderBy(Comparator.parse("numeric").key(F.col("v")), "i").collect()]
    assert [Decimal(x) for x in got] == sorted(Decimal(x) for x in texts)


OPERANDS = s.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3))


@FEW
@given(s.lists(s.tuples(OPERANDS, OPERANDS), min_size=1, max_size=40))
def test_arithmetic_as_ieee(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    get = lambda t: X.compile_expr(t, lambda n: F.col(n) if n in ("a", "b") else None)
    rows = each(df, get("a+b*2"), get("a/b"), get("if(a<b,a,b)"), get("rem_euclid(a,b)"), get("max(a,b)-min(a,b)"), get("-a^2"))
    for (add, div, low, rem, gap, square), (a, b) in zip(rows, pairs):
        assert add == a + b * 2 and low == (a if a < b else b) and gap == max(a, b) - min(a, b) and math.isclose(square, -(a * a))
        assert div == a / b if b else (math.isnan(div) if a == 0 else math.isinf(div))
        assert math.isnan(rem) if b == 0 else 0 <= rem <= abs(b)
