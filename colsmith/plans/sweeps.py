"""Registered queries that go through whole tables of functions, matchers, modes and file forms, each with SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsmith.functions.agg import AGGREGATORS, COUNTERS
from colsmith.functions.expr import CONSTANTS
from colsmith.functions.keys import COMPARATORS
from colsmith.functions.match import MATCHERS, matcher
from colsmith.functions.numfmt import format_num
from colsmith.functions.trans import TRANSFORMS, transform
from colsmith.operators import filter as flt
from colsmith.operators import generate as gen
from colsmith.operators import join as jn
from colsmith.operators import sort as st
from colsmith.operators.count import count
from colsmith.operators.generate import GENERATORS
from colsmith.operators.project import cut
from colsmith.operators.search import search
from colsmith.operators.terminal import tabs
from colsmith.operators.unique import unique
from colsmith.plans.queries import ORACLE_SQL, QUERIES, query, t  # noqa: F401  (the entry module takes both tables from here)
from colsmith.session import new_path
from colsmith.sources import scan, sink
from colsmith.sources.spec import MARK, parse

# ---- expressions ----

#: name: (expression, SQL), over line items. Every function but those that only edge values tell apart.
_FUNCTIONS = {
    "abs": ("abs(l_tax-l_discount)", "abs(l_tax - l_discount)"), "acos": ("acos(l_discount)", "acos(l_discount)"), "acosh": ("acosh(l_quantity)", "acosh(l_quantity)"),
    "asin": ("asin(l_discount)", "asin(l_discount)"), "asinh": ("asinh(l_quantity)", "asinh(l_quantity)"), "atan": ("atan(l_quantity)", "atan(l_quantity)"),
    "atan2": ("atan2(l_quantity,l_tax+1)", "atan2(l_tax + 1, l_quantity)"), "atanh": ("atanh(l_discount)", "atanh(l_discount)"), "avg": ("avg(l_quantity,l_tax,l_discount)", "(l_quantity + l_tax + l_discount) / 3"),
    "cbrt": ("cbrt(l_extendedprice)", "cbrt(l_extendedprice)"), "ceil": ("ceil(l_extendedprice/7)", "ceil(l_extendedprice / 7)"), "clamp": ("clamp(l_quantity,10,40)", "greatest(10, least(40, l_quantity))"),
    "copysign": ("copysign(l_quantity,l_discount-0.055)", "CASE WHEN l_discount < 0.055 THEN -l_quantity ELSE l_quantity END"), "cos": ("cos(l_quantity)", "cos(l_quantity)"), "cosh": ("cosh(l_discount*10)", "(exp(l_discount * 10) + exp(-l_discount * 10)) / 2"),
    "div_euclid": ("div_euclid(-l_quantity,l_linenumber)", "floor(-l_quantity / l_linenumber)"), "div_euclid_down": ("div_euclid(-l_quantity,-l_linenumber)", "ceil(l_quantity / l_linenumber)"),
    "exp": ("exp(l_discount*10)", "exp(l_discount * 10)"), "exp2": ("exp2(l_discount*10)", "2 ** (l_discount * 10)"), "exp_m1": ("exp_m1(l_discount)", "exp(l_discount) - 1"), "floor": ("floor(-l_extendedprice/7)", "floor(-l_extendedprice / 7)"),
    "fract": ("fract(l_extendedprice/7)", "l_extendedprice / 7 - trunc(l_extendedprice / 7)"), "hypot": ("hypot(l_quantity,l_linenumber)", "sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber)"), "if": ("if(l_quantity>25,l_tax,l_discount)", "CASE WHEN l_quantity > 25 THEN l_tax ELSE l_discount END"),
    "ln": ("ln(l_quantity)", "ln(l_quantity)"), "ln_1p": ("ln_1p(l_quantity)", "ln(1 + l_quantity)"), "log": ("log(l_quantity,3)", "ln(l_quantity) / ln(3)"), "log2": ("log2(l_quantity)", "log2(l_quantity)"), "log10": ("log10(l_quantity)", "log10(l_quantity)"),
    "max": ("max(l_quantity,l_tax*100,30)", "greatest(l_quantity, l_tax * 100, 30)"), "min": ("min(l_quantity,l_tax*100,30)", "least(l_quantity, l_tax * 100, 30)"), "midpoint": ("midpoint(l_quantity,l_linenumber)", "(l_quantity + l_linenumber) / 2"),
    "mul_add": ("mul_add(l_quantity,l_linenumber,l_discount)", "l_quantity * l_linenumber + l_discount"), "next_down": ("(l_quantity-next_down(l_quantity))*2^50", "(l_quantity - nextafter(l_quantity, '-inf'::DOUBLE)) * 2 ** 50"), "next_up": ("(next_up(l_quantity)-l_quantity)*2^50", "(nextafter(l_quantity, 'inf'::DOUBLE) - l_quantity) * 2 ** 50"),
    "powf": ("powf(l_quantity,0.3)", "l_quantity ** 0.3::DOUBLE"), "powi": ("powi(l_quantity,3)", "l_quantity * l_quantity * l_quantity"), "recip": ("recip(l_quantity)", "1 / l_quantity"), "rem_euclid": ("rem_euclid(-l_quantity,l_linenumber)", "((-l_quantity % l_linenumber) + l_linenumber) % l_linenumber"),
    "round": ("round(-l_quantity/2)", "-floor(l_quantity / 2 + 0.5)"), "round_ties_even": ("round_ties_even(l_quantity/2)", "round_even(l_quantity / 2, 0)"), "signum": ("signum(l_discount-0.055)", "CASE WHEN l_discount < 0.055 THEN -1 ELSE 1 END"),
    "sin": ("sin(l_quantity)", "sin(l_quantity)"), "sinh": ("sinh(l_discount*10)", "(exp(l_discount * 10) - exp(-l_discount * 10)) / 2"), "sqrt": ("sqrt(l_quantity)", "sqrt(l_quantity)"), "tan": ("tan(l_discount)", "tan(l_discount)"), "tanh": ("tanh(l_discount*10)", "1 - 2 / (exp(l_discount * 20) + 1)"),
    "to_degrees": ("to_degrees(l_discount)", "degrees(l_discount)"), "to_radians": ("to_radians(l_quantity)", "radians(l_quantity)"), "total_cmp": ("total_cmp(l_quantity,l_linenumber*8)", "sign(l_quantity - l_linenumber * 8)"), "trunc": ("trunc(-l_extendedprice/7)", "trunc(-l_extendedprice / 7)"),
    "number_forms": ("0rXLII+0x1F+0b101+0o17+1K+l_quantity", "42 + 31 + 5 + 15 + 1024 + l_quantity"), "factorial": ("l_linenumber!", "factorial(CAST(l_linenumber AS INT))"), "precedence": ("-l_linenumber^2+2*3%4", "-(CAST(l_linenumber AS DOUBLE) ** 2) + 2"),
}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f'round(CAST({sql} AS DOUBLE), 6) + 0.0 AS "f_{n}"' for n, (_, sql) in _FUNCTIONS.items()) + " FROM lineitem")
def expr_functions(spark, sf):
    df = cut(t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", *[("e", f"f_{n}:{text}") for n, (text, _) in _FUNCTIONS.items()])
    return df.select("l_orderkey", "l_linenumber", *[(F.round(f"f_{n}", 6) + F.lit(0.0)).alias(f"f_{n}") for n in _FUNCTIONS])


_EDGES = ["NaN", "Infinity", "-Infinity", "0.0", "-0.0", "5e-324", "-5e-324", "2.2250738585072014e-308", "1.7976931348623157e308", "1.0", "-1.0", "0.5", "-0.5", "2.5", "-2.5", "3.7", "-3.7", "1e300", "-1e300", "1e-300", "100.0", "-7.0", "7.0", "0.1", "12345.678"]
_MOST, _TINY = "1.7976931348623157e308", "2.2250738585072014e-308"
_NAN = "'nan'::DOUBLE"
_DIV = "CASE WHEN isnan({a}) OR isnan({b}) OR ({a} = 0 AND {b} = 0) OR (isinf({a}) AND isinf({b})) THEN 'nan'::DOUBLE WHEN {b} = 0 THEN CASE WHEN signbit({a}) = signbit({b}) THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE {a} / {b} END"
#: name: (expression, SQL) over pairs (x, y) of edge values.
_AT_EDGES = {
    "is_finite": ("is_finite(x)", "CASE WHEN isfinite(x) THEN 1 ELSE 0 END"), "is_infinite": ("is_infinite(x)", "CASE WHEN isinf(x) THEN 1 ELSE 0 END"), "is_nan": ("is_nan(x)", "CASE WHEN isnan(x) THEN 1 ELSE 0 END"),
    "is_normal": ("is_normal(x)", f"CASE WHEN isfinite(x) AND abs(x) >= {_TINY}::DOUBLE THEN 1 ELSE 0 END"), "is_subnormal": ("is_subnormal(x)", f"CASE WHEN abs(x) > 0 AND abs(x) < {_TINY}::DOUBLE THEN 1 ELSE 0 END"),
    "is_sign_negative": ("if(is_nan(x),0,is_sign_negative(x))", "CASE WHEN NOT isnan(x) AND signbit(x) THEN 1 ELSE 0 END"), "is_sign_positive": ("if(is_nan(x),0,is_sign_positive(x))", "CASE WHEN NOT isnan(x) AND NOT signbit(x) THEN 1 ELSE 0 END"),
    "signum": ("signum(x)", f"CASE WHEN isnan(x) THEN {_NAN} WHEN signbit(x) THEN -1 ELSE 1 END"), "copysign": ("if(is_nan(y),0,copysign(x,y))", f"CASE WHEN isnan(y) THEN 0 WHEN isnan(x) THEN {_NAN} WHEN signbit(y) THEN -abs(x) ELSE abs(x) END"),
    "max": ("max(x,y)", "CASE WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE greatest(x, y) END"), "min": ("min(x,y)", "CASE WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE least(x, y) END"),
    "total_cmp": ("if(is_nan(x)+is_nan(y)>0,0,total_cmp(x,y))", "CASE WHEN isnan(x) OR isnan(y) THEN 0 WHEN x < y THEN -1 WHEN x > y THEN 1 WHEN signbit(x) AND NOT signbit(y) THEN -1 WHEN signbit(y) AND NOT signbit(x) THEN 1 ELSE 0 END"),
    "trunc": ("trunc(x)", "trunc(x)"), "floor": ("floor(x)", "floor(x)"), "ceil": ("ceil(x)", "ceil(x)"), "round": ("round(x)", "CASE WHEN abs(x) < 1e15 THEN sign(x) * floor(abs(x) + 0.5) ELSE x END"), "ties_even": ("round_ties_even(x)", "CASE WHEN abs(x) < 1e15 THEN round_even(x, 0) ELSE x END"),
    "divide": ("x/y", _DIV.format(a="x", b="y")), "recip": ("recip(x)", _DIV.format(a="1.0::DOUBLE", b="x")), "remainder": ("x%y", f"CASE WHEN isnan(x) OR isnan(y) OR isinf(x) OR y = 0 THEN {_NAN} WHEN isinf(y) THEN x ELSE fmod(x, y) END".replace("fmod(x, y)", "x % y")),
    "clamp": ("clamp(x,-1,1)", f"CASE WHEN isnan(x) THEN {_NAN} ELSE greatest(-1, least(x, 1)) END"), "sqrt": ("sqrt(x)", f"CASE WHEN isnan(x) OR x < 0 THEN {_NAN} ELSE sqrt(x) END"), "ln": ("ln(x)", f"CASE WHEN isnan(x) OR x < 0 THEN {_NAN} WHEN x = 0 THEN '-inf'::DOUBLE ELSE ln(x) END"),
    "less": ("x<y", "CASE WHEN NOT isnan(x) AND NOT isnan(y) AND x < y THEN 1 ELSE 0 END"), "at_least": ("x>=y", "CASE WHEN NOT isnan(x) AND NOT isnan(y) AND x >= y THEN 1 ELSE 0 END"), "equal": ("x==y", "CASE WHEN NOT isnan(x) AND NOT isnan(y) AND x = y THEN 1 ELSE 0 END"), "unequal": ("x!=y", "CASE WHEN isnan(x) OR isnan(y) OR x <> y THEN 1 ELSE 0 END"),
}


def _shown(c: Column) -> Column:
    """Values that any engine compares alike: infinities and NaN as marks, tiny and large ones by their logarithm."""
    plain = F.when(c == 0, 0.0).when((F.abs(c) < 1e-6) | (F.abs(c) > 1e9), F.signum(c) * (1e6 + F.round(F.log10(F.abs(c)), 6))).otherwise(F.round(c, 6))
    return F.when(c.isNull() | F.isnan(c), -777777.0).when(c == math.inf, 888888.0).when(c == -math.inf, -888888.0).otherwise(plain)


def _shown_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN -777777.0 WHEN isinf({c}) THEN sign({c}) * 888888.0 WHEN {c} = 0 THEN 0.0 WHEN abs({c}) < 1e-6 OR abs({c}) > 1e9 THEN sign({c}) * (1e6 + round(log10(abs({c})), 6)) ELSE round({c}, 6) END::DOUBLE"


@query(
    f"WITH v AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, [{', '.join(repr(v) for v in _EDGES)}] AS vs FROM nation), e AS (SELECT a, b, CAST(vs[CAST(a AS INT) + 1] AS DOUBLE) AS x, CAST(vs[CAST(b AS INT) + 1] AS DOUBLE) AS y FROM v), "
    f"f AS (SELECT a, {', '.join(f'CAST({sql} AS DOUBLE) AS f_{n}' for n, (_, sql) in _AT_EDGES.items())} FROM e) SELECT a, {', '.join(f'{_shown_sql(f"f_{n}")} AS f_{n}' for n in _AT_EDGES)} FROM f"
)
def expr_edges(spark, sf):
    at = lambda k: F.element_at(F.array(*[F.lit(float(v)) for v in _EDGES]), k.cast("int") + 1)
    df = t(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), at(F.col("n_nationkey")).alias("x"), at((F.col("n_nationkey") * 7 + 3) % 25).alias("y"))
    df = cut(df, "a", *[("e", f"f_{n}:{text}") for n, (text, _) in _AT_EDGES.items()])
    return df.select("a", *[_shown(F.col(f"f_{n}")).alias(f"f_{n}") for n in _AT_EDGES])


_CONSTANT_SQL = {
    "pi": "pi()", "e": "exp(1.0)", "EULER_GAMMA": "0.5772156649015329", "FRAC_1_PI": "1 / pi()", "FRAC_1_SQRT_2": "1 / sqrt(2)", "FRAC_2_SQRT_PI": "2 / sqrt(pi())", "FRAC_PI_2": "pi() / 2", "FRAC_PI_3": "pi() / 3", "FRAC_PI_4": "pi() / 4",
    "FRAC_PI_6": "pi() / 6", "FRAC_PI_8": "pi() / 8", "FRAC_2_PI": "2 / pi()", "GOLDEN_RATIO": "(1 + sqrt(5)) / 2", "LN_2": "ln(2)", "LN_10": "ln(10)", "LOG2_10": "log2(10)", "LOG2_E": "1 / ln(2)", "LOG10_2": "log10(2)", "LOG10_E": "1 / ln(10)",
    "SQRT_2": "sqrt(2)", "TAU": "2 * pi()", "DIGITS": "15", "EPSILON": "nextafter(1::DOUBLE, 2::DOUBLE) - 1", "INFINITY": "'inf'", "MANTISSA_DIGITS": "53", "MAX": _MOST, "MAX_10_EXP": "308", "MAX_EXP": "1024", "MIN": f"-{_MOST}", "MIN_10_EXP": "-307",
    "MIN_EXP": "-1021", "MIN_POSITIVE": _TINY, "NAN": "'nan'", "NEG_INFINITY": "'-inf'", "RADIX": "2",
}
_CONSTANT_SQL |= {"PI": _CONSTANT_SQL["pi"], "E": _CONSTANT_SQL["e"]}


@query(f"SELECT name, {_shown_sql('v')} AS v FROM (SELECT name, CAST(v AS DOUBLE) AS v FROM ({' UNION ALL '.join(f'SELECT {n!r} AS name, CAST({v} AS DOUBLE) AS v' for n, v in _CONSTANT_SQL.items())}))")
def expr_constants(spark, sf):
    one = spark.range(1)
    rows = [cut(one, ("e", f"v:{n}")).select(F.lit(n).alias("name"), "v") for n in CONSTANTS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("name", _shown(F.col("v")).alias("v"))


# ---- number formats ----

_PRICE = "CAST(o_totalprice AS VARCHAR)"
_DIGITS = f"rtrim(replace({_PRICE}, '.', ''), '0')"
_SHORTEST = f"substr({_DIGITS}, 1, 1) || CASE WHEN length({_DIGITS}) > 1 THEN '.' || substr({_DIGITS}, 2) ELSE '' END || 'e' || (length(split_part({_PRICE}, '.', 1)) - 1)"


@query(f"SELECT o_orderkey, {_SHORTEST} AS float, regexp_replace(printf('%.3e', o_totalprice + 0.0001), 'e[+]0*', 'e') AS float3 FROM orders")
def numfmt_float(spark, sf):
    x = F.col("o_totalprice")
    return t(spark, sf, "orders").select("o_orderkey", format_num(x, "float").alias("float"), format_num(x + 0.0001, "float.3").alias("float3"))


@query(f"SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN regexp_replace({_PRICE}, '[.]0$', '') ELSE {_SHORTEST} END AS short, printf('%.2f', o_orderkey % 900 + 0.25) AS short2 FROM orders")
def numfmt_short(spark, sf):
    out = t(spark, sf, "orders").select("o_orderkey", format_num(F.col("o_totalprice"), "short").alias("short"))
    return out.withColumn("short2", format_num(F.col("o_orderkey") % 900 + 0.25, "short.2"))


@query(
    """SELECT p_partkey, (p_size // gcd(p_size, 4)) || '/' || (4 // gcd(p_size, 4)) AS rational,
    CASE WHEN p_size % 8 = 0 THEN CAST(p_size // 8 AS VARCHAR) ELSE CASE WHEN p_size < 8 THEN '' ELSE (p_size // 8) || '+' END || ((p_size % 8) // gcd(p_size % 8, 8)) || '/' || (8 // gcd(p_size % 8, 8)) END AS dyadic,
    CASE WHEN p_size % 8 = 0 THEN '-' || (p_size // 8) ELSE '-' || (p_size // gcd(p_size, 8)) || '/' || (8 // gcd(p_size, 8)) END AS pulled FROM part"""
)
def numfmt_fractions(spark, sf):
    x = F.col("p_size").cast("double")
    return t(spark, sf, "part").select("p_partkey", format_num(x / 4, "rational").alias("rational"), format_num(x / 8, "dyadic").alias("dyadic"), format_num(-x / 8, "dyadic,pulled").alias("pulled"))


# ---- matchers, determiners, comparators ----

#: Text of many shapes, one a part by its key.
_SHAPES = ["12", "-3", "4.5", ".5", "5.", "1e3", "-1.5E-2", "abc", "", "1,000", "+7", "12a", " ", "# note", "  // note", "1.2.3.4", "256.1.1.1", "1.2.3", "01.2.3.4", "255.255.0.9", "-", "1x", "0", "7 "]


def _shape_column() -> Column:
    return F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % len(_SHAPES)).cast("int") + 1)


_SHAPE_SQL = f"(SELECT p_partkey, [{', '.join(repr(s) for s in _SHAPES)}][CAST(p_partkey % {len(_SHAPES)} AS INT) + 1] AS v FROM part)"
_IP_SQL = "len(string_split(v, '.')) = 4 AND len(list_filter(string_split(v, '.'), lambda x: CAST(TRY_CAST(x AS UTINYINT) AS VARCHAR) = x)) = 4"
_NUMBER_SQL = {
    "float": "v <> '' AND TRY_CAST(v AS DOUBLE) IS NOT NULL AND v NOT IN ('+7', '5.', '7 ')", "integer": "TRY_CAST(v AS BIGINT) IS NOT NULL AND v IN (CAST(TRY_CAST(v AS BIGINT) AS VARCHAR), '-0')", "number": "v IN ('12', '-3', '4.5', '0')", "ip": _IP_SQL,
    "empty": "length(v) = 0", "blank": "trim(v) = ''", "hash": "trim(v) = '' OR starts_with(ltrim(v), '#')", "slash": "trim(v) = '' OR starts_with(ltrim(v), '//')", "yes": "true", "no": "false",
}


@query("SELECT p_partkey, v, " + ", ".join(f"coalesce({sql}, false) AS is_{n}" for n, sql in _NUMBER_SQL.items()) + f" FROM {_SHAPE_SQL}")
def match_shapes(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", _shape_column().alias("v"))
    return df.select("p_partkey", "v", *[matcher(n)(F.col("v")).alias(f"is_{n}") for n in _NUMBER_SQL])


@query(f"SELECT p_partkey, v FROM {_SHAPE_SQL} WHERE {_NUMBER_SQL['float']} AND NOT coalesce({_NUMBER_SQL['integer']}, false)")
def grep_number_formats(spark, sf):
    return flt.grep(t(spark, sf, "part").select("p_partkey", _shape_column().alias("v")), "v,float", "v,integer.not")


_YES = " + ".join(f"CAST(regexp_matches({c}, '^[AFN1-3]') AS INT)" for c in ("l_returnflag", "l_linestatus", "CAST(l_linenumber AS VARCHAR)"))
_DETERMINERS = {
    "some": "n > 0", "all": "n = 3", "none": "n = 0", "notall": "n < 3", "mixed": "n > 0 AND n < 3", "uniform": "n = 0 OR n = 3", "atmost.1": "n <= 1", "atleast.2": "n >= 2", "exactly.2": "n = 2",
    "atmostno.1": "3 - n <= 1", "atleastno.2": "3 - n >= 2", "exactlyno.1": "3 - n = 1", "atleast.0.6": "n >= 2",
}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{sql} AS {n.replace('.', '_')}" for n, sql in _DETERMINERS.items()) + f" FROM (SELECT *, {_YES} AS n FROM lineitem)")
def grep_determiners(spark, sf):
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return df.select("l_orderkey", "l_linenumber", *[flt.predicate(df, f"[{n},l_returnflag,l_linestatus,l_linenumber],regex,^[AFN1-3]").alias(n.replace(".", "_")) for n in _DETERMINERS])


@query("SELECT o_orderkey, o_orderstatus, o_orderstatus = 'F' AS kept FROM orders")
def grep_split_others(spark, sf):
    both = flt.grep_split(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus,exact,F")
    return both.matching.withColumn("kept", F.lit(True)).unionByName(both.others.withColumn("kept", F.lit(False)))


_STRICT = "CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(v AS DOUBLE)"


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {_STRICT} ELSE '-inf'::DOUBLE END, p_partkey) AS low, row_number() OVER (ORDER BY {_STRICT} ELSE 'inf'::DOUBLE END, p_partkey) AS high, row_number() OVER (ORDER BY p_partkey) AS equal FROM {_SHAPE_SQL}")
def sort_modifiers(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", _shape_column().alias("v"))
    for name, method in (("low", "float.strict.low"), ("high", "float.strict"), ("equal", "equal")):
        df = st.rank(df, [f"v,{method}"], ["p_partkey"], name)
    return df.drop("v")


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS different, CAST(count(*) AS BIGINT) AS last FROM part")
def sort_random(spark, sf):
    return st.sort(t(spark, sf, "part").select("p_partkey"), ["p_partkey,random"]).agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("different"), F.count("p_partkey").alias("last"))


# ---- cut, cat, verify, uniq, wc, binsearch ----


@query("SELECT n_nationkey, upper(n_name) AS n_name, lower(n_name) || '' AS low, n_name AS n_name1, n_name AS n_name2 FROM nation")
def cut_transform_duplicates(spark, sf):
    return cut(t(spark, sf, "nation"), "n_nationkey", "n_name+upper", "low:n_name+lower", "n_name", "n_name", duplicates="numeric")


@query("SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, substr(base64(encode(text)), 1, 5) || substr(base64(encode(text)), 7, 2) AS b FROM documents")
def trans_upper_bytes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", transform("upper")(F.col("text")).alias("up"), transform("to_base64+bytes,1-5,7-8")(F.col("text")).alias("b"))


@query(
    """SELECT 'first' AS rule, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1) WHERE NOT o_orderkey > 100
    UNION ALL SELECT 'last', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1) WHERE NOT o_orderkey < 100"""
)
def verify_edges(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return flt.verify(df, ["o_orderkey"], sort_keys=["o_orderkey,float"], first="float,>100", last="float,<100").drop("line")


@query("SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(28,8))) AS DOUBLE) AS o_totalprice, max(o_orderpriority) AS worst FROM orders GROUP BY o_custkey")
def uniq_replace_before(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    out = unique(df, ["o_custkey,float"], ["o_orderkey"], replace=["o_totalprice,sum,exact"], before=["worst,o_orderpriority,max"], count="n,begin", is_sorted=True, as_string=False)
    return out.select("o_custkey", "n", "o_totalprice", "worst")


def _power_sql(x: str) -> str:
    cases = [f"WHEN {x} < 1000 THEN CAST({x} AS VARCHAR)"]
    for k, letter in enumerate("KMGT", 1):
        u = f"1024::DOUBLE ** {k}"
        cases += [f"WHEN {x} <= 999 * {u} AND {x} > 9.9 * {u} THEN CAST(CAST(ceil({x} / {u}) AS BIGINT) AS VARCHAR) || '{letter}'", f"WHEN {x} <= 999 * {u} AND {x} > {u} THEN printf('%.1f', ceil({x} * 10 / {u}) / 10) || '{letter}'", f"WHEN {x} <= 999 * {u} THEN '1{letter}'"]
    return "CASE " + " ".join(cases) + " END"


@query(f"SELECT f AS file, {_power_sql('l')} AS lines, {_power_sql('c')} AS chars, {_power_sql('m')} AS commas FROM (SELECT coalesce(lang, 'totals') AS f, count(*) AS l, CAST(sum(length(text)) AS BIGINT) AS c, CAST(sum(length(text) - length(replace(text, ',', ''))) AS BIGINT) AS m FROM documents GROUP BY ROLLUP (lang))")
def wc_aggregates_format(spark, sf):
    df = t(spark, sf, "documents").select("lang", F.col("text").alias("_line"))
    return count(df, ["l", "c", "commas,asum,occurs,,"], by="lang", totals="maybe", fmt="power2")


@query("SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 10")
def binsearch_parts(spark, sf):
    return search(t(spark, sf, "orders").drop("o_orderdate"), ["o_orderstatus", "o_custkey,float"], "F,10", ["o_orderkey"])


@query("SELECT CAST(coalesce(l.k, r.k) AS VARCHAR) AS k, coalesce(CAST(c_custkey AS VARCHAR), '-') AS c_custkey, coalesce(CAST(s_suppkey AS VARCHAR), '-') AS s_suppkey FROM (SELECT c_nationkey AS k, c_custkey FROM customer) l FULL JOIN (SELECT s_nationkey + 10 AS k, s_suppkey FROM supplier) r ON l.k = r.k")
def join_poly(spark, sf):
    left = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    right = t(spark, sf, "supplier").select((F.col("s_nationkey") + 10).alias("k"), "s_suppkey")
    return jn.join_full(left, right, ["k"], "outer", "-")


# ---- generators, help ----


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS decimals, CAST(1000 AS BIGINT) AS normals, CAST(1000 AS BIGINT) AS dice, true AS spread")
def gen_random(spark, sf):
    df = gen.generate(spark, ["decimal,-NNN.NN", "normal,10,2,plain.3", "expr,3d6"], 1000, seed=5)
    ok = lambda c: F.count_if(c)
    mean, dev = F.avg(F.col("c2").cast("double")), F.stddev(F.col("c2").cast("double"))
    # 1000 draws: the mean is within six standard errors, the deviation likewise.
    spread = (F.abs(mean - 10) < 6 * 2 / math.sqrt(1000)) & (F.abs(dev - 2) < 6 * 2 / math.sqrt(2000)) & (F.count_distinct("c1") > 900) & (F.count_distinct("c3") >= 10)
    return df.agg(F.count("*").alias("n"), ok(F.col("c1").rlike("^-?[0-9]{3}[.][0-9]{2}$")).alias("decimals"), ok(F.col("c2").rlike("^-?[0-9]+[.][0-9]{3}$") & F.col("c2").cast("double").between(-10, 30)).alias("normals"), ok(F.col("c3").cast("int").between(3, 18)).alias("dice"), spread.alias("spread"))


@query("SELECT a.r_name || ',' || b.r_name AS c1 FROM region a JOIN region b ON a.r_regionkey <= b.r_regionkey")
def gen_combine_r(spark, sf):
    names = [r["r_name"] for r in t(spark, sf, "region").orderBy("r_regionkey").collect()]
    return gen.generate(spark, [f"combine-r,2:{','.join(names)}"]).drop("_row")


@query("SELECT CAST(5000 AS BIGINT) AS n, true AS in_range, true AS many")
def gen_bytes(spark, sf):
    data = gen.random_bytes(5000, seed=3)
    return spark.createDataFrame([(len(data), max(data) <= 254, len(set(data)) > 200)], "n long, in_range boolean, many boolean")


_ANA_WORDS = "(SELECT lower(w) AS w, count(*) AS f FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE regexp_full_match(lower(w), '[a-z]+') GROUP BY 1)"


def _fits(left: str, letters: str) -> str:
    return " AND ".join(f"length({left}) - length(replace({left}, '{c}', '')) <= {letters.count(c)}" for c in "abcdefghijklmnopqrstuvwxyz")


def _anagram_words(spark, sf):
    return t(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query(f"SELECT w AS value FROM {_ANA_WORDS} WHERE {_fits('w', 'the quick brown fox jumps over the lazy dog')}")
def sub_anagrams_phrase(spark, sf):
    return gen.sub_anagrams(_anagram_words(spark, sf), "The quick brown fox jumps over the lazy dog").select(F.lower("value").alias("value"))


_PHRASE = "blue cold rod ring"


def _sorted(x: str) -> str:
    return f"list_sort(list_filter(string_split({x}, ''), lambda c: c BETWEEN 'a' AND 'z'))"


@query(
    f"""WITH RECURSIVE pool AS (SELECT w, max(f) AS f, row_number() OVER (ORDER BY w) AS i FROM {_ANA_WORDS} WHERE {_fits('w', _PHRASE)} GROUP BY w),
    c AS (SELECT i, w AS words, ln(f) AS score FROM pool UNION ALL SELECT p.i, c.words || ' ' || p.w, c.score + ln(p.f) FROM c JOIN pool p ON p.i >= c.i WHERE {_fits("(c.words || p.w)", _PHRASE)})
    SELECT words AS anagram, round(score, 6) AS score FROM c WHERE {_sorted('words')} = {_sorted(repr(_PHRASE))}"""
)
def anagram_phrase(spark, sf):
    out = gen.anagrams(_anagram_words(spark, sf), _PHRASE, frequency="n")
    return out.select("anagram", F.round("score", 6).alias("score"))


def _names(registry) -> list[str]:
    return [n for n, _ in registry.describe()]


_HELP = {
    "match": "regex prefix suffix infix exact glob keep reject range length empty blank comment hash slash float integer number ip yes no file-exact solve", "comp": "plain lower float numeric length ip equal random",
    "agg": "count sum mean min max merge prefix suffix asum amin amax amean", "count": "chars swords awords occurs", "trans": "lower upper normspace from_base64 to_base64 bytes select", "gen": "grid null count expr decimal normal combine combine-r permute permute-r",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, v in _HELP.items() for n in v.split()) + ") v(topic, name)")
def help_names(spark, sf):
    found = {"match": MATCHERS, "comp": COMPARATORS, "agg": AGGREGATORS, "count": COUNTERS, "trans": TRANSFORMS, "gen": GENERATORS}
    return spark.createDataFrame([(k, n) for k, r in found.items() for n in _names(r)], "topic string, name string")


@query("SELECT value FROM (SELECT 0 AS k, 'r_regionkey r_name' AS value UNION ALL SELECT 1 + r_regionkey, rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' ' || r_name FROM region)")
def tabs_region(spark, sf):
    return spark.createDataFrame([(x,) for x in tabs(t(spark, sf, "region").orderBy("r_regionkey"), 80, 30)], "value string")


# ---- files ----


def _written(spark, df, o: sink.Output, packed: bool = False) -> str:
    path = new_path(spark, "text")
    if packed:
        sink.lines(df, o).select("value").write.option("compression", "gzip").text(path)
    else:
        sink.write(df, path, o)
    return path


def _hard(spark, sf):
    """Values with quotes, delimiters, line ends and backslashes in them."""
    v = F.concat("n_name", F.lit(',"'), F.lit("\n\\"), F.col("n_regionkey").cast("string"), F.lit("\t\""), F.when(F.col("n_nationkey") % 2 == 0, F.lit("\\")).otherwise(F.lit("")))
    return t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("k"), v.alias("v"))


_HARD = "(SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name || ',\"' || chr(10) || chr(92) || n_regionkey || chr(9) || '\"' || CASE WHEN n_nationkey % 2 = 0 THEN chr(92) ELSE '' END AS v FROM nation)"


@query(f"SELECT * FROM {_HARD}")
def file_csv_quoted(spark, sf):
    """Quotes, doubled quotes and line ends within them, written and read back."""
    path = _written(spark, _hard(spark, sf), sink.derived(parse("csv"), "plain"))
    return scan.read_text(spark, path, "csv,h=yes").select("k", "v")


@query(f"SELECT * FROM {_HARD}")
def file_tsv_backslash(spark, sf):
    path = _written(spark, _hard(spark, sf), sink.derived(parse("tsv"), "plain"))
    return scan.read_text(spark, path, "tsv,h=yes").select("k", "v")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag FROM lineitem")
def file_marked_header(spark, sf):
    df = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    return scan.read_text(spark, _written(spark, df, sink.Output("|", header="marked"))).select("key", "line", "flag")


@query("SELECT CAST(p_partkey AS VARCHAR) AS c1, p_name AS c2, p_brand AS c3 FROM part")
def file_gzip(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return scan.read_text(spark, _written(spark, df, sink.Output(), packed=True)).select("c1", "c2", "c3")


def _moved(spark, path: str, to: str) -> None:
    """A folder's only part, under another name."""
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(P(path)) if s.getPath().getName().startswith("part-"))
    fs.rename(part, P(to))


def _joined(spark, path: str, to: str) -> None:
    """A folder's parts, in order, as one file; they pass through a buffer of fixed size."""
    P, copy = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(P(to))
    for name in sorted(n for s in fs.listStatus(P(path)) if (n := s.getPath().getName()).startswith("part-")):
        part = fs.open(P(path, name))
        copy(part, out, 1 << 20, False)
        part.close()
    out.close()
    fs.delete(P(path), True)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS c1, n_name AS c2 FROM nation")
def file_gzip_misnamed(spark, sf):
    df = t(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1)
    path = _written(spark, df, sink.Output(), packed=True)
    _moved(spark, path, f"{path}.txt")
    return scan.read_text(spark, f"{path}.txt").select("c1", "c2")


_ORDER_LINE = "o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority"


@query(
    f"""WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS line, {_ORDER_LINE} AS value FROM orders)
    SELECT line, sum(strlen(value) + 2) OVER (ORDER BY line) - strlen(value) - 1 AS bytes, value FROM l"""
)
def file_crlf_bom_location(spark, sf):
    """A byte order mark, lines that end in two characters, and each line's number and place."""
    df = t(spark, sf, "orders").orderBy("o_orderkey")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    first = F.when(F.col("o_orderkey") == F.lit(t(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]), F.lit("﻿")).otherwise(F.lit(""))
    path = new_path(spark, "crlf")
    df.select(F.concat(first, line).alias("value")).write.option("lineSep", "\r\n").text(path)
    _joined(spark, path, f"{path}.csv")
    df = flt.location(scan.read_text(spark, f"{path}.csv", "whole"), "bytes,line")
    return df.select("line", "bytes", F.col("_line").alias("value"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS c1, n_name AS c2, CAST(n_regionkey AS VARCHAR) AS c3, '::' AS form FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR), 'drop' FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), '  ' || n_name, chr(9) || n_regionkey, 'keep' FROM nation")
def file_delimiters(spark, sf):
    """A delimiter of several characters; runs of white space, dropped or kept."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    wide = scan.read_text(spark, _written(spark, t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), sink.Output("::", "trust")), "text,d=str:::").select("c1", "c2", "c3", F.lit("::").alias("form"))
    spaced = n.select(F.concat("n_nationkey", F.lit("  "), "n_name", F.lit("\t"), "n_regionkey").alias("v"))
    path = _written(spark, spaced, sink.Output("|", "trust"))
    dropped = scan.read_text(spark, path, "text,d=white-drop").select("c1", "c2", "c3", F.lit("drop").alias("form"))
    kept = scan.read_text(spark, path, "text,d=white-keep").select("c1", "c2", "c3", F.lit("keep").alias("form"))
    return wide.unionByName(dropped).unionByName(kept)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c1, c_name AS c2, 'GET /' || c_nationkey AS c3, CAST(5 AS BIGINT) AS fields FROM customer")
def file_log(spark, sf):
    v = F.concat(F.col("c_custkey").cast("string"), F.lit(" ["), "c_name", F.lit('] "GET /'), F.col("c_nationkey").cast("string"), F.lit('" - 200'))
    path = _written(spark, t(spark, sf, "customer").select(v.alias("v")), sink.Output("\x01", "trust"))
    return scan.read_text(spark, path, "log").select("c1", "c2", "c3", F.col("_ncols").cast("long").alias("fields"))


@query("SELECT c_custkey || ',' || c_name AS c1 FROM customer")
def file_whole(spark, sf):
    path = _written(spark, t(spark, sf, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("v")), sink.Output("\t", "trust"))
    return flt.grep(scan.read_text(spark, path, "whole"), ",count,1").select("c1")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS c1, lag(o_orderkey || chr(9) || o_orderstatus) OVER (ORDER BY o_orderkey) AS before FROM orders")
def previous_lines(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return scan.previous_line(df, ["o_orderkey"]).select(F.col("o_orderkey").cast("string").alias("c1"), F.col("_before").alias("before"))


@query("SELECT * FROM (VALUES ('a', 'b c', 1), ('', 'd', 2)) v(c1, c2, line)")
def scan_inline(spark, sf):
    return scan.read_lines(spark, "<<a\\tb\\sc\\n\\td\\n").select("c1", "c2", F.col("_row").cast("int").alias("line"))


_Q, _B, _T = "'\"'", "chr(92)", "chr(9)"
_BACK = f"replace(replace(replace(v, {_B}, {_B} || {_B}), chr(10), {_B} || 'n'), {_T}, {_B} || 't')"
_MODES = {
    "quote-doubled": f"{_Q} || replace(v, {_Q}, {_Q} || {_Q}) || {_Q}", "always-quote-doubled": f"{_Q} || replace(v, {_Q}, {_Q} || {_Q}) || {_Q}",
    "quote-backslash": f"{_Q} || replace(replace(v, {_B}, {_B} || {_B}), {_Q}, {_B} || {_Q}) || {_Q}", "always-quote-backslash": f"{_Q} || replace(replace(v, {_B}, {_B} || {_B}), {_Q}, {_B} || {_Q}) || {_Q}",
    "backslash": _BACK, "trust": "v", "replace:.": f"replace(replace(v, chr(10), '.'), {_T}, '.')", "delete": f"replace(replace(v, chr(10), ''), {_T}, '')",
}


@query("SELECT k, " + ", ".join(f"{k} || {_T} || {sql} AS m{i}" for i, sql in enumerate(_MODES.values()) for k in [f"{_Q} || k || {_Q}" if "always" in list(_MODES)[i] else "k"]) + f", k AS m_error FROM {_HARD}")
def sink_escape_modes(spark, sf):
    """Every escape mode over hard values; the ninth, which is an error there, over plain ones."""
    df = _hard(spark, sf).withColumn("_v", F.struct("k", "v"))
    out = df
    for i, mode in enumerate(_MODES):
        o = sink.Output("\t", mode)
        out = out.withColumn(f"m{i}", F.concat_ws("\t", sink.escaped(F.col("k"), o), sink.escaped(F.col("v"), o)))
    return out.withColumn("m_error", sink.escaped(F.col("k"), sink.Output("\t", "error"))).drop("v", "_v")


@query(f"SELECT '{MARK}' || chr(9) || 'r_regionkey' || chr(9) || 'r_name' AS header, '\"A,B\",' AS quoted, 'A.B' AS spaced")
def sink_headers_derived(spark, sf):
    """The marked header line, and the escapes that follow from an input's format."""
    one = spark.createDataFrame([("A,B", ""), ], "a string, b string")
    head = sink.header_line(t(spark, sf, "region"), sink.Output(header="marked"))
    quoted = sink.lines(one, sink.derived(parse("csv"))).first()["value"]
    spaced = sink.lines(spark.createDataFrame([("A B",)], "a string"), sink.derived(parse("text,d=space"))).first()["value"]
    return spark.createDataFrame([(head, quoted, spaced)], "header string, quoted string, spaced string")
