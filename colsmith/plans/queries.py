"""Registered queries of the line and column operators, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsmith.functions.agg import counter
from colsmith.functions.match import in_file
from colsmith.functions.numfmt import format_num
from colsmith.functions.trans import transform
from colsmith.operators import filter as flt
from colsmith.operators import generate as gen
from colsmith.operators import join as jn
from colsmith.operators import sort as st
from colsmith.operators.count import count, count_columns
from colsmith.operators.project import cut
from colsmith.operators.sample import sample_even, sample_every, sample_ranges
from colsmith.operators.search import search
from colsmith.operators.transpose import transpose
from colsmith.operators.unique import distinct_lines, group_aggregate, unique
from colsmith.operators.zip import paste
from colsmith.operators.terminal import calc
from colsmith.plans.ordering import number_rows
from colsmith.sources import sink
from colsmith.sources.scan import read_lines
from colsmith.sources.spec import MARK
from colsmith.streaming import rows as stream_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- cut ----


@query("SELECT c_custkey AS id, c_name, c_mktsegment AS segment, c_acctbal FROM customer")
def cut_ranges_rename(spark, sf):
    return cut(t(spark, sf, "customer"), "id:1,2", "segment:c_mktsegment", "+2")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def cut_negation(spark, sf):
    return cut(t(spark, sf, "customer"), "~c_nationkey,~c_acctbal")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def cut_names_by_matcher(spark, sf):
    return cut(t(spark, sf, "part"), "p_partkey,(regex,name|brand|type)")


@query("SELECT n_nationkey || '.' || n_name AS both, 'nation ' || n_name || ' of ' || n_regionkey || '^' AS label FROM nation")
def cut_composite_group(spark, sf):
    return cut(t(spark, sf, "nation"), ("g", ".both:1-2"), ("c", "label:nation ^{n_name} of ^{n_regionkey}^^"))


@query(
    """SELECT l_extendedprice * (1 - l_discount) AS net, greatest(l_quantity, l_tax * 100, l_discount * 100) AS m, floor(l_extendedprice / 7) AS f,
    CASE WHEN l_discount = 0 THEN CASE WHEN l_tax = 0 THEN -1.0 ELSE 1.0 END ELSE 0.0 END AS z, l_quantity % 7 AS r, l_quantity ^ 2 AS p FROM lineitem"""
)
def cut_expr_math(spark, sf):
    df = t(spark, sf, "lineitem")
    return cut(df, ("e", "net:l_extendedprice*(1-l_discount)"), ("e", "m:max(l_quantity,l_tax*100,l_discount*100)"), ("e", "f:floor(l_extendedprice/7)"), ("e", "z:if(l_discount==0,if(l_tax==0,-1,1),0)"), ("e", "r:l_quantity%7"), ("e", "p:l_quantity^2"))


@query(
    """SELECT round(sqrt(l_quantity), 9) AS a, round(ln(l_quantity), 9) AS b, round(atan2(l_quantity, l_tax + 1), 9) AS c, round(radians(l_quantity), 9) AS d,
    CAST(sign(l_discount - 0.05 + 1e-9) AS DOUBLE) AS e, CASE WHEN l_quantity < 25 THEN trunc(-l_quantity / 3) ELSE trunc(l_quantity / 3) END + 0.0 AS f FROM lineitem"""
)
def cut_expr_functions(spark, sf):
    df = cut(
        t(spark, sf, "lineitem"), ("e", "a:sqrt(l_quantity)"), ("e", "b:ln(l_quantity)"), ("e", "c:atan2(l_tax+1,l_quantity)"), ("e", "d:to_radians(l_quantity)"), ("e", "e:signum(l_discount-0.05+1e-9)"), ("e", "f:if(l_quantity<25,trunc(-l_quantity/3),trunc(l_quantity/3))")
    )
    return df.select(*[F.round(c, 9).alias(c) for c in "abcd"], "e", F.expr("f + 0.0D").alias("f"))


@query("SELECT l_orderkey, l_quantity + l_tax + l_discount AS sum, (l_quantity + l_tax + l_discount) / 3 AS mean, 3::BIGINT AS count FROM lineitem")
def cut_rowwise_agg(spark, sf):
    return cut(t(spark, sf, "lineitem"), "l_orderkey", "l_quantity,l_tax,l_discount::sum+mean+count", as_string=False)


# ---- transforms ----


@query("SELECT doc_id, lower(text) AS low, trim(regexp_replace(text, '[\\x00-\\x20]+', ' ', 'g')) AS norm, substr(base64(encode(text)), 1, 5) || substr(base64(encode(text)), 9, 3) AS b FROM documents")
def trans_case_space_bytes(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", transform("lower.utf8")(c).alias("low"), transform("normspace")(c).alias("norm"), transform("to_base64+bytes,1-5,9-11")(c).alias("b"))


@query("SELECT r_regionkey, base64(encode(r_name)) AS packed, r_name AS unpacked FROM region")
def trans_base64_roundtrip(spark, sf):
    c = F.col("r_name")
    return t(spark, sf, "region").select("r_regionkey", transform("to_base64")(c).alias("packed"), transform("to_base64+from_base64")(c).alias("unpacked"))


@query("SELECT p_partkey, string_split(p_name, ' ')[2] || '-' || string_split(p_name, ' ')[1] AS swapped FROM part")
def trans_select(spark, sf):
    return t(spark, sf, "part").select("p_partkey", transform("select,s-2,1")(F.col("p_name")).alias("swapped"))


# ---- cgrep ----

_GREPS = {
    "grep_glob": ("part", ["p_type,glob,*A?*"], {}, "p_type GLOB '*A?*'"),
    "grep_prefix": ("part", ["p_name,prefix.case,S"], {}, "starts_with(lower(p_name), 's')"),
    "grep_suffix": ("part", ["p_name,suffix,e"], {}, "ends_with(p_name, 'e')"),
    "grep_infix": ("documents", ["text,infix.or.case,^the^und"], {}, "contains(lower(text), 'the') OR contains(lower(text), 'und')"),
    "grep_exact": ("events", ["event_type,exact,click"], {}, "event_type = 'click'"),
    "grep_regex": ("pages", ["url,,[0-9]+$"], {}, "regexp_matches(url, '[0-9]+$')"),
    "grep_length": ("documents", ["text,length.utf8,100,2000"], {}, "length(text) BETWEEN 100 AND 2000"),
    "grep_range": ("orders", ["o_totalprice,range,float,>=1000<50000", "o_orderpriority,range,>=2<4"], {}, "o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderpriority >= '2' AND o_orderpriority < '4'"),
    "grep_keep_reject": ("part", ["p_name,keep,ee", "p_name,reject,aa"], {}, "length(p_name) - length(replace(p_name, 'e', '')) >= 2 AND length(p_name) - length(replace(p_name, 'a', '')) < 2"),
    "grep_or_and_not": ("orders", ["o_orderstatus,exact,F", "o_orderpriority,prefix.not,1"], {"any_of": True}, "o_orderstatus = 'F' OR NOT starts_with(o_orderpriority, '1')"),
    "grep_invert": ("orders", ["o_orderstatus,exact,F", "o_orderpriority,prefix,1"], {"invert": True}, "NOT (o_orderstatus = 'F' AND starts_with(o_orderpriority, '1'))"),
    "grep_determiner": ("lineitem", ["[atleast.2,l_returnflag,l_linestatus,l_quantity],regex,^[AF1]"], {}, "(CAST(regexp_matches(l_returnflag, '^[AF1]') AS INT) + CAST(regexp_matches(l_linestatus, '^[AF1]') AS INT) + CAST(regexp_matches(CAST(l_quantity AS VARCHAR), '^[AF1]') AS INT)) >= 2"),
    "grep_comp_columns": ("lineitem", ["l_quantity,comp,>l_linenumber,float"], {}, "l_quantity > l_linenumber"),
    "grep_expr": ("lineitem", [",expr,l_quantity*l_discount>2"], {}, "l_quantity * l_discount > 2"),
    "grep_blank_comment": ("documents", ["lang,comment.not,e", "source,blank.not"], {}, "NOT starts_with(lang, 'e') AND trim(source) <> ''"),
    "grep_length_bytes": ("part", ["p_brand,length,1,9"], {}, "strlen(p_brand) BETWEEN 1 AND 9"),
}


def _grep(name: str, table: str, patterns: list[str], options: dict, where: str) -> None:
    times = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"], "events": ["ts"]}.get(table, [])
    QUERIES[name] = lambda spark, sf: flt.grep(t(spark, sf, table).drop(*times), *patterns, **options)
    ORACLE_SQL[name] = f"SELECT *{f' EXCLUDE ({times[0]})' if times else ''} FROM {table} WHERE {where}"


for _n, _a in _GREPS.items():
    _grep(_n, *_a)


@query("SELECT o.* EXCLUDE (o_orderdate) FROM orders o SEMI JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'")
def grep_file_exact(spark, sf):
    keys = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return in_file(t(spark, sf, "orders").drop("o_orderdate"), "o_custkey", keys, "c_custkey")


@query("SELECT o.* EXCLUDE (o_orderdate) FROM orders o ANTI JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'")
def grep_file_exact_not(spark, sf):
    keys = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return in_file(t(spark, sf, "orders").drop("o_orderdate"), "o_custkey", keys, "c_custkey", negate=True)


# ---- cat, verify ----


@query("SELECT CASE WHEN event_type = 'view' THEN '' ELSE CAST(CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS BIGINT) + 9 AS VARCHAR) END AS line, event_id, event_type FROM events")
def cat_number_skip(spark, sf):
    df = t(spark, sf, "events").select("event_id", "event_type")
    return flt.number(df, ["event_id"], "line", 10, skip=["exact,view"], line=F.col("event_type"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def cat_concat(spark, sf):
    both = flt.concat([t(spark, sf, "nation").select(F.col("n_name").alias("name")), t(spark, sf, "region").select("r_name")], "strip")
    return both.drop("_file_no")


@query("SELECT event_id, event_type FROM events WHERE NOT (starts_with(event_type, 'c') OR event_type = 'view')")
def cat_remove(spark, sf):
    df = t(spark, sf, "events").select("event_id", F.col("event_type").alias("_line"), "event_type")
    return flt.remove(df, "prefix,c", "exact,view").drop("_line")


@query(
    """SELECT 'o_totalprice,range,float,<300000' AS rule, o_orderkey FROM orders WHERE NOT o_totalprice < 300000
    UNION ALL SELECT 'o_orderstatus,regex,[OF]', o_orderkey FROM orders WHERE NOT regexp_matches(o_orderstatus, '[OF]')
    UNION ALL SELECT 'sort', o_orderkey FROM (SELECT *, lag(o_custkey) OVER (ORDER BY o_orderkey) AS b FROM orders) WHERE o_custkey < b"""
)
def verify_report(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    keyed = df.withColumn("_line", F.lit(""))
    return flt.verify(keyed, ["o_orderkey"], ["o_totalprice,range,float,<300000", "o_orderstatus,regex,[OF]"], sort_keys=["o_custkey,float"]).drop("line")


# ---- sort ----


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer")
def sort_multi_key_rank(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return st.rank(df, ["c_mktsegment", "c_acctbal,float.rev"], ["c_custkey"]).select("c_custkey", "rn")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_top(spark, sf):
    return st.top(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 100, ["o_totalprice,float.rev"], ["o_orderkey"])


@query("SELECT arg_min(o_orderkey, o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def sort_unique(spark, sf):
    return st.sort(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey,float"], ["o_orderkey"], unique=True)


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY lower(p_name), p_partkey) AS BIGINT) AS rn FROM part")
def sort_lower(spark, sf):
    return st.rank(t(spark, sf, "part").select("p_partkey", "p_name"), ["p_name,lower"], ["p_partkey"]).drop("p_name")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY strlen(p_name) DESC, p_partkey) AS BIGINT) AS rn FROM part")
def sort_length(spark, sf):
    return st.rank(t(spark, sf, "part").select("p_partkey", "p_name"), ["p_name,length.rev"], ["p_partkey"]).drop("p_name")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY user_id % 256, user_id % 7, event_id % 100, event_id) AS BIGINT) AS rn FROM events")
def sort_ip(spark, sf):
    df = t(spark, sf, "events").select("event_id", F.concat_ws(".", (F.col("user_id") % 256).cast("string"), (F.col("user_id") % 7).cast("string"), (F.col("event_id") % 100).cast("string")).alias("ip"))
    return st.rank(df, ["ip,ip"], ["event_id"]).drop("ip")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS rn FROM customer")
def sort_numeric_text(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", F.format_number("c_acctbal", 2).alias("v"))
    return st.rank(df, ["v,numeric"], ["c_custkey"]).drop("v")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal * c_nationkey, c_custkey) AS BIGINT) AS rn FROM customer")
def sort_expr(spark, sf):
    return st.rank(t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), [",expr,c_acctbal*c_nationkey"], ["c_custkey"]).select("c_custkey", "rn")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS b FROM events) WHERE event_type < b")
def sort_check(spark, sf):
    return st.check(t(spark, sf, "events").select("event_id", "event_type"), ["event_id"], ["event_type"])


@query("SELECT k, min(o) AS o FROM (SELECT c_nationkey AS k, 0 AS o FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY k")
def sort_merge_unique(spark, sf):
    a = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit(0).alias("o"))
    b = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("o"))
    return st.merge([a, b], ["k,float"], ["o"], unique=True)


# ---- join ----

_RIGHT = "(SELECT *, c_custkey % 700 AS k, row_number() OVER (PARTITION BY c_custkey % 700 ORDER BY c_custkey) AS rn FROM customer)"


def _sides(spark, sf):
    left = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    right = t(spark, sf, "customer").select((F.col("c_custkey") % 700).alias("k"), "c_custkey", "c_name")
    return left, right


@query(f"SELECT o_custkey AS k, o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN {_RIGHT} c ON o_custkey = c.k AND rn = 1")
def join_first_match(spark, sf):
    left, right = _sides(spark, sf)
    return jn.join(left, right, ["k"], right_row=["c_custkey"]).matching


@query("SELECT o_custkey AS k, o_orderkey, o_totalprice FROM orders ANTI JOIN customer ON o_custkey = c_custkey % 700")
def join_unmatched_left(spark, sf):
    left, right = _sides(spark, sf)
    return jn.join(left, right, ["k"], right_row=["c_custkey"]).left_only


@query(f"SELECT c.k, c_custkey, c_name FROM {_RIGHT} c WHERE rn > 1 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.k)")
def join_unmatched_right(spark, sf):
    left, right = _sides(spark, sf)
    return jn.join(left, right, ["k"], right_row=["c_custkey"]).right_only


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_float_key(spark, sf):
    left = t(spark, sf, "customer").select("c_custkey", "c_name", F.format_string("%d.0", "c_nationkey").alias("key"))
    right = t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return jn.join(left, right, ["key.code,float"], "1.1-2,2.n_name", right_row=["code"]).matching


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_fold(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    a = jn.join(o, t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), ["o_custkey.c_custkey"], "1.o_orderkey,2.c_name,c_nationkey", ["c_custkey"]).matching
    b = jn.join(a, t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["c_nationkey.n_nationkey"], "1.o_orderkey,c_name,2.n_name,n_regionkey", ["n_nationkey"]).matching
    return jn.join(b, t(spark, sf, "region"), ["n_regionkey.r_regionkey"], "1.o_orderkey,c_name,n_name,2.r_name", ["r_regionkey"]).matching


# ---- uniq ----

_RUNS = """(SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM (SELECT event_id, event_type, user_id, value, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id)
THEN 0 ELSE 1 END AS new FROM events))"""


def _events(spark, sf):
    return t(spark, sf, "events").select("event_id", "event_type", "user_id", "value")


@query(f"SELECT count(*) AS n, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(user_id, event_id) AS user_id, arg_min(value, event_id) AS value FROM {_RUNS} GROUP BY run")
def uniq_runs_count(spark, sf):
    return unique(_events(spark, sf), ["event_type"], ["event_id"], count="n,begin")


_PICKS = {"first": "event_id", "last": "-event_id", "min": "(value, event_id)", "max": "(-value, event_id)"}


def _which(which: str, key: str) -> None:
    name = f"uniq_which_{which}"
    spec = which if which in ("first", "last") else f"{which},value,float"
    QUERIES[name] = lambda spark, sf: unique(_events(spark, sf), ["event_type"], ["event_id"], which=spec)
    ORACLE_SQL[name] = f"SELECT event_id, event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {key}) AS k FROM {_RUNS}) WHERE k = 1"


for _w, _k in _PICKS.items():
    _which(_w, _k.strip("()"))


@query("SELECT l_returnflag, l_linestatus, l_suppkey FROM lineitem GROUP BY ALL")
def uniq_hash(spark, sf):
    return distinct_lines(t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey"))


@query(f"SELECT min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, string_agg(user_id, ',' ORDER BY event_id) AS users, CAST(sum(CAST(value AS DECIMAL(28,8))) AS DOUBLE) AS total FROM {_RUNS} GROUP BY run")
def uniq_aggregates(spark, sf):
    out = unique(_events(spark, sf), ["event_type"], ["event_id"], after=["users,user_id,merge", "total,value,sum,exact"], as_string=False)
    return out.select("event_id", "event_type", "users", "total")


# ---- aggregates by group ----

_AGGS = {
    "agg_count": ("lineitem", "l_returnflag", "v,l_tax,count", "count(*)"),
    "agg_sum": ("lineitem", "l_returnflag", "v,l_extendedprice,sum,exact", "CAST(sum(CAST(l_extendedprice AS DECIMAL(28,8))) AS DOUBLE)"),
    "agg_mean": ("lineitem", "l_returnflag", "v,l_quantity,mean,exact", "CAST(sum(CAST(l_quantity AS DECIMAL(28,8))) AS DOUBLE) / count(*)"),
    "agg_min": ("part", "p_brand", "v,p_name,min", "min(p_name)"),
    "agg_max": ("part", "p_brand", "v,p_name,max", "max(p_name)"),
    "agg_min_float": ("part", "p_brand", "v,p_retailprice,min,float", "CAST(min(p_retailprice) AS VARCHAR)"),
    "agg_max_length": ("part", "p_brand", "v,p_name,max,length", "arg_max(p_name, (strlen(p_name), -p_partkey))"),
    "agg_merge": ("part", "p_brand", "v,p_size,merge", "string_agg(p_size, ',' ORDER BY p_partkey)"),
    "agg_merge_sorted_uniq": ("part", "p_brand", "v,p_type,merge,sort.uniq", "array_to_string(list_sort(list(DISTINCT p_type)), ',')"),
    "agg_merge_limits": ("part", "p_brand", "v,p_name,merge,Ds/.min_len:3.max_len:6.max_parts:4", "array_to_string(list_filter(flatten(list(string_split(p_name, ' ') ORDER BY p_partkey)), lambda x: strlen(x) BETWEEN 3 AND 6)[1:4], '/')"),
    "agg_prefix": ("part", "p_size", "v,p_brand,prefix", "CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) ELSE left(min(p_brand), coalesce(list_position(list_transform(range(1, 9), lambda i: substr(min(p_brand), i, 1) = substr(max(p_brand), i, 1)), false), 9)::INT - 1) END"),
    "agg_asum": ("documents", "lang", "v,text,asum,swords", "CAST(sum(len(regexp_extract_all(text, '[^\\x00-\\x20]+'))) AS BIGINT)"),
    "agg_amin": ("documents", "lang", "v,text,amin,chars", "min(strlen(text))"),
    "agg_amax": ("documents", "lang", "v,text,amax,chars.utf8", "max(length(text))"),
    "agg_amean": ("documents", "lang", "v,text,amean,occurs,e", "avg(length(text) - length(replace(text, 'e', '')))"),
}


def _agg(name: str, table: str, key: str, spec: str, sql: str) -> None:
    row = {"part": ["p_partkey"]}.get(table, [])
    QUERIES[name] = lambda spark, sf: group_aggregate(t(spark, sf, table), [key], [spec], row)
    ORACLE_SQL[name] = f"SELECT {key}, {sql} AS v FROM {table} GROUP BY {key}"


for _n, _a in _AGGS.items():
    _agg(_n, *_a)


@query("SELECT p_brand, reverse(CASE WHEN min(reverse(p_type)) = max(reverse(p_type)) THEN min(reverse(p_type)) ELSE left(min(reverse(p_type)), coalesce(list_position(list_transform(range(1, 40), lambda i: substr(min(reverse(p_type)), i, 1) = substr(max(reverse(p_type)), i, 1)), false), 40)::INT - 1) END) AS v FROM part GROUP BY p_brand")
def agg_suffix(spark, sf):
    return group_aggregate(t(spark, sf, "part"), ["p_brand"], ["v,p_type,suffix"])


@query(
    """SELECT conv_id, list_reduce(list_prepend(1.0::DOUBLE, list(CAST(turn AS DOUBLE) ORDER BY turn)), lambda x, y: x * 2 + y) AS fold FROM conversations GROUP BY conv_id"""
)
def agg_expr_fold(spark, sf):
    df = t(spark, sf, "conversations").select("conv_id", "turn")
    return unique(df, ["conv_id"], ["turn"], after=["fold,expr,x,1,x*2+turn"], is_sorted=True, as_string=False).select("conv_id", "fold")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, length(text) AS chars, CAST(len(regexp_extract_all(text, '[^\\x00-\\x20]+')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS alnum FROM documents")
def counters(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", counter("chars")(c).alias("bytes"), counter("chars.utf8")(c).alias("chars"), counter("swords")(c).alias("words"), counter("awords")(c).alias("alnum"))


# ---- wc ----


@query("SELECT coalesce(source, 'totals') AS file, count(*) AS lines, CAST(sum(len(regexp_extract_all(text, '[^\\x00-\\x20]+'))) AS BIGINT) AS words, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)")
def wc_total(spark, sf):
    df = t(spark, sf, "documents").select("source", F.col("text").alias("_line"))
    return count(df, ["l", "w", "b"], by="source", totals="yes")


@query("SELECT 'n_nationkey' AS column, CAST(sum(strlen(CAST(n_nationkey AS VARCHAR))) AS BIGINT) AS bytes FROM nation UNION ALL SELECT 'n_name', CAST(sum(strlen(n_name)) AS BIGINT) FROM nation UNION ALL SELECT 'n_regionkey', CAST(sum(strlen(CAST(n_regionkey AS VARCHAR))) AS BIGINT) FROM nation")
def wc_columns(spark, sf):
    return count_columns(t(spark, sf, "nation"))


# ---- paste, sample, transpose, binsearch ----


@query("SELECT CAST(coalesce(CAST(r_name AS VARCHAR), 'none') AS VARCHAR) AS r_name, n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) USING (k)")
def paste_late(spark, sf):
    r, n = t(spark, sf, "region"), t(spark, sf, "nation")
    return paste([r.withColumnRenamed("r_regionkey", "_k").select("r_name", "_k"), n.withColumnRenamed("n_nationkey", "_k").select("n_name", "_k")], [["_k"], ["_k"]], "late", ["none"])


@query("SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) USING (k)")
def paste_early(spark, sf):
    return paste([t(spark, sf, "orders").select("o_orderkey"), t(spark, sf, "customer").select("c_custkey")], [["o_orderkey"], ["c_custkey"]], "early")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE k >= 3 AND (k - 3) % 50 = 0 AND k <= 10000")
def sample_for(spark, sf):
    return sample_every(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 50, 3, 10000)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 5 OR k = 42 OR k BETWEEN 100 AND 120")
def sample_range(spark, sf):
    return sample_ranges(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "1-5,42,100-120")


@query("SELECT CAST(10 AS BIGINT) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, true AS even FROM orders")
def sample_even_orders(spark, sf):
    """Ten rows spread evenly: the ends are there, and no two neighbours are further apart than four even steps."""
    df = sample_even(t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 10)
    keys = F.sort_array(F.collect_list("o_orderkey"))
    gaps = F.zip_with(F.slice(keys, 2, 9), F.slice(keys, 1, 9), lambda b, a: b - a)
    return df.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), (F.array_max(gaps) * 9 <= (F.max("o_orderkey") - F.min("o_orderkey")) * 4).alias("even"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS BIGINT) AS line FROM customer")
def number_lines(spark, sf):
    return number_rows(t(spark, sf, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], "line").drop("c_name")


@query("SELECT 'r_regionkey' AS column, max(CASE k WHEN 1 THEN a END) AS r1, max(CASE k WHEN 2 THEN a END) AS r2, max(CASE k WHEN 3 THEN a END) AS r3, max(CASE k WHEN 4 THEN a END) AS r4, max(CASE k WHEN 5 THEN a END) AS r5 FROM (SELECT CAST(r_regionkey AS VARCHAR) AS a, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) UNION ALL SELECT 'r_name', max(CASE k WHEN 1 THEN r_name END), max(CASE k WHEN 2 THEN r_name END), max(CASE k WHEN 3 THEN r_name END), max(CASE k WHEN 4 THEN r_name END), max(CASE k WHEN 5 THEN r_name END) FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region)")
def transpose_region(spark, sf):
    return transpose(t(spark, sf, "region"), ["r_regionkey"])


@query("WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS k FROM orders) SELECT o_orderkey, o_custkey FROM o WHERE k BETWEEN (SELECT min(k) - 2 FROM o WHERE o_custkey = 10) AND (SELECT max(k) + 3 FROM o WHERE o_custkey = 10)")
def binsearch_context(spark, sf):
    return search(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey,float"], "10", ["o_custkey", "o_orderkey"], "2,3")


@query("SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_custkey = 10")
def binsearch_plain(spark, sf):
    return search(t(spark, sf, "orders").drop("o_orderdate"), ["o_custkey"], "10", ["o_orderkey"])


# ---- generators, formats ----


@query("SELECT (i + 1) || '_1' AS c1, '' AS c2, CAST(i + 5 AS VARCHAR) AS c3, CAST((i + 1) * 4 AS VARCHAR) AS c4 FROM range(100) r(i)")
def gen_grid(spark, sf):
    return gen.generate(spark, ["grid", "null", "count,5", "expr,line*col"], 100).drop("_row")


@query("SELECT a.r_name AS v1, b.r_name AS v2 FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def gen_combine(spark, sf):
    names = [r["r_name"] for r in t(spark, sf, "region").orderBy("r_regionkey").collect()]
    return gen.tuples_table(spark, "combine", 2, names)


@query("SELECT substr('abc', CAST(i // 9 AS INT) + 1, 1) || ',' || substr('abc', CAST((i // 3) % 3 AS INT) + 1, 1) || ',' || substr('abc', CAST(i % 3 AS INT) + 1, 1) AS c1 FROM range(27) r(i)")
def gen_permute_r(spark, sf):
    return gen.generate(spark, ["permute-r,3:a,b,c"]).drop("_row")


@query("SELECT a.v || ',' || b.v AS c1 FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd')) a(i, v) JOIN (VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd')) b(i, v) ON a.i <> b.i")
def gen_permute(spark, sf):
    return gen.generate(spark, ["permute,2:a,b,c,d"]).drop("_row")


def _ladder(unit: int, letters: str) -> str:
    x = "p_retailprice * 1000"
    cases = [f"WHEN {x} < 1000 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR)"]
    for k, letter in enumerate(letters[:3], 1):
        u = f"{unit}::DOUBLE ** {k}"
        cases += [f"WHEN {x} <= 999 * {u} AND {x} > 9.9 * {u} THEN CAST(CAST(ceil({x} / {u}) AS BIGINT) AS VARCHAR) || '{letter}'", f"WHEN {x} <= 999 * {u} AND {x} > {u} THEN printf('%.1f', ceil({x} * 10 / {u}) / 10) || '{letter}'", f"WHEN {x} <= 999 * {u} THEN '1{letter}'"]
    return "CASE " + " ".join(cases) + " END"


@query(f"SELECT p_partkey, {_ladder(1024, 'KMG')} AS v FROM part")
def numfmt_power2(spark, sf):
    return t(spark, sf, "part").select("p_partkey", format_num(F.col("p_retailprice") * 1000, "power2").alias("v"))


@query(f"SELECT p_partkey, {_ladder(1000, 'kmg')} AS v FROM part")
def numfmt_power10(spark, sf):
    return t(spark, sf, "part").select("p_partkey", format_num(F.col("p_retailprice") * 1000, "power10").alias("v"))


@query("SELECT p_partkey, (['','X','XX','XXX','XL','L'])[p_size // 10 + 1] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[p_size % 10 + 1] AS v FROM part")
def numfmt_roman(spark, sf):
    return t(spark, sf, "part").select("p_partkey", format_num(F.col("p_size").cast("double"), "roman").alias("v"))


@query("SELECT o_orderkey, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS v, printf('%.2f', o_totalprice) AS w FROM orders")
def numfmt_plain(spark, sf):
    x = F.col("o_totalprice")
    return t(spark, sf, "orders").select("o_orderkey", format_num(x, "plain").alias("v"), format_num(x, "plain.2").alias("w"))


_ALL_WORDS = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"
_WORDS = "(SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE regexp_full_match(w, '[a-z]{5}'))"


def _words(spark, sf):
    w = F.explode(F.split("p_name", " ")).alias("value")
    return t(spark, sf, "part").select(w).where("value rlike '^[a-z]{5}$'").distinct()


@query(
    f"""WITH c AS {_WORDS}, n AS (SELECT count(*) AS n, count(*) // 2 AS h FROM c),
    l AS (SELECT w, p, substr(w, p, 1) AS ch, (SELECT count(*) FROM range(1, p) q(i) WHERE substr(w, CAST(i AS INT), 1) = substr(w, CAST(p AS INT), 1)) AS nth FROM c, range(1, 6) r(p)),
    a AS (SELECT ch, nth, count(*) AS k FROM l GROUP BY ALL), b AS (SELECT p, ch, count(*) AS k FROM l GROUP BY ALL)
    SELECT l.w AS word, CAST(sum(h - abs(a.k - h)) + sum(trunc((h - abs(b.k - h)) / 3)) AS BIGINT) AS score FROM l JOIN a USING (ch, nth) JOIN b ON b.p = l.p AND b.ch = l.ch, n GROUP BY l.w"""
)
def rank_words(spark, sf):
    words = _words(spark, sf)
    return gen.rank_words(words, words)


@query(f"SELECT w AS value FROM {_ALL_WORDS} WHERE length(w) = 5 AND NOT regexp_matches(w, '[uvq]') AND contains(w, 'e') AND substr(w, 2, 1) <> 'e' AND contains(w, 'l') AND substr(w, 5, 1) <> 'l'")
def solve_words(spark, sf):
    words = t(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("value")).distinct()
    return flt.grep(words, "value,solve,uEvqL")


# ---- text in and out, calculator, streams ----


@query("SELECT * FROM (VALUES ('a,1', 'x\"y', CAST(1 AS BIGINT)), ('b', '', 2), ('c d', 'z', 3)) v(one, two, line)")
def scan_quotes_ragged(spark, sf):
    df = read_lines(spark, [MARK + ',one,two', '"a,1","x""y"', "b", 'c" d",z'], "csv")
    return df.select("one", "two", F.col("_row").alias("line"))


@query("SELECT * FROM (VALUES ('a\tb', 'c'), ('d', 'e\\f')) v(c1, c2)".replace("a\tb", "a' || chr(9) || 'b").replace("\\\\", "\\"))
def scan_backslash(spark, sf):
    return read_lines(spark, ["a\\tb\tc", "d\te\\\\f"], "tsv").select("c1", "c2")


@query("SELECT * FROM (VALUES ('10.0.0.1', '-', '10/Oct:1', 'GET /x')) v(c1, c2, c3, c4)")
def scan_log(spark, sf):
    return read_lines(spark, ['10.0.0.1 - [10/Oct:1] "GET /x"'], "clf").select("c1", "c2", "c3", "c4")


@query("SELECT n_nationkey, n_nationkey || ',\"' || n_name || ',\"\"' || n_regionkey || '\"' AS value FROM nation")
def sink_quoted_lines(spark, sf):
    df = t(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(',"'), F.col("n_regionkey").cast("string")).alias("v"), F.col("n_nationkey").alias("_id"))
    return sink.lines(df, sink.Output(",", "quote-doubled")).select(F.col("_id").alias("n_nationkey"), "value")


@query("SELECT CAST(unnest([1 + 2, factorial(5)]) AS VARCHAR) AS value UNION ALL SELECT printf('%.1f', ceil(1025 * 10 / 1024) / 10) || 'K' UNION ALL SELECT 'I' || 'X' UNION ALL SELECT CAST('inf'::DOUBLE AS VARCHAR) UNION ALL SELECT (25 // gcd(25, 10)) || '/' || (10 // gcd(25, 10))")
def calc_values(spark, sf):
    return spark.createDataFrame([(v,) for v in calc(spark, ["1+2", "power2,1025", "roman,9", "5!", "1/0", "rational,2.5"])], "value string")


@query("SELECT event_type, count(*) AS n, sum(strlen(event_type))::BIGINT AS letters FROM events WHERE starts_with(event_type, 'c') OR event_type = 'view' GROUP BY event_type")
def stream_counts(spark, sf):
    """A stream of event files, filtered row by row and grouped, run until what is there has been read."""
    source = f"{sf}/event[s].parquet"
    stream = spark.readStream.schema(t(spark, sf, "events").schema).parquet(source)
    kept = stream_rows.pipeline(stream, ["event_type,prefix,c", "event_type,exact,view"], any_of=True)
    out = group_aggregate(kept, ["event_type"], ["n,event_id,count", "letters,event_type,asum,chars"])
    name = f"counts_{uuid.uuid4().hex}"
    run = out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,8))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,8))) AS DOUBLE) / count(*) AS mean_price, CAST(min(l_discount) AS VARCHAR) AS low, CAST(max(l_tax) AS VARCHAR) AS high FROM lineitem GROUP BY 1, 2")
def flagship(spark, sf):
    df = t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return group_aggregate(df, ["l_returnflag", "l_linestatus"], ["n,l_quantity,count", "qty,l_quantity,sum,exact", "mean_price,l_extendedprice,mean,exact", "low,l_discount,min,float", "high,l_tax,max,float"])

