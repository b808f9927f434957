"""The operators on small literal tables: inputs, operation, expected rows."""

import functools
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colsmith.functions import expr as X
from colsmith.functions import numfmt
from colsmith.functions.agg import aggregator, counter
from colsmith.functions.keys import Comparator
from colsmith.functions.match import determiner, in_file, matcher
from colsmith.functions.trans import transform
from colsmith.operators import filter as flt
from colsmith.operators import generate as gen
from colsmith.operators import join as jn
from colsmith.operators import sort as st
from colsmith.operators.count import count, count_columns
from colsmith.operators.project import cut
from colsmith.operators.sample import even_positions, sample_even, sample_every, sample_ranges
from colsmith.operators.search import search
from colsmith.operators.terminal import calc, describe, tabs
from colsmith.operators.transpose import transpose
from colsmith.operators.unique import distinct_lines, group_aggregate, unique
from colsmith.operators.zip import paste
from colsmith.plans import columns as C
from colsmith.plans.ordering import Ordered, number_rows
from colsmith.sources import sink
from colsmith.sources.scan import eol_of, inline, read_lines, read_text, records, tokenize
from colsmith.sources.spec import MARK, Format, parse

GRID = MARK + "\tone\ttwo\tthree\naaa\tbbb\tccc\nddd\teee\tfff"


def table(spark, text, spec=""):
    return read_lines(spark, text.split("\n"), spec)


def rows(df, sort=False):
    out = ["\t".join(str(v) for v in r) for r in df.select(*[C.col(c) for c in C.data_columns(df)]).collect()]
    return sorted(out) if sort else out


def values(spark, items):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")


def kept(spark, items, spec):
    return [r["v"] for r in values(spark, items).where(matcher(spec)(F.col("v"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "steps,names,first",
    [
        (["three,1"], ["three", "one"], "ccc\taaa"),
        (["new:1-2"], None, None),
        (["x:2,+1"], ["x", "three"], "bbb\tccc"),
        (["~two"], ["one", "three"], "aaa\tccc"),
        (["(glob,t*)"], ["two", "three"], "bbb\tccc"),
        (["(range,<p)"], ["one"], "aaa"),
        (["-2"], ["one", "two"], "aaa\tbbb"),
        ([("g", ".both:3,1")], ["both"], "ccc.aaa"),
        ([("c", "n:abc^{two}def^^"), "one"], ["n", "one"], "abcbbbdef^\taaa"),
        (["1-2+upper"], ["one", "two"], "AAA\tBBB"),
    ],
)
def test_cut(spark, steps, names, first):
    df = table(spark, GRID)
    if names is None:
        with pytest.raises(ValueError):
            cut(df, *steps)
        return
    out = cut(df, *steps)
    assert C.data_columns(out) == names
    assert rows(out)[0] == first


def test_cut_duplicates_and_expressions(spark):
    df = table(spark, MARK + "\tone\ttwo\tthree\tfour\n1\t2\t3\t4\n8\t6\t4\t2")
    assert rows(cut(df, ("e", "m:max([1-4])")).select(F.col("m").cast("int").cast("string"))) == ["4", "8"]
    assert C.data_columns(cut(df, "one", "one", duplicates="numeric")) == ["one", "one1"]
    with pytest.raises(ValueError):
        cut(df, "one", "one")
    plain = table(spark, "aaa\t1\t2\t3\t4\nbbb\t2\t3\t4\t5")
    assert rows(cut(plain, "2-5::sum+count+mean")) == ["10\t4\t2.5", "14\t4\t3.5"]
    with pytest.raises(ValueError):
        C.resolve("3-1", ["a", "b", "c"])
    assert C.valid_name("") == "X_" and C.valid_name("a b") == "a_b"


def test_transforms(spark):
    df = values(spark, ["nNñÑñÑ", " a  b\t c ", "1234567890", "YWJjZGU=", "a,b,c", "d.e.f", "g h i"])
    get = lambda spec, i: df.where(F.col("i") == i).select(transform(spec)(F.col("v"))).first()[0]
    assert get("lower", 0) == "nnñÑñÑ" and get("lower.utf8", 0) == "nnññññ" and get("upper", 0) == "NNñÑñÑ"
    assert get("normspace", 1) == "a b c" and get("bytes,3,2-4,42", 2) == "3234"
    assert get("from_base64", 3) == "abcde" and get("from_base64+upper+to_base64", 3) == "QUJDREU="
    assert get("select,,,2", 4) == "b" and get("select,..2-3", 5) == "e.f" and get("select,s:1,3", 6) == "g:i"


NUMBERS = ["1.2", "1.2e3", " 1.2", "a.2", "7", "+1.2", ".2", "-123", "256.2.3.4", "255.2.3.4", "1.2.3"]


@pytest.mark.parametrize(
    "items,spec,want",
    [
        (NUMBERS, "float", ["1.2", "1.2e3", "7", ".2", "-123"]),
        (NUMBERS, "integer", ["7", "-123"]),
        (NUMBERS, "number", ["1.2", "7", "-123"]),
        (NUMBERS, "ip", ["255.2.3.4"]),
        (["XaaaX", "XbbbX", "XaaaXbbbX", "XbBbXaAaX", "XcccX"], "infix.or,^aaa^bbb", ["XaaaX", "XbbbX", "XaaaXbbbX"]),
        (["XaaaX", "XbbbX", "XaaaXbbbX", "XbBbXaAaX", "XcccX"], "infix.and.case,^aaa^bbb", ["XaaaXbbbX", "XbBbXaAaX"]),
        (["abc", "abbc", "xay"], "keep,ab", ["abc", "abbc", ]),
        (["abc", "abbc", "cd"], "reject,bb", ["abc", "cd"]),
        (["ant", "bee", "cat", "dog"], "range,>=bee<dog", ["bee", "cat"]),
        (["1", "10", "9", "2.0"], "range,float,GE,2,LT,10", ["9", "2.0"]),
        (["ñ", "ab", "abc"], "length,2", ["ñ", "ab"]),
        (["ñ", "ab", "abc"], "length.utf8,1,2", ["ñ", "ab"]),
        (["", " ", "\t#", "  //", "x"], "blank", ["", " "]),
        (["", " ", "\t#", "  //", "x"], "hash", ["", " ", "\t#"]),
        (["", " ", "\t#", "  //", "x"], "slash", ["", " ", "  //"]),
        (["", "a", "b"], "exact.null,a", ["", "a"]),
        (["a.b", "axb", "a.bc"], "glob,a.?", ["a.b"]),
        (["foobar", "FOO", "bar"], "prefix.case,foo", ["foobar", "FOO"]),
        (["foobar", "FOO", "bar"], "not.suffix,bar", ["FOO"]),
        (["  foo ", "foo"], "exact.trim,foo", ["  foo ", "foo"]),
        (["abc", "bca", "cab"], "solve,+aBc", []),
        (["abd", "adb", "dab", "bad"], "solve,+aBc", ["adb"]),
    ],
)
def test_matchers(spark, items, spec, want):
    assert kept(spark, items, spec) == want


def test_determiners_and_lines(spark):
    df = table(spark, MARK + "\tone\ttwo\tthree\na\ta\tb\na\ta\ta\nb\tb\tb")
    n = lambda spec: flt.grep(df, spec).count()
    assert [n(f"[{d},1-3],exact,a") for d in ("all", "some", "none", "notall", "mixed", "uniform", "atleast.2", "exactly.1", "exactlyno.1")] == [1, 2, 1, 2, 1, 2, 2, 0, 1]
    assert n(",count,3") == 3 and n("one,comp,=two") == 3 and n("three,comp,>one") == 1
    num = table(spark, MARK + "\tone\ttwo\tthree\tfour\naaa\t2\t3\tbbb\nccc\t3\t2\tddd\nggg\t1.2e5\t2.3e4\thhh")
    assert [r.split("\t")[0] for r in rows(flt.grep(num, ",expr,three<two"))] == ["ccc", "ggg"]
    with pytest.raises(ValueError):
        determiner("few")([F.lit(True)])


def test_grep_location_split_and_file(spark, tmp_path):
    a = MARK + "\tone\ttwo\tthree\naaa\tbbb\tccc\n111\t2foo2\t333\nqqq\twww\teee"
    df = read_lines(spark, a.split("\n"), name="dir/one")
    hit = flt.location(flt.grep(df, "two,,foo"), "filename:name.1,line,bytes")
    assert rows(hit.drop("_file", "_row", "_byte", "_line", "_ncols")) == ["one\t2\t13\t111\t2foo2\t333"]
    both = flt.grep_split(df, "two,infix,foo", "one,prefix,q", any_of=True)
    assert both.matching.count() == 2 and both.others.count() == 1
    assert flt.grep(df, "two,infix,foo", invert=True).count() == 2
    p = tmp_path / "words"
    p.write_text("aaa\nqqq\n")
    assert flt.grep(df, f"one,file-exact,{p}").count() == 2
    assert in_file(df, "one", spark.read.text(str(p)), negate=True).count() == 1


def test_filters_reach_the_scan(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    events, orders = spark.read.parquet(f"{sf}/events.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    p = plan(flt.grep(events, "event_type,exact,click").select("event_id"))
    assert "EqualTo(event_type,click)" in p and "ReadSchema: struct<event_id:bigint,event_type:string>" in p
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan(flt.grep(orders, "o_totalprice,range,float,>=1000<50000"))
    assert "StringStartsWith(event_type,c)" in plan(flt.grep(events, "event_type,prefix,c"))
    assert flt.implied(orders, "o_totalprice,range,float,<50000") is None and flt.implied(events, "event_type,exact.not,click") is None
    nulls = spark.createDataFrame([(1, None), (2, "a"), (3, "")], "k int, v string")
    keys = lambda *p, **kw: [r["k"] for r in flt.grep(nulls, *p, **kw).orderBy("k").collect()]
    assert keys("v,exact,") == [1, 3] and keys("v,range,<b") == [1, 2, 3] and keys("v,exact,a", invert=True) == [1, 3] and keys("v,exact.not,a") == [1, 3] and keys("v,range,>=a") == [2]


def test_cat(spark):
    lines = ["aaa", "", "   \t", "   \t//", "\t#", "    ", "", "bbb"]
    df = read_lines(spark, lines, "whole")
    kept_ = flt.remove(df, "empty")
    out = flt.number(kept_, ["_row"], "line", skip=["blank"]).orderBy("_row")
    assert [tuple(r)[:2] for r in out.collect()] == [("1", "aaa"), ("", "   \t"), ("2", "   \t//"), ("3", "\t#"), ("", "    "), ("4", "bbb")]
    two = flt.concat([table(spark, GRID), table(spark, GRID)])
    assert two.count() == 4 and two.where("_file_no = 1").count() == 2
    with pytest.raises(ValueError):
        flt.concat([table(spark, GRID), table(spark, "a\tb")])


def test_verify(spark):
    df = table(spark, MARK + "\tone\ttwo\nb\tx\na\ty\nc\tzz\tq")
    found = {(r["rule"], r["_row"]) for r in flt.verify(df, ["_row"], ["two,length,1"], width=2, sort_keys=["one"], first="LT,b", last="LT,a").collect()}
    assert found == {("two,length,1", 3), ("width", 3), ("sort", 2), ("first", 1), ("last", 3)}


def test_sort(spark):
    df = table(spark, MARK + "\tone\ttwo\tthree\naaa\t27.5\tccc\nzzz\t-32\tlll\nfff\tabc\tkkk")
    first = lambda keys, **kw: [r.split("\t")[0] for r in rows(st.sort(df, keys, ["_row"], **kw))]
    assert first(["two,float"]) == ["zzz", "fff", "aaa"] and first(["two,float.rev"]) == ["aaa", "fff", "zzz"]
    assert first(["two,float.strict"])[-1] == "fff" and first(["two,float.strict.low"])[0] == "fff"
    ex = table(spark, "aaa\t1\t2\tbbb\nbbb\t2\t3\tbbb\nddd\t-2\t3\teee")
    assert [r[:3] for r in rows(st.sort(ex, [",expr.rev,c2+c3"], ["_row"]))] == ["bbb", "aaa", "ddd"]
    ip = table(spark, "10.1.2.3\n9.9\n9.9.9.9\n9.10.1.1\n009.1")
    assert rows(st.sort(ip, ["1,ip"], ["_row"])) == ["9.9", "9.9.9.9", "9.10.1.1", "10.1.2.3", "009.1"]
    num = table(spark, "12\n-5\n1,000\n-5.25\n0.5\n-12\n0\n99999999999999999999999\n-5.2")
    assert rows(st.sort(num, ["1,numeric"], ["_row"])) == ["-12", "-5.25", "-5.2", "-5", "0", "0.5", "12", "1,000", "99999999999999999999999"]
    dup = table(spark, "b\t1\na\t2\nb\t3")
    assert rows(st.sort(dup, ["1"], ["_row"], unique=True)) == ["a\t2", "b\t1"]
    assert rows(st.merge([table(spark, "aaa\nccc"), table(spark, "bbb\nccc")], ["1"], ["_row"], unique=True)) == ["aaa", "bbb", "ccc"]
    assert [r["_row"] for r in st.check(dup, ["_row"], ["1"]).collect()] == [2]
    assert st.check(table(spark, "a\na\nb"), ["_row"], ["1"]).count() == 0 and st.check(table(spark, "a\na\nb"), ["_row"], ["1"], unique=True).count() == 1
    assert rows(st.top(dup, 1, ["1,plain.rev"], ["_row"])) == ["b\t1"]


JL = MARK + "\tone\ttwo\tthree\naaa\t3\tccc\nddd\t20\tfff\nggg\t100\tiii\nzzz\t3\tqqq"
JR = MARK + "\tuno\tdos\ttres\nbbb\tDDD\t3.0\nddd\tFFF\t4\nggg\tIII\t50\nhhh\tJJJ\t100\niii\tKKK\t3"


def test_join(spark):
    j = jn.join(table(spark, JL), table(spark, JR), ["two.tres,float"], "1.3,2.1-3,~2", right_row=["_row"])
    assert rows(j.matching, True) == ["ccc\tbbb\t3.0", "iii\thhh\t100", "qqq\tbbb\t3.0"]
    assert rows(j.left_only) == ["ddd\t20\tfff"]
    assert rows(j.right_only, True) == ["ddd\tFFF\t4", "ggg\tIII\t50", "iii\tKKK\t3"]
    d = jn.join(table(spark, JL), table(spark, JR), ["1"])
    assert C.data_columns(d.matching) == ["one", "two", "three", "dos", "tres"] and d.matching.count() == 2
    assert jn.join_full(table(spark, JL), table(spark, JR), ["1"], "outer", "-").count() == 7
    parts = [spark.createDataFrame([("a", i), ("b", i)][: 3 - i], f"k string, v{i} int") for i in (1, 2)]
    assert rows(jn.join_all([*parts, spark.createDataFrame([("a", 9)], "k string, w int")], ["k"])) == ["a\t1\t2\t9"]


def test_unique(spark):
    f = table(spark, MARK + "\tone\ttwo\tthree\na\t1.0\t1\nb\t1.000\t2\nc\t-1.0\t3\nd\t+1.0\t4\ne\t+1.0e0\t5")
    assert [r[0] for r in rows(unique(f, ["two,float"], ["_row"]).orderBy("_row"))] == ["a", "c", "d"]
    g = table(spark, "1\t2\n2\t1\n3\t2\n4\t1\n5\t1")
    out = unique(g, [",expr,c1+c2"], ["_row"], which="last", count="n,end").orderBy("_row")
    assert rows(out) == ["2\t1\t2", "4\t1\t2", "5\t1\t1"]
    m = table(spark, MARK + "\tone\ttwo\tthree\nqax\taaa\t1,2\nwsx\taaa\t3,4\nedc\taaa\t4,5\nrfv\taaa\t0,3")
    out = unique(m, ["two"], ["_row"], count="zero", replace=["three,merge"], after=["four,three,merge,sort.uniq", "five,three,merge,D,..max_parts:5", "six,3,merge,count", "seven,three,merge,uniq.count", "eight,three,asum,chars"])
    assert rows(out) == ["4\tqax\taaa\t1,2,3,4,4,5,0,3\t0,1,2,3,4,5\t1.2.3.4.4\t8\t7\t12"]
    e = table(spark, "aaa\t1\naaa\t2\naaa\t3\naaa\t4\nbbb\t2\nbbb\t4\nbbb\t6\nbbb\t8")
    assert rows(unique(e, ["1"], ["_row"], after=["p,expr,x,1,x*c2"]).orderBy("_row").select("c1", "c2", "p")) == ["aaa\t1\t24", "bbb\t2\t384"]
    assert rows(unique(e, ["1"], ["_row"], which="max,2,float", is_sorted=True).orderBy("_row")) == ["aaa\t4", "bbb\t8"]
    assert rows(unique(e, ["1"], ["_row"], which="min,2,float.rev").orderBy("_row")) == ["aaa\t4", "bbb\t8"]
    assert distinct_lines(table(spark, "a\nb\na"), ["_row"]).count() == 2
    assert rows(group_aggregate(e, ["c1"], ["s,c2,sum", "n,c2,count", "p,c1,prefix"]), True) == ["aaa\t10.0\t4\taaa", "bbb\t20.0\t4\tbbb"]


def test_aggregates(spark):
    df = values(spark, ["abcx", "abdx", "abx", ""])
    get = lambda spec, where="true": df.where(where).agg(aggregator(spec).group(F.col("v"), F.col("i"))).first()[0]
    assert get("prefix", "v <> ''") == "ab" and get("suffix", "v <> ''") == "x" and get("prefix") == ""
    assert get("min,length") == "" and get("max,length") == "abcx" and get("max,length.rev") == ""
    assert get("count,5") == 9 and get("asum,chars") == 11 and get("amin,chars") == 0 and get("amax,chars") == 4 and get("amean,chars") == 2.75
    neg = values(spark, ["-3", "-1", "-2"])
    assert neg.agg(aggregator("max,float").group(F.col("v"), F.col("i"))).first()[0] == "-1"
    w = values(spark, ["a b-c, d", "ñ ñ", "a,b,,c"])
    c = lambda spec: [r[0] for r in w.orderBy("i").select(counter(spec)(F.col("v"))).collect()]
    assert c("chars") == [8, 5, 6] and c("chars.utf8") == [8, 3, 6] and c("swords") == [3, 2, 1] and c("awords") == [4, 0, 3] and c("awords.utf8") == [4, 2, 3] and c("occurs,,") == [1, 0, 3]


def test_count(spark):
    df = read_lines(spark, ["a,b", "c,,d", ""], "whole", "x")
    assert tuple(count(df, ["l", "commas,asum,occurs,,"]).first()) == ("x", 3, 3)
    both = df.unionByName(read_lines(spark, ["q r"], "whole", "y"))
    got = {tuple(r) for r in count(both, ["l", "w"], totals="yes").collect()}
    assert got == {("x", 3, 2), ("y", 1, 2), ("totals", 4, 4)}
    assert {tuple(r) for r in count_columns(table(spark, GRID), ["b", "n,count"]).collect()} == {("one", 6, 2), ("two", 6, 2), ("three", 6, 2)}


def test_paste(spark):
    a, b = table(spark, MARK + "\tone\ttwo\tthree\n111\t222\t333\n11a\t22b\t33c\n11x\t22y\t33z"), table(spark, MARK + "\tfour\tfive\tsix\n444\t555\t666\n44d\t55e\t66f")
    by = [["_row"], ["_row"]]
    late = lambda **kw: rows(paste([a, b], by, "late", numbered=True, **kw).orderBy("_row"))[-1]
    assert late() == "11x\t22y\t33z\t\t\t" and late(defaults=["zzz"]) == "11x\t22y\t33z\tzzz\tzzz\tzzz"
    assert late(defaults=["zzz,3-4", "ZZZ,5-6"]) == "11x\t22y\t33z\tzzz\tZZZ\tZZZ" and late(repeat_last=True) == "11x\t22y\t33z\t44d\t55e\t66f"
    assert paste([a, b], by, "early").count() == 2
    with pytest.raises(ValueError):
        paste([a, b], by)
    same = paste([a, a], by, renames=["one.uno"], duplicates="numeric")
    assert C.data_columns(same) == ["one", "two", "three", "uno", "two1", "three1"]


def test_positions(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r["k"] for r in sample_every(df, ["k"], 30, 5).orderBy("k").collect()] == [4, 34, 64, 94]
    assert [r["k"] for r in sample_ranges(df, ["k"], "1-3,42,99-").orderBy("k").collect()] == [0, 1, 2, 41, 98, 99]
    got = [r["k"] for r in sample_even(df, ["k"], 5).orderBy("k").collect()]
    assert len(got) == 5 and got[0] == 0 and got[-1] == 99
    for total in (0, 1, 2, 3, 7, 50, 1000):
        for size in (2, 3, 10):
            p = even_positions(total, size)
            assert p == sorted(set(p)) and len(p) == min(total, max(size, 2)) and (not p or (p[0], p[-1]) == (0, total - 1))


def test_bucketed_order_is_the_same(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3).alias("v"))
    one = Ordered(df, ["k"]).running("n").running("s", F.col("v")).previous("p", F.col("v")).done()
    many = Ordered(df, ["k"], small=10, buckets=7).running("n").running("s", F.col("v")).previous("p", F.col("v")).done()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.select(one.columns).collect()))
    text = df.select(F.col("k").cast("string").alias("k"))
    a, b = number_rows(text, ["k"]), Ordered(text, ["k"], small=10, buckets=5).running("_row").done()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rank_of_any_size(spark):
    n = 250_000
    v = F.when(F.col("id") % 11 == 0, None).otherwise(F.format_number(F.xxhash64("id") % 100_000 / 100, 2))
    df = spark.range(n).select("id", (F.xxhash64("id") % 1000 / 7).alias("x"), F.concat_ws(".", (F.col("id") % 256).cast("string"), (F.col("id") % 7).cast("string")).alias("ip"), v.alias("v"))
    for keys in (["x,float.rev"], ["ip,ip"], ["v,numeric"], ["v,length.rev", "x,float"]):
        k = st.Keys.parse(df, keys)
        named, names = k.named()
        order = [F.col(c).desc() if "rev" in m.mods else F.col(c).asc() for c, m in zip(names, k.comparators)]
        want = named.select("id", F.row_number().over(Window.orderBy(*order, "id")).alias("want"))
        assert st.rank(df, keys, ["id"]).join(want, "id").agg(F.count("*"), F.count_if(F.col("rn") == F.col("want"))).first()[:] == (n, n), keys


def test_bytes_of_text_that_is_not_ascii(spark):
    texts = ["", "a", "é", "日本語 text", "ab\U0001f600cd", "ÄÖÜ" * 5]
    cut_ = lambda b: b[0:5] + b[8:11]
    for row in values(spark, texts).select("v", transform("bytes,1-5,9-11")(F.col("v")).alias("b")).collect():
        assert row["b"] == cut_(row["v"].encode()).decode("utf-8", "replace")


def test_line_ends_and_offsets(spark, tmp_path):
    body = b"one,two\r\na,1\r\n\xc3\xa9,22\nb,3\rc,4\r\n\r\nd,5"
    p = tmp_path / "mixed.csv"
    p.write_bytes(body)
    at = lambda text: body.index(text) - 9
    want = [(1, "a,1", 0), (2, "é,22", at(b"\xc3")), (3, "b,3", at(b"b,3")), (4, "c,4", at(b"c,4")), (5, "", at(b"\r\nd")), (6, "d,5", at(b"d,5"))]
    for spec in ("csv,h=yes", "csv,h=yes,q=none"):
        got = [(r["_row"], r["_line"], r["_byte"]) for r in read_text(spark, str(p), spec).orderBy("_row").collect()]
        assert got == want, spec
    ends = {b"a\r\nb": "\r\n", b"a\nb\r\n": "\n", b"a\rb": "\r", b"": "\n"}
    for k, (data, eol) in enumerate(ends.items()):
        q = tmp_path / f"e{k}"
        q.write_bytes(data)
        assert eol_of(spark, str(q)) == eol


def test_search_and_transpose(spark):
    df = table(spark, MARK + "\tfoo\naaa\nbbb\nccc\nccc\nddd\neee\nfff")
    get = lambda v, c="0,0": rows(search(df, ["foo"], v, ["_row"], c).orderBy("_row"))
    assert get("ccc") == ["ccc", "ccc"] and get("ccc", "1.2,2.1") == ["bbb", "ccc", "ccc", "ddd", "eee"]
    miss = table(spark, MARK + "\tfoo\naaa\nbbb\nddd\neee\nfff")
    assert rows(search(miss, ["foo"], "ccc", ["_row"], "1.2,2.1").orderBy("_row")) == ["aaa", "bbb", "ddd"]
    t = transpose(table(spark, GRID), ["_row"])
    assert rows(t) == ["one\taaa\tddd", "two\tbbb\teee", "three\tccc\tfff"]


def test_generate(spark):
    df = gen.generate(spark, ["grid", "null", "expr,float,line^col", "null", "3*expr,line*col"]).orderBy("_row")
    got = rows(df)
    assert got[0] == "1_1\t\t1e0\t\t5\t6\t7" and got[2] == "3_1\t\t2.7e1\t\t15\t18\t21" and got[9] == "10_1\t\t1e3\t\t50\t60\t70"
    assert rows(gen.generate(spark, ["combine,2:a,b,c"]).orderBy("_row")) == ["a,b", "a,c", "b,c"]
    assert rows(gen.generate(spark, ["permute-r,2:a,b"]).orderBy("_row")) == ["a,a", "a,b", "b,a", "b,b"]
    assert gen.tuples_table(spark, "permute", 2, ["a", "b", "c"]).count() == 6
    d = gen.generate(spark, ["decimal,-NN.NNN", "normal,5,0.1,plain.2"], 50, seed=3)
    assert d.where("c1 not rlike '^-?[0-9]{2}[.][0-9]{3}$'").count() == 0 and d.where("abs(double(c2) - 5) > 1").count() == 0
    assert max(gen.random_bytes(1000, 1)) <= 254
    words = spark.createDataFrame([("cat",), ("dog",), ("cot",), ("act",), ("tac",)], "value string")
    ranks = {r["word"]: r["score"] for r in gen.rank_words(words, words).collect()}
    assert ranks == {w: _rank([x[0] for x in words.collect()], w) for w in ranks} and len(ranks) == 5
    assert sorted(r[0] for r in gen.sub_anagrams(words, "tac o").collect()) == ["act", "cat", "cot", "tac"]
    assert {r["anagram"] for r in gen.anagrams(spark.createDataFrame([("no",), ("on",), ("one",), ("t",), ("e",)], "value string"), "one t").collect()} >= {"one t"}


def _rank(cands, word):
    half, score, used = len(cands) // 2, 0, {}
    for ch in word:
        n = used.get(ch, 0)
        used[ch] = n + 1
        score += half - abs(sum(c.count(ch) > n for c in cands) - half)
    return score + sum(int((half - abs(sum(c[i] == ch for c in cands) - half)) / 3) for i, ch in enumerate(word))


@pytest.mark.parametrize(
    "text,want",
    [
        ("1+2*3", 7), ("-1^2", -1), ("2^3^2", 512), ("5!", 120), ("1/0", math.inf), ("-1/0", -math.inf), ("0/0", math.nan), ("7%4", 3), ("3<=3", 1), ("3!=3", 0), ("(1+2)*3", 9),
        ("max(1,NAN,3)", 3), ("min(2,1)", 1), ("avg(1,2,6)", 3), ("if(0,1,2)", 2), ("atan2(1,0)", 0), ("log(8,2)", 3), ("ln(0)", -math.inf), ("sqrt(-1)", math.nan), ("round(-2.5)", -3), ("round_ties_even(2.5)", 2),
        ("trunc(-2.7)", -2), ("fract(2.5)", 0.5), ("signum(0)", 1), ("copysign(3,-0.0)", -3), ("rem_euclid(-7,4)", 1), ("div_euclid(-7,4)", -2), ("0x1F", 31), ("0b101", 5), ("0rXIV", 14), ("2K", 2048), ("2k", 2000),
        ("171!", math.inf), ("(0-1)!", 0), ("recip(4)", 0.25), ("clamp(5,1,3)", 3), ("total_cmp(1,2)", -1), ("next_up(1)", 1.0000000000000002), ("mul_add(2,3,4)", 10), ("hypot(3,4)", 5), ("exp2(3)", 8), ("is_nan(0/0)", 1), ("2pi", None),
    ],
)
def test_expressions(spark, text, want):
    if want is None:
        with pytest.raises(ValueError):
            X.compile_expr(text, lambda n: None)
        return
    got = spark.range(1).select(X.compile_expr(text, lambda n: None)).first()[0]
    assert (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want)


def test_number_formats(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10.0, 2.5, 1e21, 1.5e-7, -0.25, 1025.0, 1001.0, 0.0, 999.0, 1024.0, 1e6])], "i int, x double")
    got = lambda f: [r[0] for r in df.orderBy("i").select(numfmt.format_num(F.col("x"), f)).collect()]
    assert got("plain")[:5] == ["10", "2.5", "1000000000000000000000", "0.00000015", "-0.25"]
    assert got("float")[:5] == ["1e1", "2.5e0", "1e21", "1.5e-7", "-2.5e-1"]
    assert got("power2")[5:10] == ["1.1K", "1K", "0", "999", "1K"] and got("power10")[5:7] == ["1.1k", "1.1k"]
    assert got("roman")[0] == "X" and got("roman")[7] == "N" and got("plain.2")[1] == "2.50" and got("rational")[1] == "5/2" and got("dyadic")[1] == "2+1/2"


def test_calc_tabs_help(spark):
    assert calc(spark, ["1+1", "power2,1025", "roman,9"]) == ["2", "1.1K", "IX"] and calc(spark, "sin(90)", degrees=True) == ["1"]
    assert tabs(table(spark, GRID), width=12)[1] == "aaa bbb ccc"
    assert dict(describe())["func"] == "57 entries" and dict(describe())["const"] == "37 entries"


def test_records_and_fields(spark, tmp_path):
    csv = parse("csv")
    assert tokenize('aaa,b""bb,ccc', csv) == ["aaa", "bbb", "ccc"] and tokenize('"b""b",x', csv) == ['b"b', "x"]
    assert list(records('a,"x\ny",b\nc', csv)) == [('a,"x\ny",b', 0), ("c", 10)]
    assert list(records('é\r\n"x\r\ny"\r\n\rz', csv)) == [("é", 0), ('"x\ny"', 4), ("", 12), ("z", 13)]
    with pytest.raises(ValueError):
        list(records('a,"x', parse("csv,u=error")))
    assert tokenize('1.2.3.4 - [10/Oct] "GET /"', parse("clf")) == ["1.2.3.4", "-", "10/Oct", "GET /"]
    assert tokenize(" a  b ", Format(mode="white-drop")) == ["a", "b"] and tokenize("a  b", Format(mode="white-keep")) == ["a", "  b"]
    assert inline("<<a\\tb\\nc") == ["a\tb", "c"]
    assert rows(read_lines(spark, ["x\\ty\tz"], "tsv")) == ["x\ty\tz"]
    assert rows(read_lines(spark, ["a\tb", "c"])) == ["a\tb", "c\t"]
    p = tmp_path / "t.txt"
    p.write_text("\ufeff" + MARK + ",one,two\naaa,1\nbbb,2\r\nccc\n")
    df = read_text(spark, str(p))
    assert C.data_columns(df) == ["one", "two"] and [tuple(r) for r in df.orderBy("_row").select("one", "two", "_row", "_ncols").collect()] == [("aaa", "1", 1, 2), ("bbb", "2", 2, 2), ("ccc", "", 3, 1)]
    q = tmp_path / "q.csv"
    q.write_text('h1,h2\n"a\nb",2\nc,3\n')
    assert rows(read_text(spark, str(q), "csv,h=yes").orderBy("_row")) == ["a\nb\t2", "c\t3"]
    import gzip

    z = tmp_path / "packed"
    z.write_bytes(gzip.compress(b"x\ty\n"))
    assert rows(read_text(spark, str(z))) == ["x\ty"]


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 'q"q')], "x string, y string")
    out = lambda e: sink.to_text(df, sink.Output(escape=e))
    assert out("replace:_") == 'a_b\tq"q\n' and out("delete") == 'ab\tq"q\n' and out("trust") == 'a\tb\tq"q\n' and out("backslash") == 'a\\tb\tq"q\n'
    assert out("quote-doubled") == '"a\tb"\t"q""q"\n' and out("always-quote-backslash") == '"a\tb"\t"q\\"q"\n'
    with pytest.raises(Exception):
        out("error")
    assert sink.to_text(df, sink.Output(header="marked")).startswith(MARK + "\tx\ty\n")
    assert sink.derived(parse("csv")).escape == "quote-doubled" and sink.derived(parse("tsv")).escape == "backslash"
    sink.write(table(spark, GRID).coalesce(1), str(tmp_path / "o"), sink.Output(header="plain"))
    assert spark.read.text(str(tmp_path / "o")).count() == 3


def test_streaming(spark, sf, tmp_path):
    from colsmith.streaming.rows import pipeline, windowed

    spark.read.parquet(f"{sf}/events.parquet").limit(500).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = pipeline(stream, ["event_type,prefix,c"], ["event_id,event_type+upper"]).writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == flt.grep(spark.read.parquet(str(tmp_path / "in")), "event_type,prefix,c").count()
    w = windowed(stream, "ts", "1 hour", ["event_type"], ["n,value,count"])
    q = w.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 500


def test_comparator_registry_and_null():
    with pytest.raises(ValueError):
        Comparator.parse("nothing")
    with pytest.raises(ValueError):
        Comparator.parse("float.bad")


@pytest.mark.parametrize("which,first", [("first", [0, 2, 6]), ("last", [1, 5, 9]), ("min,value,float", [1, 3, 7]), ("max,value,float", [0, 2, 6])])
def test_runs_across_buckets(spark, monkeypatch, which, first):
    """A previous row and a running total over one table of several buckets."""
    monkeypatch.setattr("colsmith.operators.unique.Ordered", functools.partial(Ordered, small=1, buckets=4))
    df = spark.createDataFrame([(i, "ab"[i in (2, 3, 4, 5)], float([9, 1, 9, 1, 5, 5, 9, 1, 5, 5][i])) for i in range(10)], "id long, kind string, value double")
    out = unique(df, ["kind"], ["id"], which=which, count="n,begin", after=["ids,id,merge"])
    assert [tuple(r) for r in out.orderBy("id").select("n", "id", "ids").collect()] == list(zip([2, 4, 4], first, ["0,1", "2,3,4,5", "6,7,8,9"]))


def test_bounds_of_buckets_stand_in_the_plan_once(spark):
    """A subquery a bound would run in every step of the search; the bounds are one constant, found by one fold."""
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.format_string("%d.5", F.col("id") % 11)).alias("v"))
    o = Ordered(df.withColumn("s", F.struct(F.length("v").alias("n"), "v")), ["k", "s", "id"], small=1, buckets=300, down={"k", "s"}).running("rn")
    plan = o.done()._jdf.queryExecution().optimizedPlan().toString()
    assert "subquery" not in plan and plan.count("_bucket") < 30 and o.df.select("_bucket").distinct().count() > 100
    want = F.row_number().over(Window.orderBy(F.col("k").desc(), F.col("s").desc_nulls_last(), "id"))
    assert o.done().withColumn("want", want).where("rn <> want").count() == 0


def test_plain_takes_few_numbers_apart(spark):
    """Numbers whose text has no exponent are written as they are, without a pattern; all others as before."""
    cases = {1.0: "1", -1.5: "-1.5", 0.001: "0.001", -0.001: "-0.001", 0.00099: "0.00099", 9999999.0: "9999999", 9999999.5: "9999999.5", 1e7: "10000000", 12345678.25: "12345678.25", -0.0: "-0", 100.0: "100", 0.1: "0.1", 1e-7: "0.0000001", math.inf: "inf", math.nan: "NaN"}
    df = spark.createDataFrame([(x, w) for x, w in cases.items()], "x double, want string").withColumn("got", numfmt.plain(F.col("x")))
    assert [tuple(r) for r in df.where("NOT got <=> want").collect()] == [] and df.where(numfmt.plain(F.lit(None).cast("double")).isNotNull()).count() == 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("1.0E7") < plan.index("regexp_extract")


def test_parts_joined_in_order(spark, tmp_path):
    """Sorted parts of several tasks become one file; no task has it all."""
    from colsmith.plans.sweeps import _joined

    path = f"{tmp_path}/parts"
    spark.range(25).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.format_string("%02d", "id").alias("value")).write.option("lineSep", "\r\n").text(path)
    _joined(spark, path, f"{path}.csv")
    assert open(f"{path}.csv", newline="").read() == "".join(f"{i:02d}\r\n" for i in range(25))
