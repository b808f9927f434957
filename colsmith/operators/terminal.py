"""tabs, calc and help: small things for people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsmith.functions.expr import CONSTANTS, FUNCTIONS, compile_expr
from colsmith.functions.numfmt import format_num, is_format
from colsmith.plans import columns as C


def tabs(df: DataFrame, width: int = 80, height: int = 24, gap: int = 1) -> list[str]:
    """The first `height` rows in columns of fixed width; if they don't fit, the widest columns shrink first."""
    names = C.data_columns(df)
    rows = [names] + [[("" if v is None else str(v)) for v in r] for r in df.select(*[C.col(c) for c in names]).limit(height).collect()]
    sizes = [max(len(r[i]) for r in rows) for i in range(len(names))]
    while sum(sizes) + gap * (len(sizes) - 1) > width and max(sizes) > 1:
        sizes[sizes.index(max(sizes))] -= 1
    return [(" " * gap).join(v[:n].ljust(n) for v, n in zip(r, sizes)).rstrip() for r in rows]


def calc(spark: SparkSession, expressions: Sequence[str] | str, degrees: bool = False) -> list[str]:
    """Values of [format,]expression lines."""
    out = []
    for text in [expressions] if isinstance(expressions, str) else expressions:
        head, _, rest = text.partition(",")
        fmt, body = (head, rest) if rest and is_format(head) else ("plain", text)
        out.append(format_num(compile_expr(body, lambda n: None, degrees=degrees), fmt).alias(f"v{len(out)}"))
    return list(spark.range(1).select(*out).first())


def describe(topic: str = "") -> list[tuple[str, str]]:
    """(name, summary) of all matchers, comparators, aggregators, counters, transforms, generators, functions or constants."""
    from colsmith.functions.agg import AGGREGATORS, COUNTERS
    from colsmith.functions.keys import COMPARATORS
    from colsmith.functions.match import MATCHERS
    from colsmith.functions.trans import TRANSFORMS
    from colsmith.operators.generate import GENERATORS

    registries = {"match": MATCHERS, "comp": COMPARATORS, "agg": AGGREGATORS, "count": COUNTERS, "trans": TRANSFORMS, "gen": GENERATORS}
    if topic in registries:
        return registries[topic].describe()
    if topic == "func":
        return [(n, f"{a} argument(s)" if a >= 0 else "any number of arguments") for n, (a, _) in sorted(FUNCTIONS.items())]
    if topic == "const":
        return [(n, repr(v)) for n, v in sorted(CONSTANTS.items())]
    if topic:
        raise ValueError(f"no topic {topic!r}")
    return [(t, f"{len(describe(t))} entries") for t in (*registries, "func", "const")]


def shown(df: DataFrame, fmt: str, *columns: str) -> DataFrame:
    """Number columns as text in a format."""
    return df.select(*[format_num(F.col(c), fmt).alias(c) if c in columns else F.col(c) for c in df.columns])
