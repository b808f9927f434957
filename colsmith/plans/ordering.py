"""Row order on an unordered engine: numbering, running totals and previous rows without a window over the whole table.

Rows are cut into buckets at bounds of the order keys, taken from a hash sample of bounded size; the number of buckets follows the
number of rows. The bounds are one sorted array, collected once and a constant of the plan, and a row finds its bucket by binary
search, so a bucket is a function of the row alone and every stage and every retry agrees on it. Keys may be of any ordered type
(structs and arrays too), each ascending or descending. Windows run within buckets; one small row a bucket (its total, its last row) carries what goes across.
Tables of up to SMALL rows, by count, are one bucket.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Rows that one window takes at once without buckets; rows of a bucket, at most and, where partitions are many, at least; buckets at most; sampled keys a bucket.
SMALL, ROWS, LEAST, MOST, SAMPLED = 100_000, 1_000_000, 10_000, 50_000, 8


def _after(names: Sequence[str], down: Collection[str], bound: Column) -> Column:
    """Whether a row's keys come after a bound. Structs compare field by field, nulls first; neighbours of one direction go together."""
    found = F.lit(False)
    groups = [(way, list(g)) for way, g in itertools.groupby(names, lambda n: n in down)]
    for way, own in reversed(groups):
        here, there = F.struct(*own), F.struct(*[bound[n].alias(n) for n in own])
        past = here < there if way else here > there
        found = past | ((here == there) & found)
    return found


def _constant(df: DataFrame) -> Column:
    """The array in a table of one row and column, as one constant of a plan: a subquery would run wherever it stands."""
    expressions = df.sparkSession._jvm.org.apache.spark.sql
    value = df._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    return Column(expressions.classic.ExpressionUtils.column(expressions.catalyst.expressions.Literal(value, df._jdf.schema().apply(0).dataType())))


def _bucketed(df: DataFrame, names: Sequence[str], down: Collection[str], bounds: Column, n: int) -> DataFrame:
    """Adds _bucket, the number of bounds (sorted, n of them) that a row's keys come after: a binary search by halving steps.

    The steps are a fold, so bounds, a constant, stand in the plan once however many there are.
    """

    def step(at: Column, size: Column) -> Column:
        past = F.transform(F.array(F.get(bounds, at + size - 1)), lambda bound: _after(names, down, bound))
        return F.when((at + size <= n) & F.get(past, F.lit(0)), at + size).otherwise(at)

    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return df.withColumn("_bucket", F.aggregate(steps, F.lit(0), step))


class Ordered:
    """A table in the order of its columns `by` (a unique key); ascending with nulls first, columns of `down` the other way round."""

    def __init__(self, df: DataFrame, by: Sequence[str], small: int = SMALL, buckets: int | None = None, down: Collection[str] = ()) -> None:
        self.by, self.down = list(by), frozenset(down)
        n = df.count()
        order = [F.col(c).desc_nulls_last() if c in self.down else F.col(c).asc_nulls_first() for c in self.by]
        self.window = W.partitionBy("_bucket").orderBy(*order)
        self.whole = n <= small
        self.parts = 1
        if self.whole:
            self.df = df.withColumn("_bucket", F.lit(0))
            return
        spark = df.sparkSession
        parts = buckets or min(MOST, max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LEAST)), math.ceil(n / ROWS)))
        every = max(1, n // (SAMPLED * parts))
        # Rows, not keys, are drawn: a key that repeats isn't drawn as a whole. About SAMPLED keys a bucket come to the driver.
        drawn = df.select(*self.by).where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)
        keys = drawn.orderBy(*order).collect()
        bounds = [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []
        bounds = [b for b, _ in itertools.groupby(bounds)]
        if not bounds:
            self.df = df.withColumn("_bucket", F.lit(0))
            return
        self.parts = len(bounds) + 1
        kind = StructType([StructField("b", ArrayType(drawn.schema))])
        one = spark.createDataFrame([(bounds,)], kind)
        self.df = _bucketed(df, self.by, self.down, _constant(one), len(bounds))

    def _placed(self) -> DataFrame:
        """The rows by bucket, in as many partitions as there are buckets: none holds more than a few of them."""
        if self.parts > 1:
            self.df = self.df.repartition(self.parts, "_bucket")
            self.parts = 1
        return self.df

    def _across(self, df: DataFrame, per: DataFrame) -> DataFrame:
        return df.join(F.broadcast(per), "_bucket", "left")  # one row a bucket

    def running(self, name: str, value: Column | None = None, start: int = 0) -> Ordered:
        """Adds the running total of value (1 by default, which numbers rows from start + 1)."""
        value = F.lit(1) if value is None else value
        total = F.sum(value.cast("long")).over(self.window.rowsBetween(W.unboundedPreceding, 0))
        if self.whole:
            self.df = self.df.withColumn(name, total + start)
            return self
        sums = self.df.select("_bucket", value.cast("long").alias("_v")).groupBy("_bucket").agg(F.sum("_v").alias("_s"))
        before = sums.select("_bucket", (F.sum("_s").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).alias("_carried"))
        self.df = self._across(self._placed().withColumn(name, total), before).withColumn(name, F.col(name) + F.col("_carried") + start).drop("_carried")
        return self

    def previous(self, name: str, value: Column) -> Ordered:
        """Adds value of the row before as a struct with the field v; null before the first row. For ascending keys."""
        if self.down:
            raise ValueError("previous: the keys must be ascending")
        boxed = F.struct(value.alias("v"))
        if self.whole:
            self.df = self.df.withColumn(name, F.lag(boxed).over(self.window))
            return self
        last = self.df.groupBy("_bucket").agg(F.max_by(boxed, F.struct(*self.by)).alias("_carried"))
        last = last.select("_bucket", F.lag("_carried").over(W.orderBy("_bucket")).alias("_carried"))
        self.df = self._across(self._placed().withColumn(name, F.lag(boxed).over(self.window)), last).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
        return self

    def done(self) -> DataFrame:
        return self.df.drop("_bucket")


def number_rows(df: DataFrame, by: Sequence[str], name: str = "_row", start: int = 1) -> DataFrame:
    """Dense row numbers in the order of a unique key."""
    return Ordered(df, by).running(name, start=start - 1).done()
