"""Connected components by rounds of large-star and small-star, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm.common import materialize


def _print_of(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, root) for every node with an edge, root being the least node of its component; roots aren't listed.

    edges: columns a, b (long), in either direction, repeats and loops allowed. A hub's rows meet its minimum in a join, which
    adaptive execution splits; no group is ever gathered.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(ordered, "edges")
    before = None
    for _ in range(rounds):
        if (seen := _print_of(now)) == before or not seen[0]:
            return now.select("a", F.col("b").alias("root"))
        before = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    raise RuntimeError("components did not settle")
