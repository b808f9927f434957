"""filegen: generated columns and whole generated tables."""

from __future__ import annotations

import itertools
import math
import os
import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsmith.functions.expr import compile_expr
from colsmith.functions.numfmt import format_num, is_format
from colsmith.functions.registry import Registry

GENERATORS = Registry("generator")
#: line (from 1) and column (from 1) to a text Column; second, the generator's own number of rows, if it has one.
Generator = tuple[Callable[[Column, int], Column], int | None]


@GENERATORS.push("grid")
def _grid(arg: str, seed: int | None) -> Generator:
    """line_column."""
    return (lambda line, c: F.concat(line.cast("string"), F.lit(f"_{c}"))), None


@GENERATORS.push("null")
def _null(arg: str, seed: int | None) -> Generator:
    """Nothing."""
    return (lambda line, c: F.lit("")), None


@GENERATORS.push("count")
def _count(arg: str, seed: int | None) -> Generator:
    """Numbers from a start, 0 by default."""
    start = int(arg) if arg else 0
    return (lambda line, c: (line + (start - 1)).cast("string")), None


@GENERATORS.push("expr")
def _expr(arg: str, seed: int | None) -> Generator:
    """[format,]expression of line and col."""
    head, _, rest = arg.partition(",")
    fmt, text = (head, rest) if rest and is_format(head) else ("plain", arg)
    return (lambda line, c: format_num(compile_expr(text, lambda n: {"line": line.cast("double"), "col": F.lit(float(c))}.get(n), seed=seed), fmt)), None


@GENERATORS.push("decimal")
def _decimal(arg: str, seed: int | None) -> Generator:
    """[-]NNN[.NNN]: random digits, each N one, - for a random sign."""
    m = re.fullmatch(r"(-?)([^.]+)(?:\.(.+))?", arg)
    if not m:
        raise ValueError(f"decimal: can't read {arg!r}")

    def make(line: Column, c: int) -> Column:
        draws = itertools.count((seed or 0) * 1000 + c * 50)
        rand = lambda: F.rand(next(draws)) if seed is not None else F.rand()
        digits = lambda n: F.concat(*[F.floor(rand() * 10).cast("string") for _ in range(n)])
        out = [digits(len(m[2]))]
        if m[3]:
            out += [F.lit("."), digits(len(m[3]))]
        sign = F.when(rand() < 0.5, "-").otherwise("") if m[1] else F.lit("")
        return F.concat(sign, *out)

    return make, None


@GENERATORS.push("normal")
def _normal(arg: str, seed: int | None) -> Generator:
    """mean,deviation,format: Gaussian numbers."""
    parts = arg.split(",", 2) if arg else []
    mean, dev = (float(parts[0]) if parts else 0.0), (float(parts[1]) if len(parts) > 1 else 1.0)
    fmt = parts[2] if len(parts) > 2 else "plain"
    return (lambda line, c: format_num((F.randn(seed + c) if seed is not None else F.randn()) * dev + mean, fmt)), None


def _tuples(kind: str) -> Callable[[str, int | None], Generator]:
    def make(arg: str, seed: int | None) -> Generator:
        size, _, rest = arg.partition(":")
        items = rest.split(",")
        k, n = int(size), len(items)
        total = {"combine": math.comb(n, k), "combine-r": math.comb(n + k - 1, k), "permute": math.perm(n, k), "permute-r": n**k}[kind]
        if not total:
            raise ValueError(f"{kind}: nothing to choose from")
        if kind == "permute-r":  # digits of the line number, no list needed
            values = F.array(*map(F.lit, items))

            def odometer(line: Column, c: int) -> Column:
                at = (line - 1) % total
                return F.concat_ws(",", *[F.element_at(values, (F.floor(at / F.lit(n ** (k - 1 - i))) % n + 1).cast("int")) for i in range(k)])

            return odometer, total
        if total > 100_000:
            raise ValueError(f"{kind}: {total} tuples; use tuples_table for so many")
        pick = {"combine": itertools.combinations, "combine-r": itertools.combinations_with_replacement, "permute": itertools.permutations}[kind]
        listed = F.array(*[F.lit(",".join(t)) for t in pick(items, k)])
        return (lambda line, c: F.element_at(listed, ((line - 1) % total + 1).cast("int"))), total

    make.__doc__ = {"combine": "k:a,b,c: combinations in order, again and again.", "combine-r": "Combinations with repetition.", "permute": "Permutations of k.", "permute-r": "All tuples of k."}[kind]
    return make


for _kind in ("combine", "combine-r", "permute", "permute-r"):
    GENERATORS.push(_kind, _tuples(_kind))


def tuples_table(spark: SparkSession, kind: str, k: int, items: Sequence[str]) -> DataFrame:
    """All k-tuples of items as columns v1..vk: joins on positions, which is the feature asked for, so every pair is wanted."""
    base = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, v string")
    out = base.select(F.col("i").alias("i1"), F.col("v").alias("v1"))
    for n in range(2, k + 1):
        nxt = base.select(F.col("i").alias(f"i{n}"), F.col("v").alias(f"v{n}"))
        prev = f"i{n - 1}"
        on = {"combine": F.col(prev) < F.col(f"i{n}"), "combine-r": F.col(prev) <= F.col(f"i{n}"), "permute-r": F.lit(True)}.get(kind)
        if on is None:
            on = F.lit(True)
            for m in range(1, n):
                on = on & (F.col(f"i{m}") != F.col(f"i{n}"))
        out = out.join(F.broadcast(nxt), on)
    return out.select(*[f"v{n}" for n in range(1, k + 1)])


def generate(spark: SparkSession, columns: Sequence[str], lines: int | None = None, seed: int | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Columns by spec method,arguments; N*spec repeats one. lines: 10 by default, or the most that finite generators have."""
    specs: list[str] = []
    for c in columns:
        m = re.match(r"(\d+)\*(.*)", c)
        specs += [m[2]] * int(m[1]) if m else [c]
    made = []
    for c in specs:
        name, _, arg = c.partition(",")
        made.append(GENERATORS.get(name or "grid")(arg, seed))
    own = [n for _, n in made if n]
    lines = lines if lines is not None else max(own, default=10)
    line = F.col("id") + 1
    names = names or [f"c{i + 1}" for i in range(len(made))]
    return spark.range(lines).select(line.alias("_row"), *[g(line, i + 1).alias(n) for i, ((g, _), n) in enumerate(zip(made, names))])


def random_bytes(n: int, seed: int | None = None) -> bytes:
    """n bytes of 0 to 254, on the driver."""
    if seed is None:
        return bytes(b % 255 for b in os.urandom(n))
    import random

    rnd = random.Random(seed)
    return bytes(rnd.randrange(255) for _ in range(n))


def _letters(df: DataFrame, word: str) -> DataFrame:
    """(word, place, letter, which occurrence) of every letter."""
    at = F.posexplode(F.split(F.col(word), "(?!$)"))
    rows = df.select(F.col(word).alias("word"), at.alias("place", "letter"))
    before = F.length(F.substring(F.col("word"), F.lit(1), F.col("place"))) - F.length(F.replace(F.substring(F.col("word"), F.lit(1), F.col("place")), F.col("letter"), F.lit("")))
    return rows.withColumn("nth", before.cast("int"))


def rank_words(candidates: DataFrame, vocabulary: DataFrame, column: str = "value") -> DataFrame:
    """word, score: how evenly each word's letters, and its letters by place, split the candidates (lower case, all of one length).

    Letters and places are counted over the candidates once; the counts, at most 26 times the length, are broadcast.
    """
    cand = candidates.select(F.col(column).alias("w")).where(F.col("w").rlike("\\A[a-z]+\\z"))
    size = cand.agg(F.count("*").alias("n"), F.max(F.length("w")).alias("len"))
    letters = _letters(cand, "w")
    having = letters.select("word", "letter", "nth").groupBy("letter", "nth").agg(F.count("*").alias("have"))
    placed = letters.groupBy("place", "letter").agg(F.count("*").alias("here"))
    vocab = vocabulary.select(F.col(column).alias("w")).where(F.col("w").rlike("\\A[a-z]+\\z")).distinct().join(F.broadcast(size), F.length("w") == F.col("len"))
    rows = _letters(vocab, "w").join(F.broadcast(size))
    rows = rows.join(F.broadcast(having), ["letter", "nth"], "left").join(F.broadcast(placed), ["place", "letter"], "left")
    half = F.floor(F.col("n") / 2)
    balance = lambda c: half - F.abs(F.coalesce(c, F.lit(0)) - half)
    third = balance(F.col("here")) / 3
    score = balance(F.col("have")) + F.when(third < 0, F.ceil(third)).otherwise(F.floor(third))
    return rows.groupBy("word").agg(F.sum(score).cast("long").alias("score"))


def sub_anagrams(words: DataFrame, phrase: str, column: str = "value") -> DataFrame:
    """Words that can be spelt with the letters of a phrase: one predicate a letter."""
    have = Counter(c for c in phrase.lower() if c.isalpha())
    w = F.lower(F.col(column))
    ok = w.rlike("\\A[a-z]+\\z")
    for ch in "abcdefghijklmnopqrstuvwxyz":
        ok = ok & (F.length(w) - F.length(F.replace(w, F.lit(ch), F.lit(""))) <= have[ch])
    return words.where(ok)


def anagrams(words: DataFrame, phrase: str, column: str = "value", frequency: str | None = None, most_words: int = 4000, most: int = 100_000) -> DataFrame:
    """Sets of words that use up a phrase's letters, with a score (product of frequencies, as a sum of logarithms), best first.

    Spark keeps the words that fit, the most frequent most_words of them; the search runs over those in one Arrow task, which takes
    the rarest letter still to use first. Both limits are the feature's own: a search is not asked for more.
    """
    fits = sub_anagrams(words, phrase, column).select(F.lower(F.col(column)).alias("w"), (F.col(frequency).cast("double") if frequency else F.lit(1.0)).alias("f"))
    fits = fits.groupBy("w").agg(F.max("f").alias("f")).orderBy(F.desc("f"), "w").limit(most_words)
    letters = sorted(c for c in phrase.lower() if c.isalpha())

    def search(batches):
        import pandas as pd

        pool = [(Counter(w), w, f) for pdf in batches for w, f in zip(pdf["w"], pdf["f"])]
        pool.sort(key=lambda x: x[1])
        found: list[tuple[str, float]] = []

        def go(left: Counter, first: int, taken: list[int]) -> None:
            if len(found) >= most:
                return
            if not left:
                found.append((" ".join(pool[i][1] for i in taken), sum(math.log(max(pool[i][2], 1e-9)) for i in taken)))
                return
            usable = [i for i in range(len(pool)) if all(left[c] >= n for c, n in pool[i][0].items())]
            rarest = min(left, key=lambda c: (sum(c in pool[i][0] for i in usable), c))
            for i in usable:
                if rarest in pool[i][0]:
                    go(left - pool[i][0], i, [*taken, i])

        go(Counter(letters), 0, [])
        rows = {" ".join(sorted(t.split())): s for t, s in found}
        yield pd.DataFrame({"anagram": list(rows), "score": list(rows.values())}, columns=["anagram", "score"]).astype({"anagram": "object", "score": "float64"})

    return fits.coalesce(1).mapInPandas(search, "anagram string, score double").orderBy(F.desc("score"), "anagram")


def describe() -> list[tuple[str, str]]:
    return GENERATORS.describe()
