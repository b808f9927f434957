"""Benchmark decontamination by winnowing. DataFrame functions only.

A text's fingerprints are the least hashes of K-word grams in every window of WINDOW - K + 1 of them, so any span of WINDOW words
that two texts share has the same fingerprint in both. A byte map of the benchmark's fingerprints (two probes) lets nearly no other
window of a document through; what passes is joined to the benchmark by fingerprint and by the window's full words, which extends
each fingerprint to every shared window around it. A benchmark item of fewer words than WINDOW is one window; those few lengths
are looked up by the hash of their whole gram.

Null or empty text has no words: never hit, and an item without words matches nothing. An empty benchmark leaves all documents
clean. Repeated documents or items count each by itself, items of equal item_id as one. An item with a null item_id hits words like
others and counts as an item, all of those as one; having no name it stands in items, and in their digest, as the empty string. Very
long texts are worked out whole, in arrays of their words. Rows are told apart by number, not doc_id; columns of the input besides
doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.llm.common import drop_rows, materialize, text_or_empty

WINDOW, K = 10, 5
#: Bytes of the map of fingerprints at most, as it is part of the plan; beyond, it lets more through, which the join then rejects.
MAP_BYTES = 1 << 21
#: Windows of the benchmark up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_WINDOWS = 100_000
#: A gram of so many words is hashed from two of these numbers, on both sides alike.
_PARTS = {3: (2, 1), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 9: (8, 1)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of [0-9a-z] and non-ASCII characters, A-Z lower-cased and nothing else."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _ahead(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _joined(df: DataFrame, name: str, left: str, right: str, by: int) -> DataFrame:
    """Hashes of longer grams from two shorter ones; entries too near the end are of no text and are cut off later."""
    return df.withColumn(name, F.zip_with(F.col(left), _ahead(F.col(right), by), lambda a, b: F.xxhash64(a, b)))


def _least(df: DataFrame, name: str, of: str, by: int) -> DataFrame:
    return df.withColumn(name, F.zip_with(F.col(of), _ahead(F.col(of), by), lambda a, b: F.least(a, b)))


def with_grams(df: DataFrame, lengths: set[int]) -> DataFrame:
    """From words: n_words, and h<L>, one hash for each window of L words; h10 is the winnowed fingerprint of each window."""
    df = df.withColumn("n_words", F.size("words")).withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    df = _joined(df, "g2", "g1", "g1", 1)
    df = _joined(df, "g4", "g2", "g2", 2)
    made = {1, 2, 4}
    if WINDOW in lengths:
        df = _joined(df, "g5", "g4", "g1", 4)
        made.add(5)
        df = _least(df, "m2", "g5", 1)
        df = _least(df, "m4", "m2", 2)
        df = df.withColumn(f"g{WINDOW}", F.zip_with(F.col("m4"), _ahead(F.col("m2"), 4), lambda a, b: F.least(a, b)))
    for n, (big, rest) in _PARTS.items():
        if n in lengths or n == 3 and 7 in lengths or n == 8 and 9 in lengths:
            df = _joined(df, f"g{n}", f"g{big}", f"g{rest}", big) if n not in made else df
            made.add(n)
    for n in sorted(lengths):
        df = df.withColumn(f"h{n}", F.slice(f"g{n}", 1, F.greatest(F.col("n_words") - (n - 1), F.lit(0))))
    return df


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, len, fp, window of every window of every item."""
    items = benchmark.select(F.col("item_id"), words_of(text_or_empty()).alias("words"))
    items = with_grams(items.where(F.size("words") > 0), set(range(1, WINDOW + 1)))
    own = F.least(F.col("n_words"), F.lit(WINDOW))
    # A short item's only gram is the first of its length.
    hashes = F.when(F.col("n_words") >= WINDOW, F.col(f"h{WINDOW}"))
    for n in range(1, WINDOW):
        hashes = hashes.when(F.col("n_words") == n, F.slice(f"h{n}", 1, 1))
    at = items.select("item_id", "words", own.alias("len"), F.posexplode(hashes).alias("start", "fp"))
    return at.select("item_id", "len", "fp", F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ").alias("window"))


def _probe(maps: dict[int, tuple[bytes, int]], n: int, h: Column) -> Column:
    """Whether both bytes of the map for this hash are set."""
    bits, size = maps[n]
    there = lambda k: F.substring(F.lit(bits), F.pmod(k, F.lit(size)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    return there(h) & there(F.shiftright(h, 24))


def _maps(windows: DataFrame) -> dict[int, tuple[bytes, int]]:
    """By window length: the byte map of the benchmark's fingerprints. What comes to the driver is bounded by the map."""
    maps = {}
    counts = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count_distinct("fp").alias("n")).collect()}
    for n, fps in counts.items():
        size = min(MAP_BYTES, 1 << max(10, math.ceil(math.log2(fps * 64))))
        slot = F.explode(F.array(F.pmod("fp", F.lit(size)), F.pmod(F.shiftright("fp", 24), F.lit(size))))
        bits = bytearray(size)
        for r in windows.where(F.col("len") == n).select(slot.alias("k")).distinct().toLocalIterator():
            bits[r["k"]] = 1
        maps[n] = (bytes(bits), size)
    return maps


_CANDS = "array<struct<start:int,len:int,fp:bigint,window:string>>"


def _found(maps: dict[int, tuple[bytes, int]], n: int) -> Column:
    """The windows of n words that the map lets through; in nearly all documents there is none."""

    def one(h: Column, i: Column) -> Column:
        window = F.array_join(F.slice("words", i + 1, n), " ")
        return F.when(_probe(maps, n, h), F.struct(i.cast("int").alias("start"), F.lit(n).alias("len"), h.alias("fp"), window.alias("window")))

    some = F.exists(f"h{n}", lambda h: _probe(maps, n, h))
    return F.when(some, F.array_compact(F.transform(f"h{n}", one))).otherwise(F.array().cast(_CANDS))


def candidates(docs: DataFrame, maps: dict[int, tuple[bytes, int]], keep: list[str]) -> DataFrame:
    """keep, n_words, cands: the windows that may be in the benchmark, with their words."""
    rows = docs.select(*keep, words_of(text_or_empty()).alias("words"))
    rows = with_grams(rows, set(maps)) if maps else rows.withColumn("n_words", F.size("words"))
    found = [F.array().cast(_CANDS)] + [_found(maps, n) for n in sorted(maps)]
    return rows.select(*keep, "n_words", F.concat(*found).alias("cands"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the items' ids and a hash of the text, of every document."""
    windows = materialize(benchmark_windows(benchmark), "windows")
    texts = windows.select("len", "fp", "window").distinct()
    small = windows.count() <= BROADCAST_WINDOWS
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(text_or_empty()).alias("text_hash")).withColumn("_row", F.monotonically_increasing_id())
    table = materialize(candidates(rows, _maps(windows), ["_row", "doc_id", "text_hash"]), "candidates")
    at = table.where(F.size("cands") > 0).select("_row", F.inline("cands"))
    sure = at.join(F.broadcast(texts) if small else texts, ["len", "fp", "window"])
    spots = sure.groupBy("_row").agg(F.collect_set(F.struct("start", "len")).alias("spots"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    named = windows.select("len", "fp", "window", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    items = sure.select("_row", "len", "fp", "window").distinct().join(F.broadcast(named) if small else named, ["len", "fp", "window"])
    items = items.groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    facts = spots.select("_row", covered.cast("long").alias("n_hit")).join(items, "_row")
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return table.select("_row", "doc_id", "text_hash", F.col("n_words").cast("long")).join(facts, "_row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), names.alias("items"), "text_hash"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0) -> DataFrame:
    """Documents without a shared window (or of which at most least_share of the words are hit), with all their columns."""
    bad = hits(docs, benchmark).where("contaminated").where(F.col("n_hit") > F.col("n_words") * least_share).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_key"))
    # With the text's hash, documents that lack an id aren't taken for one another.
    return drop_rows(docs, materialize(bad, "contaminated"), F.xxhash64(text_or_empty()))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lens WHERE len(words) >= n)
), m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), it AS (
  SELECT doc_id, list_sort(list(DISTINCT coalesce(CAST(item_id AS VARCHAR), ''))) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(it.items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(it.items, ','), '')) AS items_sha256,
  coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
