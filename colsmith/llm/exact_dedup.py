"""Exact deduplication that compares full content and survives hot groups. DataFrame functions only.

Texts are equal when identical after each run of ASCII white space became one space. Copies are combined locally (partial
aggregation before the shuffle), then by salted digest group, then the salts' winners globally; the full text is a grouping key at
every step, so two texts that shared a digest would stay apart. Only digests that hold a thousandth of all rows are salted, which
bounds their number; the other texts cross the network once.

Of equal texts one row stays: that of the smallest doc_id, nulls last; of rows that share that id (or have none) just one, told apart
by a number that each row gets in a stored table. So an all-null group keeps one row, with a null keep_id.

Null text counts as empty. Empty texts are copies of each other. Very long texts are keys like others, whole. Rows that repeat both
doc_id and text are copies. An empty table gives an empty table. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.llm.common import drop_rows, hot_keys, join_by_key, materialize, text_or_empty

SALTS = 32
#: A column of our own beside those of the input, whatever they are called.
_KEY = "__colsmith_text_digest"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, norm, digest (SHA-256 of the normalised text, 32 bytes)."""
    return docs.select(F.col("doc_id").cast("long"), normalised(text_or_empty()).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))


def _groups(docs: DataFrame) -> DataFrame:
    """digest, doc_id, keep_id, group_size, kept of every row."""
    texts = digests(docs)
    keyed = materialize(texts.select("doc_id", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    sizes = keyed.groupBy("digest", salt.alias("salt")).agg(F.count("*").alias("n"), first.alias("first"))
    sizes = sizes.groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    sizes = materialize(sizes.select("digest", "n", F.col("first.row").alias("first_row")), "copied")
    hot = materialize(hot_keys(sizes, "digest", keyed.count()), "hot-digests")

    marked = texts.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "digest", "left")
    local = marked.withColumn("salt", F.when(F.col("_hot"), salt + 1).otherwise(F.lit(0)))
    # `of` repeats the salt as an aggregate, so that the two filters below stay above one shared shuffle.
    salted = local.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("salt").alias("of"))
    cold = salted.where(F.col("of") == 0).select("digest", "keep_id", "group_size")
    merged = salted.where(F.col("of") > 0).groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    winners = cold.unionByName(merged.select("digest", "keep_id", "group_size")).join(sizes.select("digest", "first_row"), "digest", "left")
    winners = materialize(winners, "winners")

    clashing = winners.groupBy("digest").count().where("count > 1").select("digest")
    kept = F.coalesce(F.col("row") == F.col("first_row"), F.lit(True))  # a text that occurs once has no first row
    found = join_by_key(keyed, winners, "digest", hot).select("digest", "doc_id", "keep_id", "group_size", kept.alias("kept"))
    if not clashing.isEmpty():  # different texts of one digest: these alone are told apart by content
        own = materialize(texts.join(clashing, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "clashing")
        exact = own.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), first.alias("first"))
        exact = own.join(exact, ["digest", "norm"]).select("digest", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("first.row")).alias("kept"))
        found = found.join(clashing, "digest", "left_anti").unionByName(exact)
    return found


def groups(docs: DataFrame) -> DataFrame:
    """Every document with keep_id, group_size, kept and text_sha256."""
    return _groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat doc_id and text one stays."""
    facts = materialize(_groups(docs).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_key"), "kept", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).alias("_tied")), "facts")
    digest = F.unhex(F.sha2(normalised(text_or_empty()), 256))
    left = drop_rows(docs, facts.where("not kept and not _tied").select("_id", "_key"), digest)
    if not facts.where("_tied").isEmpty():
        left = left.withColumn(_KEY, digest).dropDuplicates(["doc_id", _KEY]).drop(_KEY)
    return left


SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
