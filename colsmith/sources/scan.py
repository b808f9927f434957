"""Text files as tables: header forms, delimiters, quotes, escapes; rows know their file, number and place.

Columns are text; a short row's missing ones are empty. Metadata: _file, _row (from 1 in each file, the header not counted), _byte
(offset after a byte order mark and the header), _line, _ncols. Parquet and other typed tables pass through Spark's own readers.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsmith.functions import text as T
from colsmith.plans.columns import valid_name
from colsmith.sources.spec import MARK, Format, parse

META = ("_file", "_row", "_byte", "_line", "_ncols")


def inline(text: str) -> list[str]:
    r"""Lines of a literal such as <<one\ttwo\nthree: \n, \t and \s are escapes."""
    body = text.removeprefix("<<").replace("\\n", "\n").replace("\\t", "\t").replace("\\s", " ")
    return body.removesuffix("\n").split("\n")


def tokenize(line: str, f: Format) -> list[str]:
    """Fields of one record with quotes and backslashes, which may begin amid a field; a doubled close is a literal one."""
    if f.mode == "whole":
        return [line]
    closes = dict(f.quotes)
    out, now, k, close = [], "", 0, ""
    white = f.mode.startswith("white")
    while k < len(line):
        ch = line[k]
        if f.backslash and ch == "\\" and k + 1 < len(line):
            now += {"n": "\n", "r": "\r", "t": "\t"}.get(line[k + 1], line[k + 1])
            k += 2
        elif close:
            if ch == close:
                if line[k + 1 : k + 2] == close:
                    now += ch
                    k += 1
                else:
                    close = ""
            else:
                now += ch
            k += 1
        elif ch in closes:
            close = closes[ch]
            k += 1
        elif white and ch in " \t\r\n\f":
            run = re.match(r"[ \t\r\n\f]+", line[k:])[0]
            out.append(now)
            now = run if f.mode == "white-keep" else ""
            k += len(run)
        elif not white and line.startswith(f.delimiter, k):
            out.append(now)
            now = ""
            k += len(f.delimiter)
        else:
            now += ch
            k += 1
    out.append(now)
    if f.mode == "white-drop":
        out = [x for i, x in enumerate(out) if x or 0 < i < len(out) - 1] or [""]
    return out


def records(text: str, f: Format) -> Iterator[tuple[str, int]]:
    """(record, its first byte) of a text: a line end within open quotes goes on as a line feed, ends the record, or is an error."""
    held, begin, at = None, 0, 0
    for m in re.finditer(r"([^\r\n]*)(\r\n|\n|\r|\Z)", text):
        if not m[0]:
            break
        if held is None:
            held, begin = m[1], at
        else:
            held = f"{held}\n{m[1]}"
        at += len(m[0].encode("utf-8", "surrogatepass"))
        if f.quotes and _open(held, f):
            if f.unterminated == "error":
                raise ValueError(f"quotes still open at the end of {m[1]!r}")
            if f.unterminated == "continue":
                continue
        yield held, begin
        held = None
    if held is not None:
        yield held, begin


def _open(line: str, f: Format) -> bool:
    closes, close, k = dict(f.quotes), "", 0
    while k < len(line):
        ch = line[k]
        if f.backslash and ch == "\\":
            k += 2
            continue
        if close:
            if ch == close:
                if line[k + 1 : k + 2] == close:
                    k += 1
                else:
                    close = ""
        elif ch in closes:
            close = closes[ch]
        k += 1
    return bool(close)


def split_column(line: Column, f: Format) -> Column:
    """Fields as an array; a JVM expression wherever no quotes are involved."""
    if f.mode == "whole":
        return F.array(line)
    if f.simple:
        if f.mode == "white-drop":
            return F.split(F.regexp_replace(line, "^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$", ""), "[ \\t\\r\\n\\f]+", -1)
        if f.mode == "white-keep":
            return F.regexp_extract_all(line, F.lit("^[^ \\t\\r\\n\\f]*|[ \\t\\r\\n\\f]+[^ \\t\\r\\n\\f]*"), 0)
        return F.split(line, T.quoted(f.delimiter), -1)
    if not f.quotes and f.mode == "text":  # cut where an even number of backslashes stands in front, then undo them
        parts = F.split(line, "(?<=(?<!\\\\)(?:\\\\\\\\){0,64})" + T.quoted(f.delimiter), -1)
        undo = lambda c: F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\\\"), F.lit("\x00")), "\\\\n", "\n"), "\\\\r", "\r"), "\\\\t", "\t"), "\\\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))
        return F.transform(parts, undo)
    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: tokenize(x, f))

    return cut(line)


def header_of(line: str | None, spec: Format) -> tuple[list[str] | None, Format, bool]:
    """(names or none, the format with what a marked header sets, whether the line is a header)."""
    if line is None:
        return None, spec, False
    if line.startswith(MARK) and spec.marked in ("optional", "required") and len(line) > len(MARK):
        cut = line[len(MARK)]
        quote = line[len(MARK) + 1 : len(MARK) + 2]
        f = Format(cut, "text", ((quote, quote),) if quote in ('"', "'") and quote else spec.quotes, spec.backslash, spec.unterminated, spec.header, spec.marked, spec.crlf)
        names = tokenize(line[len(MARK) + 1 + (quote in ('"', "'") and bool(quote)) :], Format(cut))
        return [valid_name(n) for n in names], f, True
    if spec.marked == "required":
        raise ValueError("the file has no marked header")
    if line.startswith(MARK) and spec.marked == "forbidden":
        raise ValueError("the file has a marked header")
    if spec.header:
        return [valid_name(n) for n in tokenize(line, spec)], spec, True
    return None, spec, False


def _first_line(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).limit(1).first()
    if row is None:
        return None
    return (row[0] or "").removeprefix("\ufeff")


def _columns(raw: DataFrame, names: Sequence[str], f: Format) -> DataFrame:
    parts = raw.withColumn("_parts", split_column(F.col("_line"), f))
    fields = [F.coalesce(F.try_element_at("_parts", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return parts.select(*fields, "_file", "_row", "_byte", "_line", F.size("_parts").alias("_ncols"))


def _from_records(spark: SparkSession, lines: Sequence[str], spec: Format, name: str) -> DataFrame:
    lines = [x.removeprefix("\ufeff") if i == 0 else x for i, x in enumerate(lines)]
    names, f, is_header = header_of(lines[0] if lines else None, spec)
    body = lines[1:] if is_header else lines
    names = names or [f"c{i + 1}" for i in range(len(tokenize(body[0], f)) if body else 1)]
    rows, at = [], 0
    for i, x in enumerate(body):
        rows.append((name, i + 1, at, x))
        at += len(x.encode()) + 1
    return _columns(spark.createDataFrame(rows, "_file string, _row long, _byte long, _line string"), names, f)


def read_lines(spark: SparkSession, lines: Sequence[str] | str, spec: str | Format = "", name: str = "-") -> DataFrame:
    """A table from lines, or from an inline literal <<..."""
    f = parse(spec) if isinstance(spec, str) else spec
    return _from_records(spark, inline(lines) if isinstance(lines, str) else lines, f, name)


def _stream(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.open(where) if fs.exists(where) and fs.getFileStatus(where).isFile() else None


def is_packed(spark: SparkSession, path: str) -> bool:
    """Whether a file begins like gzip, on any file system of Spark's."""
    data = _stream(spark, path)
    if data is None:
        return False
    try:
        return [data.read() for _ in range(3)] == [0x1F, 0x8B, 8]
    finally:
        data.close()


def eol_of(spark: SparkSession, path: str) -> str:
    """The end of a file's first line: a line feed, a carriage return, or both; a line feed if there is none."""
    if not path.endswith(".gz") and is_packed(spark, path):
        return "\n"
    row = spark.read.option("lineSep", "\n").text(path).select(F.col("value").rlike("^[^\r]*\r$").alias("both"), F.col("value").rlike("\r").alias("some")).limit(1).first()
    return "\n" if row is None or not row["some"] else "\r\n" if row["both"] else "\r"


def read_text(spark: SparkSession, path: str, spec: str | Format = "") -> DataFrame:
    """One text file, from any file system of Spark's (s3:// is s3a://); gzip is told by its first bytes, whatever the file's name.

    Line ends may be line feeds, carriage returns or both, mixed. Without open quotes across lines the file is read in parallel, cut at
    line feeds. Row numbers and offsets come from each split's counts, one small row a split; quotes that may hold line ends need
    the records in order, so such a file is one task, and so is one of carriage returns alone. A header is the file's first record.
    """
    f = parse(spec) if isinstance(spec, str) else spec
    path = re.sub("^s3://", "s3a://", path)
    if not path.endswith(".gz") and is_packed(spark, path):  # Spark chooses codecs by name
        return _numbered(spark, _unpacked(spark, path), path, f)
    if f.quotes and f.unterminated in ("continue", "error"):
        return _numbered(spark, spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")), path, f)
    first = _first_line(spark, path)
    names, f2, is_header = header_of(first, f)
    if names is None:
        names = [f"c{i + 1}" for i in range(len(tokenize(first, f2)) if first is not None else 1)]
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # What ends in a line feed may end in a carriage return too, and hold lines that end in one alone.
    pieces = F.split(F.regexp_replace("value", "\r$", ""), "\r", -1)
    raw = raw.select("_file", "_block", "_id", F.endswith("value", F.lit("\r")).alias("_cr"), F.size(pieces).alias("_pieces"), F.posexplode(pieces).alias("_at", "_line"))
    raw = raw.withColumn("_size", F.octet_length("_line") + 1 + F.when(F.col("_cr") & (F.col("_at") + 1 == F.col("_pieces")), 1).otherwise(0))
    inside = W.partitionBy("_file", "_block").orderBy("_id", "_at").rowsBetween(W.unboundedPreceding, 0)
    per = raw.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    up_to = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    per = per.select("_file", "_block", (F.sum("_n").over(up_to) - F.col("_n")).alias("_n0"), (F.sum("_s").over(up_to) - F.col("_s")).alias("_s0"))
    here = raw.withColumn("_k", F.count("*").over(inside)).withColumn("_b", F.sum("_size").over(inside) - F.col("_size")).join(per, ["_file", "_block"])
    here = here.select(F.regexp_replace("_line", "^\ufeff", "").alias("_line"), "_file", (F.col("_k") + F.col("_n0")).alias("_row"), (F.col("_b") + F.col("_s0")).alias("_byte"), "_size")
    if is_header:
        head = here.where("_row = 1").select("_file", F.col("_size").alias("_head"))
        here = here.join(head, "_file").where("_row > 1").select("_line", "_file", (F.col("_row") - 1).alias("_row"), (F.col("_byte") - F.col("_head")).alias("_byte"))
    return _columns(here, names, f2)


def _unpacked(spark: SparkSession, path: str) -> DataFrame:
    """value, file of a gzip file under another name, unpacked by a task."""

    def unpack(batches):
        for pdf in batches:
            for content, file in zip(pdf["content"], pdf["path"]):
                yield pd.DataFrame([(gzip.decompress(content).decode("utf-8", "replace"), file)], columns=["value", "file"])

    return spark.read.format("binaryFile").load(path).select("content", "path").mapInPandas(unpack, "value string, file string")


def _numbered(spark: SparkSession, files: DataFrame, path: str, f: Format) -> DataFrame:
    """Rows of whole texts (value, file), each text's records in order by one task."""
    row = files.select(F.regexp_extract("value", "^\ufeff?([^\r\n]*)", 1).alias("line")).limit(1).first()
    names, f2, is_header = header_of(row["line"] if row else None, f)

    def cut(batches):
        for pdf in batches:
            for text, file in zip(pdf["value"], pdf["file"]):
                rows, skip, text = [], 0, text.removeprefix("\ufeff")
                for n, (record, at) in enumerate(records(text, f2)):
                    if n == is_header:
                        skip = at
                    if n >= is_header:
                        rows.append((file, n + 1 - is_header, at - skip, record))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["_file", "_row", "_byte", "_line"])
                        rows = []
                yield pd.DataFrame(rows, columns=["_file", "_row", "_byte", "_line"])

    rows = files.mapInPandas(cut, "_file string, _row long, _byte long, _line string")
    if names is None:
        one = rows.where("_row = 1").select("_line").first()
        names = [f"c{i + 1}" for i in range(len(tokenize(one[0], f2)) if one else 1)]
    return _columns(rows, names, f2)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A typed table: Parquet, ORC, JSON or CSV by its name."""
    kind = next((k for k in ("orc", "json", "csv") if path.rstrip("/").endswith(k)), "parquet")
    return spark.read.option("header", "true").csv(path) if kind == "csv" else getattr(spark.read, kind)(path)


def previous_line(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds _before, the line of the row in front."""
    from colsmith.operators.filter import whole_line
    from colsmith.plans.ordering import Ordered

    return Ordered(df, by).previous("_before", whole_line(df)).done().withColumn("_before", F.col("_before")["v"])
