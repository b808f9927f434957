"""Tables as text: delimiters, nine escape modes, headers, line ends."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsmith.functions import text as T
from colsmith.functions.numfmt import plain
from colsmith.plans import columns as C
from colsmith.sources.spec import MARK, Format

ESCAPES = ("quote-doubled", "always-quote-doubled", "quote-backslash", "always-quote-backslash", "backslash", "error", "trust", "replace", "delete")


@dataclass(frozen=True)
class Output:
    """How to write: escape is a mode of ESCAPES (replace with its character as replace:x); header none, plain or marked."""

    delimiter: str = "\t"
    escape: str = "replace: "
    quote: str = '"'
    header: str = "none"
    eol: str = "\n"


def derived(f: Format, header: str = "none", eol: str | None = None) -> Output:
    """The output that matches an input format; eol is the input's line end, which a format with one of its own overrides."""
    if f.backslash:
        escape = "quote-backslash" if f.quotes else "backslash"
    else:
        escape = "quote-doubled" if f.quotes else "replace:" + ("." if f.delimiter == " " else " ")
    return Output(f.delimiter, escape, f.quotes[0][0] if f.quotes else '"', header, "\r\n" if f.crlf else eol or "\n")


def escaped(c: Column, o: Output) -> Column:
    """One value as it is written."""
    mode, _, with_ = o.escape.partition(":")
    if mode not in ESCAPES:
        raise ValueError(f"no escape mode {o.escape!r}")
    c = T.empty_if_null(c)
    if mode == "trust":
        return c
    special = f"{T.quoted(o.delimiter)}|[\n\r]"
    slashed = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit(o.delimiter), F.lit("\\t" if o.delimiter == "\t" else "\\" + o.delimiter))
    if mode == "replace":
        return F.regexp_replace(c, special, with_ or " ")
    if mode == "delete":
        return F.regexp_replace(c, special, "")
    if mode == "backslash":
        return slashed(c)
    if mode == "error":
        return F.when(c.rlike(special), F.raise_error(F.concat(F.lit("value holds a delimiter or line end: "), c)).cast("string")).otherwise(c)
    q = o.quote
    if mode.endswith("doubled"):
        inner = F.replace(c, F.lit(q), F.lit(q + q))
    else:
        inner = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(q), F.lit("\\" + q))
    quoted = F.concat(F.lit(q), inner, F.lit(q))
    if mode.startswith("always"):
        return quoted
    return F.when(c.rlike(f"{special}|{T.quoted(q)}" + ("|\\\\\\\\" if mode.endswith("backslash") else "")), quoted).otherwise(c)


def lines(df: DataFrame, o: Output = Output()) -> DataFrame:
    """One column `value`: each row as a line, without its end; numbers in their shortest form."""
    shown = {c: plain(C.col(c).cast("double")) if t in ("double", "float") else C.col(c) for c, t in df.dtypes}
    return df.select(F.concat_ws(o.delimiter, *[escaped(shown[c], o) for c in C.data_columns(df)]).alias("value"), *[c for c in df.columns if c.startswith("_")])


def header_line(df: DataFrame, o: Output) -> str | None:
    names = C.data_columns(df)
    if o.header == "none":
        return None
    return (MARK + o.delimiter if o.header == "marked" else "") + o.delimiter.join(names)


def write(df: DataFrame, path: str, o: Output = Output()) -> None:
    """A folder of text parts, each with the header if there is one; rows in the order of the table."""
    head = header_line(df, o)
    body = lines(df, o).select("value")
    if head is not None:

        def put(batches):
            first = True
            for pdf in batches:
                if first and len(pdf):
                    yield pd.DataFrame({"value": [head]})
                    first = False
                yield pdf

        body = body.mapInPandas(put, "value string")
    body.write.mode("overwrite").option("lineSep", o.eol).text(path)


def to_text(df: DataFrame, o: Output = Output()) -> str:
    """A small table as one text, for tests and terminals."""
    rows = [r["value"] for r in lines(df, o).collect()]
    head = header_line(df, o)
    return "".join(x + o.eol for x in ([head] if head is not None else []) + rows)
