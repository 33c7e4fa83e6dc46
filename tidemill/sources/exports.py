"""Export texts: XML, JSON, CSV, TSV, SSV and the fetch listing, one row for each line.

Lines carry their place, so writing them sorted by place gives part files that make up the document
in order; values are formatted inside the JVM and nothing is collected.
"""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Format -> (separator) of the separated kinds.
SEPARATORS = {"CSV": ",", "TSV": "\t", "SSV": ";"}


def value_text(c: Column, unknown: str = "NaN") -> Column:
    x = F.when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(F.format_string("%.10e", c))
    return F.when(c.isNull() | F.isnan(c), unknown).otherwise(x)


def _document(rows: DataFrame, line: Column, head: list[str], tail: list[str]) -> DataFrame:
    """part, place, line; part 0 is the head, 1 the rows, 2 the tail."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(p, i, x) for p, lines in ((0, head), (2, tail)) for i, x in enumerate(lines)], "part int, place long, line string")
    return fixed.unionByName(rows.select(F.lit(1).alias("part"), F.col("ts").alias("place"), line.alias("line")))


def separated(table: DataFrame, separator: str = ",") -> DataFrame:
    """ts and value columns to quoted lines; lines end with CR LF when written by write()."""
    names = [c for c in table.columns if c != "ts"]
    cells = [F.concat(F.lit('"'), value_text(F.col(f"`{n}`")), F.lit('"')) for n in names]
    head = separator.join(['"time"', *(f'"{n.lstrip()}"' for n in names)])
    return _document(table, F.concat_ws(separator, F.col("ts").cast("string"), *cells), [head], [])


def xml(table: DataFrame, start: int, end: int, step: int, show_time: bool = False, numbered: bool = False) -> DataFrame:
    names = [c for c in table.columns if c != "ts"]
    meta = [("start", start + step), ("end", end), ("step", step), ("rows", (end - start) // step), ("columns", len(names))]
    head = ['<?xml version="1.0" encoding="ISO-8859-1"?>', "", "<xport>", "  <meta>", *(f"    <{k}>{v}</{k}>" for k, v in meta)]
    head += ["    <legend>", *(f"      <entry>{escape(n.lstrip())}</entry>" for n in names), "    </legend>", "  </meta>", "  <data>"]
    tags = [f"v{i}" if numbered else "v" for i in range(len(names))]
    cells = [F.concat(F.lit(f"<{t}>"), value_text(F.col(f"`{n}`")), F.lit(f"</{t}>")) for t, n in zip(tags, names)]
    at = [F.concat(F.lit("<t>"), F.col("ts").cast("string"), F.lit("</t>"))] if show_time else []
    return _document(table, F.concat(F.lit("    <row>"), *at, *cells, F.lit("</row>")), head, ["  </data>", "</xport>"])


def as_json(table: DataFrame, start: int, end: int, step: int, show_time: bool = False) -> DataFrame:
    names = [c for c in table.columns if c != "ts"]
    head = ['{ "about": "RRDtool graph JSON output",', '  "meta": {', *(f'    "{k}": {v},' for k, v in (("start", start + step), ("end", end), ("step", step)))]
    head += ['    "legend": [', *(f"      {json.dumps(n.lstrip())}{',' if i + 1 < len(names) else ''}" for i, n in enumerate(names)), "          ]", "     },", '  "data": [']
    finite = lambda c: F.when(F.abs(c) < float("inf"), value_text(c)).otherwise("null")
    cells = F.concat_ws(", ", *(F.coalesce(finite(F.col(f"`{n}`")), F.lit("null")) for n in names))
    at = [F.concat(F.lit('"'), F.col("ts").cast("string"), F.lit('",'))] if show_time else []
    close = F.when(F.col("ts") < end, " ],").otherwise(" ]")
    return _document(table, F.concat(F.lit("    [ "), *at, cells, close), head, ["  ]", "}"])


def export(table: DataFrame, kind: str, start: int, end: int, step: int) -> DataFrame:
    """kind: XML, XMLENUM, JSON, JSONTIME, CSV, TSV or SSV."""
    if kind in SEPARATORS:
        return separated(table, SEPARATORS[kind])
    if kind in ("XML", "XMLENUM"):
        return xml(table, start, end, step, show_time=True, numbered=kind == "XMLENUM")
    if kind in ("JSON", "JSONTIME"):
        return as_json(table, start, end, step, show_time=kind == "JSONTIME")
    raise ValueError(f"unknown export format {kind!r}")


def listing(table: DataFrame) -> DataFrame:
    """The lines of a fetch: names in columns of 20, a blank line, a line for each row."""
    names = [c for c in table.columns if c != "ts"]
    cells = [value_text(F.col(f"`{n}`"), "nan") for n in names]
    line = F.concat(F.lpad(F.col("ts").cast("string"), 10, " "), F.lit(": "), F.concat_ws(" ", *cells))
    return _document(table, line, [" " * 11 + "".join(n.rjust(20) for n in names), ""], [])


def write(lines: DataFrame, path: str, separated: bool = False) -> None:
    """Part files that concatenate, in order of their names, to the document."""
    lines.orderBy("part", "place").select("line").write.option("lineSep", "\r\n" if separated else "\n").text(path)
