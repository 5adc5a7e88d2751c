"""Writers for result tables and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clipped, six
from ..operators.integrate import upsert
from ..operators.scan import numbered


def csv(df: DataFrame, path: str, columns: list[str] | None = None, six_decimals: list[str] | None = None, one_file: bool = True) -> None:
    """CSV with a header, columns in the order given. Result tables are small, so they may be one file."""
    out = df.withColumns({c: six(F.col(c)) for c in six_decimals or []}).select(*(columns or df.columns))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Rows added as new files: writers at the same time don't meet."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def failure(df: DataFrame) -> DataFrame:
    """Rows of failed runs: no figures, and a status."""
    return df.withColumns({"runtime_seconds": F.lit(None).cast("double"), "max_memory_kb": F.lit(None).cast("bigint"), "status": F.lit("FAILED")})


def replace(df: DataFrame, path: str, to: str, keys: list[str]) -> None:
    """The table at ``path`` with ``df`` in place of the rows of its keys, written to ``to``."""
    upsert(df.sparkSession.read.parquet(path), df, keys).write.mode("overwrite").parquet(to)


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON with its NULLs; what is not a number is one."""
    return _numbers(df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def _numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def json(df: DataFrame, path: str) -> None:
    _numbers(df).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """place (from 1) and line of a Markdown table of all rows by ``order``: a head, a rule, and a line a row. NULL is ``N/A``, bars
    are escaped. Rows are numbered by ranges, so a table may be of any length."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("N/A")), r"\|", r"\\|")
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = numbered(df.select(*order, line([cell(c) for c in df.columns]).alias("line")), [F.col(c) for c in order] + [F.col("line")]).select((F.col("place") + 2).alias("place"), "line")
    shown = lambda xs: "| " + " | ".join(x.replace("|", r"\|") for x in xs) + " |"
    head = df.sparkSession.createDataFrame([(1, shown(df.columns)), (2, shown(["---"] * len(df.columns)))], "place long, line string")
    return head.unionByName(rows)


def markdown(df: DataFrame, order: list[str] | None = None) -> str:
    """A small table as one text, with all its rows, in the order of its columns unless told otherwise; the driver holds it.
    For longer ones there is :func:`report`."""
    return "\n".join(r.line for r in markdown_lines(df, order or df.columns).orderBy("place").collect())


def report(tables: list[tuple[str, DataFrame, list[str]]], path: str) -> None:
    """A report of several tables, each a title, a table and what orders its rows, as text files whose names and lines are in
    order. Written by as many tasks as there are shuffle partitions; no rows are left out."""
    parts = []
    for k, (title, df, order) in enumerate(tables, 1):
        head = df.sparkSession.createDataFrame([(k, -1, f"## {title}"), (k, 0, "")], "section int, place long, line string")
        parts += [head, markdown_lines(df, order).select(F.lit(k).alias("section"), "place", "line")]
    whole = reduce(DataFrame.unionByName, parts)
    whole.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(path)


def between(df: DataFrame, column: str, start: str, end: str, by: str) -> DataFrame:
    """Text between two markers replaced, the markers kept."""
    quoted = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    keep = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return df.withColumn(column, F.regexp_replace(column, f"(?s){quoted(start)}.*?{quoted(end)}", keep(start + by + end)))


def fasta(lines: DataFrame, prefix: str, path: str) -> None:
    """Lines of FASTA with a prefix before each record's name, compressed."""
    lines.select(F.when(F.col("value").startswith(">"), F.concat(F.lit(f">{prefix}"), F.expr("substring(value, 2)"))).otherwise(F.col("value"))).write.mode("overwrite").option("compression", "gzip").text(path)


def plot_data(df: DataFrame, label: str, value: str, by: list[str] | None = None, share: bool = False) -> DataFrame:
    """What a bar chart with error bars draws: mean, low and high (a standard deviation away, 0 for one row) of each label;
    a ``share`` stays in 0 to 1. Drawing is left to plotting tools."""
    keep = clipped if share else lambda x: x
    out = df.groupBy(*(by or []), label).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    return out.select(*(by or []), label, "mean", keep(F.col("mean") - F.col("sd")).alias("low"), keep(F.col("mean") + F.col("sd")).alias("high"))
