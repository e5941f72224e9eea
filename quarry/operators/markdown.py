"""Tables in markdown texts, by line positions and windows of one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import parse_number
from quarry.operators.quality import canonical_metric


def line_blocks(df: DataFrame, key: str, text: str, starts: Column | None = None) -> DataFrame:
    """Runs of neighbouring lines that begin with a pipe: key, block (from 1), line_no, line. starts tests the column line."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    ok = lines.where(starts if starts is not None else F.startswith(F.trim("line"), F.lit("|")))
    w = Window.partitionBy(key).orderBy("line_no")
    island = ok.withColumn("_g", F.col("line_no") - F.row_number().over(w))
    return island.withColumn("block", F.dense_rank().over(Window.partitionBy(key).orderBy("_g"))).drop("_g")


def markdown_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of tables: key, block, row (from 0, the header), cells. Separator rows go; tables need two rows besides."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), _clean)
    rows = line_blocks(df, key, text).select(key, "block", "line_no", "line", cells.alias("cells"))
    w = Window.partitionBy(key, "block")
    first = F.first("line").over(w.orderBy("line_no"))
    pipes = F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit("")))
    body = rows.withColumn("_pipes", pipes).where(~F.forall("cells", lambda c: c.rlike(r"^:?-{3,}:?$")))
    counted = body.select(key, "block", (F.row_number().over(w.orderBy("line_no")) - 1).alias("row"), F.count("*").over(w).alias("_rows"), "_pipes", "cells")
    return counted.where("_rows >= 2 AND _pipes >= 2").drop("_rows", "_pipes")


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\*\*([^*]*)\*\*", "$1"))


def benchmark_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each model column of each table: key, block, columns of the table, header, map of canonical metric to value; the last row of a metric wins."""
    t = markdown_tables(df, key, text)
    header = t.where("row = 0").select(key, "block", F.size("cells").alias("columns"), F.posexplode("cells").alias("col", "header")).where("col > 0")
    body = t.where("row > 0").select(key, "block", "row", canonical_metric(F.get("cells", F.lit(0))).alias("metric"), F.posexplode("cells").alias("col", "cell"))
    values = body.where("metric IS NOT NULL AND col > 0").withColumn("value", parse_number(F.col("cell"))).where("value IS NOT NULL")
    last = values.groupBy(key, "block", "col", "metric").agg(F.max_by("value", "row").alias("value"))
    maps = last.groupBy(key, "block", "col").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("benchmarks"))
    return maps.join(header, [key, "block", "col"]).select(key, "block", "columns", "header", "benchmarks")
