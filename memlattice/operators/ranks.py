"""Ranks over groups that are too large for one task: values are dealt over cells, which are ordered apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1_024


def in_cells(rows: DataFrame, by: list[str], order: str, cells: int = CELLS) -> DataFrame:
    """rows with _cell: which of `cells` equal parts of its group's range a number lies in. A larger number is in no smaller cell."""
    lo, hi = F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi")
    edges = rows.groupBy(*by).agg(lo, hi) if by else None
    if edges is None:
        ends = rows.agg(lo, hi).first()
        rows = rows.withColumn("_lo", F.lit(ends["_lo"]).cast("double")).withColumn("_hi", F.lit(ends["_hi"]).cast("double"))
    else:
        rows = rows.join(edges, by)
    share = (F.col(order).cast("double") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return rows.withColumn("_cell", F.coalesce(F.floor(share * cells), F.lit(0)).cast("long")).drop("_lo", "_hi")


def counted_before(rows: DataFrame, by: list[str], part: str) -> DataFrame:
    """(by, part, _before, _n): rows in the parts before, and in the part, of each group. A row for each part, not for each row."""
    n = rows.groupBy(*by, part).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def ranked_in_cells(rows: DataFrame, by: list[str], order: str, ties: list[str], out: str = "rank") -> DataFrame:
    """rows with their place, from 1, within each group by a numeric column and then by ties; no task orders more than a cell."""
    placed = in_cells(rows, by, order)
    key = [*by, "_cell"]
    before = counted_before(placed, by, "_cell").drop("_n")
    local = F.row_number().over(Window.partitionBy(*key).orderBy(order, *ties))
    return placed.withColumn("_local", local).join(before, key).withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint")).drop("_cell", "_local", "_before")
