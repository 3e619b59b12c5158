"""From ranked hits to ranked files, and line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.text import range_text

# Hits of a file that count under `capped`, and the weight of those after the first.
MAX_HITS, EXTRA = 2, 0.25


def fused(hits: DataFrame, how: str, file: str = "doc_id", top_k: int = 0) -> DataFrame:
    """(query_id, rank, file, score) for hits (query_id, rank, file): sum of 1 / log2(rank + 1), or capped, or first."""
    nth = F.row_number().over(Window.partitionBy("query_id", file).orderBy("rank"))
    hits = hits.withColumn("nth", nth)
    if how == "first":
        hits = hits.where("nth = 1")
    elif how == "capped":
        hits = hits.where(F.col("nth") <= MAX_HITS)
    elif how != "sum":
        raise ValueError(how)
    weight = F.when(F.col("nth") > 1, EXTRA).otherwise(1.0) if how == "capped" else F.lit(1.0)
    per = hits.groupBy("query_id", file).agg(F.round(F.sum(weight / F.log2(F.col("rank") + 1)), 6).alias("score"), F.min("rank").alias("first"))
    out = per.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", file)).cast("bigint"))
    return (out.where(F.col("rank") <= top_k) if top_k else out).select("query_id", "rank", file, "score")


def merged_ranges(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, start_line, end_line): ranges that overlap or touch (a gap of at most 1) become one; empty or zero bounds are dropped."""
    w = Window.partitionBy(*by).orderBy("start_line", "end_line")
    ok = hits.where((F.col("start_line") > 0) & (F.col("end_line") > 0) & (F.col("end_line") >= F.col("start_line"))).select(*by, "start_line", "end_line").distinct()
    ok = ok.withColumn("reach", F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ok = ok.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("start_line") > F.col("reach") + 1), 1).otherwise(0)).over(w))
    return ok.groupBy(*by, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def ranges_as_text(ranges: DataFrame, by: list[str]) -> DataFrame:
    folded = ranges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end")))).alias("r"))
    return folded.select(*by, range_text(F.col("r")).alias("ranges"))


def located(hits: DataFrame, chunks: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """hits with the location of their chunk; hits of unknown chunks are dropped. chunks: chunk and its location, one row a chunk."""
    return hits.join(chunks, chunk).drop(chunk)


def reciprocal(rank: Column) -> Column:
    return 1 / (rank + 1)


def suffix_match(path: Column, target: Column) -> Column:
    """Whether a ranked path is the target, or ends with it behind a slash, or the reverse."""
    tail = lambda a, b: F.endswith(a, F.concat(F.lit("/"), b))
    return (path == target) | tail(path, target) | tail(target, path)


def first_match_ranks(ranking: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target, rank) of the first ranked file that matches. Joined on the last part of the path, then compared whole."""
    leaf = lambda c: F.substring_index(c, "/", -1)
    a = ranking.withColumn("_leaf", leaf(F.col("path")))
    b = targets.withColumn("_leaf", leaf(F.col("target")))
    return a.join(b, ["query_id", "_leaf"]).where(suffix_match(F.col("path"), F.col("target"))).groupBy("query_id", "target").agg(F.min("rank").alias("rank"))
