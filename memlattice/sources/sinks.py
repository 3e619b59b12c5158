"""Sinks of results: CSV of usage, resumable runs, fingerprints of what an index was built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def remaining_work(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to do."""
    return wanted.join(done.select(key), key, "left_anti")


def run_summary(results: DataFrame) -> DataFrame:
    """Means over repositories, rounded as reports show them. results: repo, ndcg10, p50_ms, index_ms."""
    return results.agg(F.round(F.avg("ndcg10"), 4).alias("avg_ndcg10"), F.round(F.avg("p50_ms"), 1).alias("avg_p50_ms"), F.round(F.avg("index_ms"), 0).alias("avg_index_ms"))


def fetch_count(n: Column, without_id: Column, k: Column) -> Column:
    """How many hits to ask for, so that k remain when those without an id are dropped."""
    return F.least(n, without_id + k)


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint): of the paths, times and sizes of all files, whatever their order. files: path, modificationTime, length."""
    one = F.xxhash64("path", F.col("modificationTime").cast("string"), "length")
    return files.agg(F.sha1(F.concat_ws(":", F.bit_xor(one).cast("string"), F.sum(one.cast("decimal(38,0)")).cast("string"), F.count("*").cast("string"))).alias("s")).select(F.concat(F.lit("tree-"), F.substring("s", 1, 12)).alias("fingerprint"))


def must_rebuild(manifest: DataFrame, fingerprint: str, structure: str) -> bool:
    """Whether no stored index has this fingerprint; an error if one has it with another context structure."""
    found = manifest.where(F.col("fingerprint") == fingerprint).select("structure").first()
    if found and found["structure"] != structure:
        raise ValueError(f"the index was built for the structure {found['structure']}; build it anew")
    return found is None


def ordered_ints(x: Column) -> Column:
    """The distinct integers of a comma-separated list, in order."""
    return F.array_distinct(F.transform(F.split(x, ","), lambda v: F.trim(v).cast("int")))


def stored_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of an earlier run; none if there are none or they can't be read."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
