"""Table access and shared-folder materialisation for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from memlattice.shipping import shared_folder, ship


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 2_000  # rows that go to Python at a time, unless the session says otherwise: texts are long, and Spark's 10,000 take 100 MB and more


def prepare(spark: SparkSession) -> None:
    """Before Python workers read texts: the package is shipped, and batches are of BATCH rows where the session has Spark's default."""
    ship(spark)
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in tables:
        path = df.__dict__.get("written_to") if df is not None else None
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
