"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a local session gets one of its own; a cluster can't."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not folder:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, label: str, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back; ``level`` is zstd's, above 3 in pages of 8 MB.

    It cuts the lineage: a lost executor costs only the tasks that were running.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    to = df.write.option("compression", "zstd")
    if level > 3:
        to = to.option("parquet.compression.codec.zstd.level", str(level)).option("parquet.page.size", str(8 << 20))
    to.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_with(df: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``saved``, and aggregates (named columns) of its rows that are taken while it is written."""
    seen = Observation()
    table = saved(df.observe(seen, *measures), label)
    return table, seen.get
