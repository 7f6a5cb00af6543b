"""Reading tables, and writing intermediate ones where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set: a temporary one if all runs on this machine, else one in the warehouse, which is shared too."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="strandflow-")
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{sc.applicationId}"
        sc.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors cost no recomputation; removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
