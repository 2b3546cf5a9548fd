"""Storage helpers: where intermediate tables are written and how they are read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from panelwright.session import ship


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a fresh local one only where that is unset (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage but files that every executor sees, so a lost executor costs a re-read
    and never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column is called so (upper and lower case are alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Spark's own limit of an Arrow batch, and the one used where a session has left it at that.
_BATCH, BATCH = "67108864b", "4MB"


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts in a few MB: they lie in memory on both sides of the pipe to Python, once per running task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == _BATCH:
        spark.conf.set(name, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
