"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.session import checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: lineage
    ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the folder that ``df`` of ``kept`` reads; for tables that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remainder(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids: that of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % n


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


#: Rows of an Arrow batch between Spark and Python; with very long texts 10,000 rows
#: are hundreds of megabytes in an executor, once in the JVM and once in the worker.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_ROWS`` rows."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, never reach the
    operator; in small Arrow batches."""
    small_batches(df)
    return df.select(*[F.col(f"`{c}`") for c in columns])
