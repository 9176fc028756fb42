"""Tables and models on shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, na: str = "NA", trim: bool = True) -> DataFrame:
    """Delimited text with a heading row under a stated schema.

    With ``trim`` blanks around a value go; ``na`` is the marker read as null.
    """
    return (
        spark.read.option("header", True)
        .option("nullValue", na)
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
        .schema(schema)
        .csv(path)
    )


def read_sheet(
    spark: SparkSession,
    book: str,
    sheet: str | int,
    schema: T.StructType | str | None = None,
    na: str = "NA",
    trim: bool = True,
) -> DataFrame:
    """One sheet of a workbook that landed as a folder: ``<book>/<sheet>`` as Parquet or CSV.

    CSV sheets need a schema; Parquet sheets carry their own.
    """
    path = f"{book.rstrip('/')}/{sheet}"
    return spark.read.parquet(path) if schema is None else read_csv(spark, path, schema, na, trim)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write, then hand back the written table, so later steps read it instead of recomputing it."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
        return read_csv(df.sparkSession, path, df.schema)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where none is set a local session (as in tests) gets a folder of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and keep on shared storage, so that later passes neither repeat the work nor
    depend on the executors that did it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """An aggregation result, written to shared storage and read back.

    The data behind it is scanned once however often the result is used, and Spark knows its size in bytes: joined to
    the data it is broadcast when that is under the session's limit, and shuffled when it is not.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(*frames: DataFrame) -> None:
    """Delete the files of settled frames, and let go of shuffles that nothing needs any more: neither is read again."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[1].startswith("settled-"):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        context._jvm.System.gc()  # Spark deletes a shuffle when the driver's memory of it is collected


def save_model(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return model


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
