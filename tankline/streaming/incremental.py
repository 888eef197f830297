"""Incremental ingestion of priced transactions with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tankline.operators.flags import apply_flags


def incremental_flags(spark: SparkSession, source_dir: str, schema: StructType, table_path: str, flagged_path: str,
                      checkpoint: str, available_now: bool = True, **flag_params) -> DataFrame:
    """Stream parquet files of priced transactions from ``source_dir``. ``foreachBatch`` is
    at-least-once, so a batch may be repeated: each is written to a folder named by its
    epoch under ``table_path``, overwriting what an earlier try left, and the flags of the
    whole table go to a new folder under ``flagged_path`` per epoch. A reader takes the
    newest finished one, so it never sees a table that is being written. Returns the
    flagged table."""

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        write_epoch(batch, epoch_id, table_path)
        whole = spark.read.option("basePath", table_path).parquet(f"{table_path}/epoch=*").drop("epoch")
        apply_flags(whole, **flag_params).write.mode("overwrite").parquet(f"{flagged_path}/version={epoch_id}")

    w = (spark.readStream.schema(schema).parquet(source_dir).writeStream
         .foreachBatch(on_batch).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return latest(spark, flagged_path)


def write_epoch(batch: DataFrame, epoch_id: int, table_path: str) -> None:
    """One micro-batch; writing it again changes nothing."""
    batch.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch_id}")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version under ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(p)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/version={max(done)}")
