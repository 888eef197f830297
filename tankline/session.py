"""Spark session and cluster-level settings shared by every job.

The library never creates its own session inside an operator; callers pass
one in. ``get_spark`` is a convenience for scripts, tests and the bench.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tankline", extra: dict | None = None) -> SparkSession:
    """A session for scripts. Master, memory and the number of shuffle partitions are the
    submitter's business: they are only set when the caller (tests, bench) gives them."""
    builder = SparkSession.builder.appName(app_name)
    conf = dict(BASE_CONF)
    if master:
        builder = builder.master(master)
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Without one, a session that runs in a
    single process (``local[...]``: tests, bench) gets a scratch folder; a cluster gets an
    error, as its executors can't share a folder of one machine."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="tankline-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


SPREAD_ROWS = 2000      # rows that are worth a task in a table that is walked many times
TASK_ROWS = 100_000     # rows from which a task of such a table is split


def spread(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """A checkpointed table that many passes walk, dealt to a task per core (by the columns ``by``), or to
    one per ``TASK_ROWS`` rows if those are more. Adaptive execution sizes partitions by bytes: a few MB
    come to one, and every pass to one core; without it they stay the shuffle's 200, and every pass
    costs 200 tasks of a few rows. A table of blocks tells the number of its ``rows``."""
    cores, have, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions(), df.count() if rows is None else rows
    tasks = max(1, min(cores, n // SPREAD_ROWS))
    if n > tasks * TASK_ROWS:
        tasks = -(-n // (TASK_ROWS * cores)) * cores
    return df if tasks <= have <= 2 * tasks else df.repartition(tasks, *by).checkpoint(eager=True)
