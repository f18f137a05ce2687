"""Session helpers: table access, checkpoint folder, even work on small inputs."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data folder; the session is pinned to UTC first so that instants read alike everywhere.

    Generated methods above 8,000 bytes are never compiled by the JVM, so stages with such methods are better run operator by operator.
    """
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") != "8000":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``. Where that is unset, local mode gets one of its own, deleted at its end; a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="signalpanel-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def even(df: DataFrame) -> DataFrame:
    """``df`` in tasks of equal numbers of rows where one file is all there is: a lone small file would leave all cores but one idle.

    Decided by the files of the scan alone, without a job; two files or more stay as they lie.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df

