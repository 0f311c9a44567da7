"""Cut a long lineage by writing an intermediate table to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Private folders of one-machine sessions, by application.
_PRIVATE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine may do without it and gets a private folder for the life of the session; on a cluster a private folder would
    be another one on every executor, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="gradeloom-")
    return _PRIVATE[app]


def stage(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once and read it back, so that later branches do not recompute it.

    ``rows_per_file``: rows of a file at most, for rows so large that those of one task cannot be read together; 0 is no bound.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
