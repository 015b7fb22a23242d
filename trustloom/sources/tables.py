"""Tables written between the steps of a job, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; a fresh local one where that is unset on one machine (tests)."""
    named, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/cuts-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends, lost executors cost nothing.

    Results read these tables lazily, so they are kept until drop_cuts, or until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete this application's cut tables, once nothing that reads them will run again."""
    jvm, path = spark.sparkContext._jvm, shared_dir(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
