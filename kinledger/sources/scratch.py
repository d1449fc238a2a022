"""Written tables that cut a plan's lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def path(spark: SparkSession, label: str) -> str:
    """New path in ``spark.checkpoint.dir``, deleted when the driver ends.

    Only a local-mode session without that setting gets a folder of its own; a cluster
    without it is refused, since its executors share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="kinledger-")
            atexit.register(shutil.rmtree, _OWN[app], True)
        folder = "file://" + _OWN[app]
    made = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return made


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    spark = df.sparkSession
    at = path(spark, label)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def sql_over(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with bound parameters over the given frames by name; the session's views of these names stay what they are."""
    held = {}
    for name, df in frames.items():
        old = spark.table(name) if spark.catalog.tableExists(name) else None
        held[name] = old if spark.catalog.dropTempView(name) else None
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args)
    finally:
        for name, old in held.items():
            spark.catalog.dropTempView(name)
            if old is not None:
                old.createOrReplaceTempView(name)
