"""Session access to shared storage, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local applications without the setting; it cannot always be set in a running session.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A local session without that setting (tests, notebooks) gets a temporary folder of this machine, one for each
    application; on a cluster, where executors could not read it, the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="strandframe-")
        path = _OWN[app]
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: later jobs read files that every executor can reach, so a lost
    executor costs a task, not the whole history of an iteration.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandframe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame made by :func:`materialize`; nothing may read it later."""
    path = getattr(df, "_strandframe_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage, upon which Spark deletes the shuffle files of finished queries everywhere."""
    gc.collect()
    spark._jvm.System.gc()
