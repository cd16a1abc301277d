"""Where a job keeps what it writes between its steps."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files of a table for each core of the cluster, at most: a small table that comes in thousands of
#: partitions would otherwise cost more in opening files than in rows.
FILES_EACH = 8

#: Bytes of an Arrow batch at most, in a session that allows more: a batch of whole texts is held by
#: the JVM and by a Python worker, in and out, for each core.
BATCH_BYTES = 4 << 20

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of this application, under spark.checkpoint.dir.

    Where that setting is absent (tests, a single machine) a local folder is made and also
    set as the checkpoint folder.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
            sc.setCheckpointDir(base)
        _own[sc.applicationId] = f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _own[sc.applicationId])
    return _own[sc.applicationId]


def small_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(conf.get(key).rstrip("b"))
    if not 0 < held <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def path(spark: SparkSession, name: str) -> str:
    """A fresh path under folder()."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    out = path(spark, name)
    df.coalesce(FILES_EACH * spark.sparkContext.defaultParallelism).write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def free(*tables: DataFrame) -> None:
    """Deletes what written() gave, once nothing reads it any more."""
    for df in tables:
        for at in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if folder(df.sparkSession).partition("://")[2] in at:
                remove(df.sparkSession, at)


def remove(spark: SparkSession, out: str) -> None:
    """Deletes a folder, if the session still runs."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(out)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the JVM may be gone at exit
        pass
