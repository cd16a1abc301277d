"""Tables that a run writes between its steps, in the folder that all executors share."""

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, deleted at exit. Only a local master may
    go without that setting: it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.applicationId not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        _own[sc.applicationId] = f"{base.rstrip('/')}/tallyforge-run-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _own[sc.applicationId])
    return _own[sc.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: what several steps read is computed once, its plan ends here, and no
    memory holds it. A lost executor costs the tasks it ran."""
    spark = df.sparkSession
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """written(), with aggregates that the write itself works out: no second pass over the rows."""
    seen = Observation()
    out = written(df.observe(seen, *(c.alias(k) for k, c in counts.items())), name)
    return out, seen.get


def free(*tables: DataFrame) -> None:
    """Deletes what written() gave, once nothing reads it any more."""
    for df in tables:
        for at in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if folder(df.sparkSession).partition("://")[2] in at:
                remove(df.sparkSession, at)


def remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone at exit
        pass
