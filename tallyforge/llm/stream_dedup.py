"""Exact dedup as a stateful stream: a keyed state on disk remembers every text that ever arrived.

A streaming aggregate holds, for each digest of a normalised text, the row that stays (its id is the
stable identifier, its file and row number there locate the content) and how many rows came. The state
lives in RocksDB on the executors, is checkpointed to the shared folder and never expires, so a later
run with the same state folder reads new files only. decide() then reads the state as a table and
holds every further row of a digest against the whole bytes of the row that stays. All of it is
DataFrame operations.
"""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _scratch

#: Bytes of files that one micro-batch takes: a batch costs a commit of each state partition.
BATCH_BYTES = 256 << 30
#: Rows of one text that one key of the comparison gets: the kept text is sent once for so many.
EACH = 128
#: Digests with several rows are broadcast up to this number (some 40 MB), else joined by a shuffle.
BROADCAST_DIGESTS = 250_000

#: Settings of the stream alone; the caller's session has its own again afterwards.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition of the state reserves some MB of disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: str | Column) -> Column:
    """A text with each run of blanks as one space; null is empty. Lone spaces aren't matched, as they stay."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def arrivals(docs: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """digest, text (normalised) and row of docs, read from files; rows order by id (null ids last), then by place."""
    text = normalised(F.col(text_col))
    row = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.select(digest(text).alias("digest"), text.alias("text"), row.alias("row"))


def observe(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text", **limits: str | int) -> None:
    """Streams the Parquet files of path that state hasn't seen into it; returns when all are in.

    state: a folder that all executors share; a run that died is continued by calling this again.
    limits: options of the file source (maxFilesPerTrigger, maxBytesPerTrigger)."""
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    with settings(spark, STATE):
        # A pattern that fits the path alone: the source takes a folder or a single file then.
        stream = spark.readStream.schema(schema).options(**(limits or {"maxBytesPerTrigger": BATCH_BYTES})).parquet(f"{path[:-1]}[{path[-1]}]")
        held = arrivals(stream, digest, id_col, text_col).groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
        query = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def remembered(spark: SparkSession, state: str) -> DataFrame:
    """digest, first (unnamed, id, file, at), rows: all that the state holds."""
    with settings(spark, STATE):
        return spark.read.format("statestore").load(state).select("key.digest", F.col("value.min").alias("first"), F.col("value.count").alias("rows"))


def decide(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, keep_id, group_size, kept, digest of every row of path, whose files state has seen.

    Texts are equal when they are once runs of blanks became one space; null counts as empty and empty
    texts equal each other. Of equal texts the row with the smallest id stays, of rows that share that
    id the first by file and place; a null id is larger than all others. Digests only find candidates:
    a row whose bytes differ from those of the row that stays is grouped by its whole text instead.
    Repeated rows each give a row, other columns are ignored, an empty table gives an empty result,
    texts of any length are compared whole."""
    docs = arrivals(spark.read.parquet(path), digest, id_col, text_col)
    several = _scratch.written(remembered(spark, state).where("rows > 1"), "dedup-several")
    found = F.broadcast(several) if several.count() <= BROADCAST_DIGESTS else several
    marked = _scratch.written(docs.join(found, "digest", "left").withColumn("text", F.when(F.col("rows").isNotNull(), F.col("text"))), "dedup-rows")
    same = (F.col("row.file") == F.col("first.file")) & (F.col("row.at") == F.col("first.at"))
    shared = marked.where("rows is not null")
    salts = F.ceil(F.col("rows") / EACH).cast("int")
    originals = shared.where(same).select("digest", F.col("text").alias("original"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hits = shared.where(~same).select("digest", "row", "text", F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt"))
    strangers = _scratch.written(hits.join(originals, ["digest", "salt"]).where("text <> original").select("digest", "row", "text"), "dedup-strangers")
    own = strangers.groupBy("digest", "text").agg(F.min("row").alias("own_first"), F.count("*").alias("own_rows"))
    settled = strangers.join(own, ["digest", "text"]).select(F.col("row.file").alias("file"), F.col("row.at").alias("at"), "own_first", "own_rows")
    left = strangers.groupBy("digest").agg(F.count("*").alias("gone"))
    judged = marked.drop("text").withColumns({"file": F.col("row.file"), "at": F.col("row.at")}).join(settled, ["file", "at"], "left").join(left, "digest", "left")
    first = F.coalesce("own_first", "first", "row")
    size = F.coalesce("own_rows", F.col("rows") - F.coalesce("gone", F.lit(0)), F.lit(1))
    return judged.select(
        F.col("row.id").alias(id_col), first["id"].alias("keep_id"), size.cast("long").alias("group_size"),
        ((F.col("file") == first["file"]) & (F.col("at") == first["at"])).alias("kept"), "digest",
    )


def deduplicate(spark: SparkSession, path: str, state: str | None = None, **columns: str) -> DataFrame:
    """observe(), then decide(); without a state folder a fresh one of this application is taken."""
    state = state or _scratch.path(spark, "dedup-state")
    observe(spark, path, state, **columns)
    return decide(spark, path, state, **columns)
