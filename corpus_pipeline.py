"""The corpus pipeline: documents in, encoded documents out, in five stages.

Every stage takes null ids and texts, empty and very long texts, repeated rows, empty tables and
further columns of any name (but for those that begin with _tf_); each says what becomes of them.
Ids are whole numbers.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import _scratch, bpe_codec, decontaminate, ngram_join, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay as they are. Null texts score as empty ones; repeated rows
    stay or go together; without a toxic label all stay."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: of those with the smallest id (null ids count as
    larger) one text, and of rows that repeat its id and text that with the least hash. Rows
    without words (null texts too) link with nothing and all stay."""
    key, row = F.xxhash64("doc_id", "text"), F.struct(*docs.columns)
    classes = ngram_join.classes(docs.select(key.alias("key"), "text"), id_col="key").where("n_shingles > 0")
    keys = _scratch.written(classes.groupBy("key").agg(F.first("component_id").alias("class"), F.count("*").alias("rows")), "classes")
    ids = docs.select(key.alias("key"), "doc_id").distinct().join(keys, "key")
    best = ids.groupBy("class").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key")).select("key", F.lit(True).alias("best"))
    judged = _scratch.written(keys.join(best, "key", "left"), "kept-keys")
    keyed = docs.select(key.alias("_key"), row.alias("_row"))
    single = keyed.join(judged.where("best is null or rows > 1").select(F.col("key").alias("_key")), "_key", "left_anti")
    repeated = keyed.join(judged.where("best and rows > 1").select(F.col("key").alias("_key")), "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return single.select("_row.*").union(repeated.select("_row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that a smaller id has too; n_chars, if there is one, counts
    what stays. A null id counts as larger than all others; null texts stay null; rows that share an
    id, repeated ones too, are not compared with each other; every row stays."""
    out = substring_dedup.rewrite(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay as they are. Null texts have none; repeated rows stay
    or go together."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; null texts encode as empty ones."""
    return bpe_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Toxicity scores aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the table documents: each stage but the last is written and
    reread, so a lost executor costs no more than its part of one stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = _scratch.written(docs, name.replace(" ", "-"))
    return docs
