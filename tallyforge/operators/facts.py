"""Derived amounts with their source, contracts on columns, and replacement by file."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROVENANCE = ["source_file", "source_sheet", "source_row", "ingested_at", "row_hash"]


def derived(rule: str, inputs: list[str]) -> Column:
    """The value that a rule gives where all inputs are there; amounts to two decimals."""
    first, *rest = (F.col(c) for c in inputs)
    value = first
    for c in rest:
        value = value + c if rule == "sum" else value - c
    ready = F.lit(True)
    for c in inputs:
        ready = ready & F.col(c).isNotNull()
    return F.when(ready, F.rint(value.cast("double") * 100) / 100)


def fill(frame: DataFrame, field: str, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """field with its nulls filled by the first rule that can, and <field>_source: reported, derived or null."""
    usable = [derived(rule, inputs) for rule, inputs in rules if set(inputs) <= set(frame.columns)]
    kind = frame.schema[field].dataType
    value = F.coalesce(F.col(field), *(u.cast(kind) for u in usable))
    source = F.when(F.col(field).isNotNull(), "reported").when(value.isNotNull(), "derived")
    return frame.withColumns({field: value, f"{field}_source": source})


class ContractError(ValueError):
    """A table's columns aren't those it was first written with."""


def contract_difference(columns: list[str], expected: list[str]) -> dict[str, list[str]]:
    return {"missing": [c for c in expected if c not in columns], "extra": [c for c in columns if c not in expected], "order": [] if sorted(columns) != sorted(expected) or columns == expected else columns}


def check_contract(frame: DataFrame, expected: list[str]) -> None:
    """Names and order must be as expected, else ContractError with what differs."""
    if frame.columns != expected:
        raise ContractError(f"columns differ from the contract: {contract_difference(frame.columns, expected)}")


def replace_files(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing without the rows of incoming's files, with incoming; of equal row hashes the last to arrive stays."""
    touched = incoming.select("source_file").distinct()
    kept = existing.join(touched, "source_file", "left_anti").withColumn("arrival", F.lit(0))
    both = kept.unionByName(incoming.withColumn("arrival", F.lit(1)))
    last = W.partitionBy("row_hash").orderBy(F.desc("arrival"), F.desc("source_file"), F.desc("source_row"))
    return both.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place", "arrival")


def file_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, content_hash, status (new, changed, unchanged) against a manifest of path, content_hash."""
    known = manifest.select("path", F.col("content_hash").alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("content_hash"), "unchanged").otherwise("changed")
    return files.join(known, "path", "left").select("path", "content_hash", status.alias("status"))


def ranged(frame: DataFrame, *order: Column) -> DataFrame:
    """frame dealt by ranges of the order, with _task: the number of the range."""
    return frame.repartitionByRange(*order).withColumn("_task", F.spark_partition_id())


def numbered(ranges: DataFrame, limit: int, *order: Column, by: str | None = None) -> DataFrame:
    """ranges of ranged() with part: rows in order, `limit` to a part, each value of `by` for itself.
    Ranges are numbered by their own counts, so no task holds all rows of a group."""
    group = [by] if by else []
    sizes = ranges.groupBy(*group, "_task").agg(F.count("*").alias("_n"))
    before = sizes.select(*group, "_task", (F.sum("_n").over(W.partitionBy(*group).orderBy("_task")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy(*group, "_task").orderBy(*order)) + F.col("_before")
    return ranges.join(F.broadcast(before), [*group, "_task"]).withColumn("part", (F.floor((place - 1) / limit) + 1).cast("int")).drop("_task", "_before")


def part_numbers(frame: DataFrame, limit: int, *order: Column) -> DataFrame:
    """frame with part: rows in order, `limit` to a part."""
    return numbered(ranged(frame, *order), limit, *order)


def sparse_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
