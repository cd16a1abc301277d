"""Typed values of untyped columns, with a report on what was converted."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers, text

FAILURES, FAILURE_CHARS = 10, 40


def report(rows: DataFrame, by: str, raw: Column, value: Column, shown: Column, keep: int = FAILURES) -> DataFrame:
    """by, total, converted, blank, failed and the first failures (joined) of each group."""
    marked = rows.withColumn("_blank", text.is_blank(raw)).withColumn("_failed", value.isNull() & ~F.col("_blank")).withColumn("_shown", F.substring(shown, 1, FAILURE_CHARS))
    place = F.row_number().over(W.partitionBy(by, "_failed").orderBy("_shown"))
    first = marked.where("_failed").withColumn("_place", place).where(F.col("_place") <= keep)
    lists = first.groupBy(by).agg(F.array_join(F.sort_array(F.collect_list("_shown")), ",").alias("failures"))
    counts = marked.groupBy(by).agg(F.count("*").alias("total"), F.count_if(~F.col("_blank") & ~F.col("_failed")).alias("converted"), F.count_if("_blank").alias("blank"), F.count_if("_failed").alias("failed"))
    return counts.join(lists, by, "left")


def votes(cells: DataFrame) -> DataFrame:
    """file_id, field, separator, percent: one decision for each column. cells: file_id, field, s (text) and n (number)."""
    voted = cells.select("file_id", "field", numbers.separator_vote(F.col("s")).alias("vote"), F.coalesce("s", F.col("n").cast("string")).alias("said"))
    return voted.groupBy("file_id", "field").agg(numbers.majority(F.col("vote")).alias("separator"), numbers.is_percent(F.col("said")).alias("percent"))


def typed(cells: DataFrame) -> DataFrame:
    """cells with text_value, number_value and date_value by their field's type. cells: file_id, row, field, type, kind, s, n, d."""
    # A column for each step: an expression named several times would be written out as often in the generated code.
    kind, text_kind = F.col("type"), F.col("kind") == "s"
    decided = cells.join(votes(cells).hint("merge"), ["file_id", "field"]).withColumns({"_clean": text.clean_spaces(F.col("s")), "_amount": kind.isin("money", "percent", "integer") & (F.col("kind") != "b")})
    read = numbers.number_column(decided, "_read", "_clean", "separator").withColumn("_number", F.when(F.col("_amount"), F.coalesce("n", "_read")))
    scaled = read.withColumn("_scaled", F.when((kind == "percent") & F.col("percent"), F.col("_number") / 100).otherwise(F.col("_number")))
    whole = F.when(kind == "integer", numbers.to_integer(F.col("_scaled")).cast("double")).otherwise(F.col("_scaled"))
    date = F.coalesce(F.col("d"), F.when(F.col("n").isNotNull(), dates.serial_date(F.col("n"))), dates.date_of(F.col("_clean")))
    name = F.when(F.col("kind") == "n", text.identifier_of_number(F.col("n"))).when(text_kind, text.identifier_of_text(F.col("_clean")))
    plain = F.coalesce(F.nullif("_clean", F.lit("")), F.when(F.col("kind") == "n", text.identifier_of_number(F.col("n"))), F.col("d").cast("string"))
    return scaled.select(
        *cells.columns,
        F.when(kind == "identifier", name).when(kind.isin("text", "category", "period"), plain).alias("text_value"),
        whole.alias("number_value"),
        F.when((kind == "date") & (F.col("kind") != "b"), date).alias("date_value"),
    )
