"""Named source formats: which one a file has, and its own dictionary of headers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text


def detect(files: DataFrame, formats: DataFrame) -> DataFrame:
    """path, source_format, error: the format whose pattern is the whole normalised stem of the file's
    name; several are an error, none is none. files: path, produit; formats: produit, format, pattern.

    The formats are configuration (tens of rows), so their join to files is by product and a broadcast."""
    stem = text.normalize_header(F.regexp_replace(text.base_name(F.col("path")), r"\.[A-Za-z]{3,4}$", ""))
    fits = files.select("path", "produit", stem.alias("stem")).join(F.broadcast(formats), "produit").where(F.expr("stem rlike concat('^(', pattern, ')$')"))
    found = fits.groupBy("path").agg(F.sort_array(F.collect_set("format")).alias("all"))
    one = F.when(F.size("all") == 1, F.get("all", F.lit(0)))
    several = F.when(F.size("all") > 1, F.concat(F.lit("several formats fit: "), F.array_join("all", ", ")))
    return files.select("path").join(found, "path", "left").select("path", one.alias("source_format"), several.alias("error"))


def dictionary(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """headers with canonical and method where their format's dictionary has the whole header, else its
    last part. What it lacks stays unresolved: neither similarity nor a model follows.

    headers: file_id, col, source_format, normalized, leaf; aliases: source_format, alias, canonical."""
    whole = aliases.select("source_format", F.col("alias").alias("normalized"), F.col("canonical").alias("_whole"))
    part = aliases.select("source_format", F.col("alias").alias("leaf"), F.col("canonical").alias("_part"))
    both = headers.join(F.broadcast(whole), ["source_format", "normalized"], "left").join(F.broadcast(part), ["source_format", "leaf"], "left")
    found = F.coalesce("_whole", "_part")
    return both.withColumns({"canonical": found, "method": F.when(found.isNotNull(), "source")}).select(*headers.columns, "canonical", "method")
