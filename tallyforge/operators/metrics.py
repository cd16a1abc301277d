"""Aggregates over fact tables, flags and mappings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("prime_nette", "frais", "prime_totale", "capital_assure")


def cents(x: Column) -> Column:
    return F.rint(x * 100) / 100


def reconciliation(frame: DataFrame) -> DataFrame:
    """Rows, files, totals and derived premiums by bank and month; null keys are a group of their own."""
    totals = [cents(F.coalesce(F.sum(m), F.lit(0)).cast("double")).alias(f"{m}_total") for m in MEASURES if m in frame.columns]
    return frame.groupBy("banque", "mois_reception").agg(
        F.count("*").alias("lignes"), F.count_distinct("source_file").alias("fichiers"), *totals, F.count_if(F.col("prime_totale_source") == "derived").alias("primes_calculees")
    )


def status(frame: DataFrame) -> DataFrame:
    return frame.groupBy("banque", "produit_code").agg(F.count("*").alias("lignes"), F.count_distinct("mois_reception").alias("mois"), cents(F.coalesce(F.sum("prime_totale"), F.lit(0)).cast("double")).alias("prime_totale"))


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("severity", "code").agg(F.count("*").alias("n"))


def severity_counts(flags: DataFrame) -> DataFrame:
    return flags.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")))


def unresolved_frequency(mappings: DataFrame) -> DataFrame:
    return mappings.where(F.col("canonical").isNull() & (F.col("normalized") != "")).groupBy("header").agg(F.count("*").alias("n"))


def files_by_product(files: DataFrame) -> DataFrame:
    return files.groupBy("produit").agg(F.count("*").alias("n"))


def header_inventory(mappings: DataFrame) -> DataFrame:
    """By normalised header and product: spellings, banks, files and the first file's proposal."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), " | ")
    return mappings.groupBy("normalized", "produit").agg(joined("header").alias("variants"), joined("bank").alias("banks"), F.count_distinct("path").alias("n_files"), F.min_by("canonical", F.struct("path", "col_index")).alias("proposed"))


def date_bounds(frame: DataFrame) -> DataFrame:
    """The first and last plausible date."""
    good = F.when(F.col("date_effet").between("1677-09-22", "2262-04-10"), F.col("date_effet"))
    return frame.agg(F.min(good).alias("first"), F.max(good).alias("last"))
