"""The driver's tables seen as a fact table of sales, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["num_contrat", "date_effet", "prime_totale"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: bank, product, month, contract, dates and amounts, with gaps and mismatches."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    net, fees = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)")
    total = F.when(F.col("l_linenumber") % 3 == 0, None).when(F.col("l_orderkey") % 97 == 0, net + fees + F.lit(1)).otherwise(net + fees).cast("decimal(18,2)")
    month = F.date_format("o_orderdate", "yyyy-MM")
    return joined.select(
        F.col("n_name").alias("banque"), F.col("p_type").alias("produit_code"), month.alias("mois_reception"), F.col("l_orderkey").cast("string").alias("num_contrat"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate").cast("date")).alias("date_effet"), net.alias("prime_nette"), fees.alias("frais"), total.alias("prime_totale"),
        F.when(total.isNotNull(), "reported").alias("prime_totale_source"), F.when(F.col("l_returnflag") != "N", F.lower("l_returnflag")).alias("source_format"),
        F.concat(F.col("n_name"), F.lit("/"), month, F.lit("_"), F.col("l_returnflag")).alias("source_file"), F.col("l_linenumber").cast("int").alias("source_row"),
    )


SQL = """sales AS (
    SELECT banque, produit_code, mois_reception, num_contrat, date_effet, prime_nette, frais, prime_totale,
           CASE WHEN prime_totale IS NOT NULL THEN 'reported' END AS prime_totale_source, source_format, source_file, source_row
    FROM (SELECT n_name AS banque, p_type AS produit_code, strftime(o_orderdate, '%Y-%m') AS mois_reception, CAST(l_orderkey AS VARCHAR) AS num_contrat,
                 CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS date_effet, CAST(l_extendedprice AS DECIMAL(18,2)) AS prime_nette,
                 CAST(l_quantity AS DECIMAL(18,2)) AS frais,
                 CAST(CASE WHEN l_linenumber % 3 = 0 THEN NULL
                           ELSE CAST(l_extendedprice AS DECIMAL(18,2)) + CAST(l_quantity AS DECIMAL(18,2)) + CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END END AS DECIMAL(18,2)) AS prime_totale,
                 CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END AS source_format,
                 n_name || '/' || strftime(o_orderdate, '%Y-%m') || '_' || l_returnflag AS source_file, CAST(l_linenumber AS INTEGER) AS source_row
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
               JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey))"""
