"""What paths tell about files: bank, product, reporting period."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates, text


def folders(files: DataFrame) -> DataFrame:
    """path, level (1: nearest), name, norm of the folders above each file."""
    parts = F.slice(F.reverse(F.split("path", "/")), 2, F.size(F.split("path", "/")) - 1)
    return files.select("path", F.posexplode(parts).alias("level", "name")).where("name <> ''").select("path", (F.col("level") + 1).alias("level"), "name", text.normalize_header(F.regexp_replace("name", r"(?<![0-9])20[0-9]{2}(?![0-9])", " ")).alias("norm"))


def banks(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """path, bank, bank_level, bank_method: the nearest folder that names a bank; equal names before
    whole words within, longer tokens first. tokens: token (normalised), code."""
    named = folders(files).where("norm <> ''")
    words = F.split("norm", " ")
    # Every run of words of a folder name may be a token: an equi join instead of one row for each pair.
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda a: F.transform(F.sequence(F.lit(1), F.size(words) - a + 1), lambda n: F.array_join(F.slice(words, a, n), " "))))
    hits = named.select("path", "level", "norm", F.explode(F.array_distinct(runs)).alias("token")).join(tokens.select("token", "code"), "token")
    best = hits.groupBy("path").agg(F.min_by(F.struct("code", "level", (F.col("norm") == F.col("token")).alias("whole")), F.struct("level", F.col("norm") != F.col("token"), -F.length("token"), "code")).alias("b"))
    return best.select("path", F.col("b.code").alias("bank"), F.col("b.level").alias("bank_level"), F.when(F.col("b.whole"), "folder_exact").otherwise("folder_token").alias("bank_method"))


def products(files: DataFrame, keywords: DataFrame, bank_of: DataFrame) -> DataFrame:
    """path, produit, produit_method: the longest keyword in the file's name or any folder above it, of
    those that the bank offers, of all where the bank is unknown; several products by keywords of one
    length are ambiguous. keywords: token (normalised), produit, partners (array, empty or null: any)."""
    own = files.join(bank_of, "path", "left")
    above = folders(files).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), " ").alias("up"))
    stem = F.regexp_replace(text.base_name(F.col("path")), r"\.[A-Za-z]{3,4}$", "")
    texts = own.join(above, "path", "left").select("path", "bank", text.normalize_header(F.concat_ws(" ", stem, "up")).alias("t"))
    # A keyword's first word is one of the text's: an equi join instead of one row for each pair.
    named = keywords.where("token <> ''").withColumn("first", F.get(F.split("token", " "), F.lit(0)))
    near = texts.select("path", "bank", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("first")).join(named, "first")
    offered = F.col("bank").isNull() | F.col("partners").isNull() | (F.size("partners") == 0) | F.array_contains("partners", F.col("bank"))
    hits = near.where(F.concat(F.lit(" "), "t", F.lit(" ")).contains(F.concat(F.lit(" "), "token", F.lit(" "))) & offered)
    longest = hits.groupBy("path").agg(F.max(F.length("token")).alias("size"))
    top = hits.join(longest, "path").where(F.length("token") == F.col("size")).groupBy("path").agg(F.collect_set("produit").alias("all"))
    found = top.select("path", F.when(F.size("all") == 1, F.get("all", F.lit(0))).alias("produit"), F.when(F.size("all") == 1, "name").otherwise("ambiguous").alias("produit_method"))
    return files.select("path").join(found, "path", "left").withColumn("produit_method", F.coalesce("produit_method", F.lit("unresolved")))


def periods(files: DataFrame, bank_of: DataFrame) -> DataFrame:
    """path, year, month, period, period_method, period_confidence, period_conflict.

    Folders count up to the bank's, the nearest first; they fill in what the file's name leaves
    open, unless that names several months. A file and a folder that disagree are a conflict.
    """
    up = folders(files).join(bank_of, "path", "left").where(F.col("level") <= F.coalesce("bank_level", F.lit(100)))
    year = F.nullif(F.regexp_extract("name", r"(?<![0-9])(20[0-9]{2})(?![0-9])", 1), F.lit("")).cast("int")
    period = dates.resolve_period(F.concat("name", F.lit(".xlsx")), F.lit(None))
    seen = up.select("path", "level", year.alias("y"), period.alias("p")).withColumn("full", F.col("p.year").isNotNull() & F.col("p.month").isNotNull())
    near = seen.groupBy("path").agg(F.min_by("y", F.when(F.col("y").isNotNull(), F.col("level"))).alias("fy"), F.min_by("p", F.when(F.col("full"), F.col("level"))).alias("fp"))
    own = files.select("path").join(near, "path", "left")
    read = own.withColumn("o", dates.resolve_period(text.base_name(F.col("path")), F.coalesce("fy", "fp.year")))
    has = F.col("o.year").isNotNull() & F.col("o.month").isNotNull()
    several = F.col("o.month").isNull() & text.normalize_header(F.regexp_replace(text.base_name(F.col("path")), r"\.[A-Za-z]{3,4}$", "")).rlike(dates.NAME_PATTERN)
    folder = ~has & ~several & F.col("fp").isNotNull()
    pick = lambda c: F.when(folder, F.col(f"fp.{c}")).otherwise(F.col(f"o.{c}"))
    conflict = has & F.col("fp").isNotNull() & ((F.col("o.year") != F.col("fp.year")) | (F.col("o.month") != F.col("fp.month")))
    out = read.select("path", pick("year").alias("year"), pick("month").alias("month"), F.when(folder, F.concat(F.lit("folder_"), "fp.method")).otherwise(F.col("o.method")).alias("period_method"), pick("confidence").alias("period_confidence"), F.coalesce(conflict, F.lit(False)).alias("period_conflict"))
    return out.withColumn("period", F.when(F.col("year").isNotNull() & F.col("month").isNotNull(), F.format_string("%04d-%02d", "year", "month")))


def describe(files: DataFrame, bank_tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """files with bank, product, period and the first error that keeps a file from being read; a path
    in several rows is described in each."""
    own = files.select("path").distinct()
    bank_of = banks(own, bank_tokens)
    out = files.join(bank_of.drop("bank_level"), "path", "left").join(products(own, keywords, bank_of), "path").join(periods(own, bank_of), "path")
    error = F.when(F.col("bank").isNull(), "no known bank in the path").when(F.col("period_conflict"), "file and folder name different periods").when(F.col("period").isNull(), "no period in the path")
    return out.withColumn("error", error)
