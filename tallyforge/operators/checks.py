"""Quality checks on a fact table. They flag rows, they never delete any.

Input: banque, produit_code, mois_reception ('yyyy-MM'), num_contrat, date_effet, prime_nette,
frais, prime_totale, prime_totale_source, source_format, source_file, source_row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.dates import months_between
from tallyforge.functions.text import base_name
from tallyforge.sources import tables

TOLERANCE, AGREEMENT, LATE_MONTHS, EARLY_MONTHS = 0.01, 0.5, 3, 1
#: Rows that a message on repeated ones lists.
LISTED_ROWS = 1000
FLAG_COLUMNS = ["severity", "code", "message", "banque", "mois_reception", "source_file", "source_row", "field"]
READ = ["banque", "mois_reception", "num_contrat", "date_effet", "prime_nette", "frais", "prime_totale", "prime_totale_source", "source_format", "source_file", "source_row"]


def flag(frame: DataFrame, severity: str, code: Column | str, message: Column, field: Column | None = None) -> DataFrame:
    have = set(frame.columns)
    at = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return frame.select(
        F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"), at("banque", "string"), at("mois_reception", "string"),
        at("source_file", "string"), at("source_row", "int"), (F.lit(None) if field is None else field).cast("string").alias("field"),
    )


def raised(when: Column, severity: str, code: Column | str, message: Column, field: Column) -> Column:
    """What a row check says where `when` holds, else null."""
    said = F.struct(F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"), field.alias("field"))
    return F.when(when, said)


def row_flags(frame: DataFrame, checks: list[Column]) -> DataFrame:
    """The flags of checks that look at one row each, all of them in one pass: checks of raised()."""
    said = frame.withColumn("_said", F.explode(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<struct<severity:string,code:string,message:string,field:string>>")))
    have = set(frame.columns)
    at = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    return said.select("_said.severity", "_said.code", "_said.message", at("banque", "string"), at("mois_reception", "string"), at("source_file", "string"), at("source_row", "int"), "_said.field")


def required_checks(fields: list[str], by_format: dict[str, list[str]] | None = None) -> list[Column]:
    out = []
    for f in fields:
        due = F.lit(True)
        for name, own in (by_format or {}).items():
            if f not in own:
                due = due & ~F.col("source_format").eqNullSafe(name)
        out.append(raised(F.col(f).isNull() & due, "error", "missing_required", F.lit(f"Champ obligatoire absent : {f}"), F.lit(f)))
    return out


def required(frame: DataFrame, fields: list[str], by_format: dict[str, list[str]] | None = None) -> DataFrame:
    """A flag for each required field that a row lacks; a format's own list stands in for the product's."""
    return row_flags(frame, required_checks(fields, by_format))


def premium_check(tolerance: float = TOLERANCE) -> Column:
    apart = F.abs(F.col("prime_nette") + F.col("frais") - F.col("prime_totale"))
    bad = (F.col("prime_totale_source") == "reported") & (apart > tolerance)
    return raised(bad, "warning", "premium_mismatch", F.format_string("Écart de %.2f entre nette + frais et totale", apart.cast("double")), F.lit("prime_totale"))


def premium(frame: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Reported totals that aren't net premium plus fees."""
    return row_flags(frame, [premium_check(tolerance)])


def effect_month() -> Column:
    return F.date_format("date_effet", "yyyy-MM")


def period_shares(frame: DataFrame) -> DataFrame:
    """source_file, banque, mois_reception, rows, agreeing, modal: by file and month, dated rows only; the earliest of equal modes."""
    dated = frame.where(F.col("date_effet").isNotNull()).select("source_file", "banque", "mois_reception", effect_month().alias("effect"))
    by_effect = dated.groupBy("source_file", "banque", "mois_reception", "effect").agg(F.count("*").alias("n"))
    return by_effect.groupBy("source_file", "banque", "mois_reception").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("effect") == F.col("mois_reception"), F.col("n")).otherwise(0)).alias("agreeing"),
        F.min_by("effect", F.struct(-F.col("n"), "effect")).alias("modal"),
    )


def period_agreement(frame: DataFrame, threshold: float = AGREEMENT) -> DataFrame:
    bad = period_shares(frame).where(F.col("agreeing") < F.col("rows") * threshold)
    return flag(bad, "error", "period_disagreement", F.concat(F.lit("La plupart des dates sont de "), "modal"), F.lit("date_effet"))


def coverage(frame: DataFrame) -> DataFrame:
    """banque, mois_reception, source_format, files: bank-months that several files cover; where one
    file's format is unknown, formats are not told apart in that month."""
    files = frame.where(F.col("banque").isNotNull() & F.col("mois_reception").isNotNull()).select("banque", "mois_reception", "source_format", "source_file").distinct()
    unknown = files.groupBy("banque", "mois_reception").agg(F.bool_or(F.col("source_format").isNull()).alias("unknown"))
    told = files.join(unknown, ["banque", "mois_reception"]).withColumn("source_format", F.when(~F.col("unknown"), F.col("source_format")))
    return told.groupBy("banque", "mois_reception", "source_format").agg(F.sort_array(F.collect_set("source_file")).alias("files")).where(F.size("files") >= 2)


def period_coverage(frame: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("files", base_name), ", ")
    return flag(coverage(frame), "error", "period_covered_twice", F.concat(F.lit("Plusieurs fichiers pour ce mois : "), names))


def lag_check(late: int = LATE_MONTHS, early: int = EARLY_MONTHS) -> Column:
    months = months_between(F.col("date_effet"), F.to_date(F.concat("mois_reception", F.lit("-01"))))
    code = F.when(months > late, "late_declaration").otherwise("future_effect")
    return raised((months > late) | (months < -early), "warning", code, F.format_string("%d mois entre effet et réception", months), F.lit("date_effet"))


def lag(frame: DataFrame, late: int = LATE_MONTHS, early: int = EARLY_MONTHS) -> DataFrame:
    return row_flags(frame, [lag_check(late, early)])


def repeated_rows(frame: DataFrame, listed: int = LISTED_ROWS) -> DataFrame:
    """source_file, banque, mois_reception, num_contrat, date_effet, prime_totale, n, source_rows, source_row
    of rows that a file holds several times (nulls equal). n counts all, source_rows has the first
    `listed` (the rest would be one cell of any size), source_row the first of all."""
    keys = ["source_file", "banque", "mois_reception", "num_contrat", "date_effet", "prime_totale"]
    counts = frame.groupBy(*keys).agg(F.count("*").alias("n"), F.min("source_row").alias("source_row")).where("n > 1")
    named = counts.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    own = frame.select(*keys, "source_row").join(named, same, "left_semi")
    first = own.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy("source_row"))).where(F.col("_place") <= listed)
    lists = first.groupBy(*keys).agg(F.sort_array(F.collect_list("source_row")).alias("source_rows")).select("source_rows", *(F.col(k).alias(f"_{k}") for k in keys))
    return counts.join(lists, same).select(*keys, "n", "source_rows", "source_row")


def duplicates_in_file(frame: DataFrame) -> DataFrame:
    found = repeated_rows(frame)
    more = F.when(F.col("n") > F.size("source_rows"), F.lit(", ...")).otherwise("")
    return flag(found, "error", "duplicate_in_file", F.concat(F.lit("Lignes identiques : "), F.array_join(F.col("source_rows").cast("array<string>"), ", "), more), F.lit("num_contrat"))


def shared_contracts(frame: DataFrame, names: int = 5) -> DataFrame:
    """files, n_contracts, first names, banque (of the first contract): contracts that several files hold, by set of files."""
    keep = frame.where(F.col("num_contrat").isNotNull())
    files = keep.groupBy("num_contrat").agg(F.sort_array(F.collect_set("source_file")).alias("files"), F.min_by("banque", F.struct("source_file", "source_row")).alias("banque")).where(F.size("files") > 1)
    # Counts combine before the shuffle, and so does the limit to the first names of each set of files.
    counts = files.groupBy("files").agg(F.count("*").alias("n_contracts"), F.min_by("banque", "num_contrat").alias("banque"))
    first = files.withColumn("place", F.row_number().over(W.partitionBy("files").orderBy("num_contrat"))).where(F.col("place") <= names)
    listed = first.groupBy("files").agg(F.sort_array(F.collect_list("num_contrat")).alias("contracts"))
    return counts.join(listed, "files").select("files", "n_contracts", "banque", "contracts")


def duplicates_across_files(frame: DataFrame) -> DataFrame:
    found = shared_contracts(frame)
    text = F.concat(F.col("n_contracts").cast("string"), F.lit(" contrats dans plusieurs fichiers : "), F.array_join("contracts", ", "))
    return flag(found, "info", "duplicate_across_files", text, F.lit("num_contrat"))


def all_checks(frame: DataFrame, fields: list[str], by_format: dict[str, list[str]] | None = None) -> DataFrame:
    """The flags of every check, in order of severity, code and file.

    What the checks read is written once, narrow: a frame that took joins to make is made once. Row
    checks are one pass over that; those of groups aggregate it before anything is shuffled."""
    read = tables.written(frame.select(*dict.fromkeys([*READ, *fields])), "checked")
    rows = row_flags(read, [*required_checks(fields, by_format), premium_check(), lag_check()])
    return severity_order(reduce(DataFrame.unionByName, [rows, period_agreement(read), period_coverage(read), duplicates_in_file(read), duplicates_across_files(read)]))


def severity_order(flags: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(9)
    return flags.orderBy(rank, "code", F.col("source_file").asc_nulls_last())
