"""Dates and reporting periods: day first, French month names, spreadsheet serials."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import clean_spaces, normalize_header

#: Month names, and the short forms that aren't prefixes of three letters at least
#: or that another month would share.
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
SHORT = {"jul": 7, "jun": 6}
#: Serials of 1990 to 2079, between which a bare number is a date.
FIRST_SERIAL, LAST_SERIAL = 32874, 65746


def month_names() -> dict[str, int]:
    """Every accepted spelling: unique prefixes of three letters or more, and SHORT."""
    prefixes: dict[str, set[int]] = {}
    for number, name in enumerate(MONTHS, 1):
        for n in range(3, len(name) + 1):
            prefixes.setdefault(name[:n], set()).add(number)
    return {p: m.pop() for p, m in prefixes.items() if len(m) == 1 or p in MONTHS} | SHORT


def french_month(c: Column) -> Column:
    names = month_names()
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), normalize_header(c))


def _date(y: Column, m: Column, d: Column) -> Column:
    year = y.try_cast("int")
    full = F.when(F.length(y) > 2, year).when(year < 70, year + 2000).otherwise(year + 1900)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", full, m.try_cast("int"), d.try_cast("int")), "yyyy-MM-dd")


def to_date(c: Column) -> Column:
    """The date a text gives, day first unless a year of four digits leads; null if there is none."""
    return date_of(clean_spaces(c))


def date_of(text: Column) -> Column:
    """to_date() of a text whose blanks are clean: a column of its own keeps the generated code short,
    since the text is named here a dozen times."""
    parts = r"^([0-9]{1,4})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})$"
    a, b, e = (F.regexp_extract(text, parts, k) for k in (1, 2, 3))
    named = r"^([0-9]{1,2})[\- /.]+([^0-9\s/.\-]+)\.?[\- /.]+([0-9]{2,4})$"
    day, name, year = (F.regexp_extract(text, named, k) for k in (1, 2, 3))
    month = french_month(name)
    return (
        F.when(text.rlike(parts) & (F.length(a) == 4), _date(a, b, e))
        .when(text.rlike(parts) & (F.length(a) <= 2), _date(e, b, a))
        .when(text.rlike(named), F.when(month.isNotNull(), _date(year, month.cast("string"), day)))
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}$"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
        .when(text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9:]{8}$"), F.try_to_date(F.substring(text, 1, 10), "dd/MM/yyyy"))
    )


def serial_date(n: Column) -> Column:
    """The date of a spreadsheet serial; null outside the plausible range."""
    return F.when((n >= FIRST_SERIAL) & (n <= LAST_SERIAL), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))


def months_between(earlier: Column, later: Column) -> Column:
    """Calendar months from one date to another, days aside."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


#: Month spellings that are searched in file names, longer ones first.
NAME_PATTERN = "janvier|janv|jan|fevrier|fevr|fev|mars|mar|avril|avr|mai|juillet|juil|jul|juin|jun|aout|aou|septembre|sept|sep|octobre|octo|oct|novembre|nov|decembre|dec"


def _month_of_stem(stem: Column) -> Column:
    first = F.substring(stem, 1, 3)
    numbers = {name[:3]: k for k, name in enumerate(MONTHS, 1) if name[:3] != "jui"}
    by_three = F.element_at(F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair)), first)
    return F.when(stem.startswith("juil") | (stem == "jul"), 7).when(stem.startswith("juin") | (stem == "jun"), 6).otherwise(by_three)


def resolve_period(name: Column, fallback_year: Column) -> Column:
    """struct(year, month, method, confidence) of a file or folder name.

    A month name with its year right behind it first, since other digits of a name (a customer's, a
    contract's) may look like a period or a year; then digits (year and month, either way round), then
    month names. More than one month is no month. A year of four digits beats one of two, which beats
    the folder's.
    """
    stem = F.regexp_replace(name, r"\.[A-Za-z]{3,4}$", "")
    ym, my = r"(?<![0-9])(20[0-9]{2})[\-_. ]?(0[1-9]|1[0-2])(?![0-9])", r"(?<![0-9])(0[1-9]|1[0-2])[\-_. ]?(20[0-9]{2})(?![0-9])"
    text = normalize_header(stem)
    months = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(0)), _month_of_stem))
    year4 = F.nullif(F.regexp_extract(text, r"(?<![0-9])(20[0-9]{2})(?![0-9])", 1), F.lit("")).cast("int")
    year2 = F.nullif(F.regexp_extract(text, r"(?<![0-9])([0-9]{2})(?![0-9])", 1), F.lit("")).cast("int") + 2000
    month = F.when(F.size(months) == 1, F.get(months, F.lit(0)))
    behind = F.nullif(F.regexp_extract(text, rf"(?:{NAME_PATTERN}) ?(20[0-9]{{2}})(?![0-9])", 1), F.lit("")).cast("int")
    year = F.coalesce(year4, year2, fallback_year.cast("int"))

    def found(y: Column, m: Column, method: str, confidence) -> Column:
        return F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"), F.lit(method).alias("method"), F.lit(confidence).cast("double").alias("confidence") if not isinstance(confidence, Column) else confidence.alias("confidence"))

    return (
        F.when(month.isNotNull() & behind.isNotNull(), found(behind, month, "name", 1.0))
        .when(stem.rlike(ym), found(F.regexp_extract(stem, ym, 1), F.regexp_extract(stem, ym, 2), "digits", 1.0))
        .when(stem.rlike(my), found(F.regexp_extract(stem, my, 2), F.regexp_extract(stem, my, 1), "digits", 1.0))
        .when(month.isNotNull() & year.isNotNull(), found(year, month, "name", F.when(year4.isNotNull(), 1.0).otherwise(0.85)))
        .otherwise(found(year, month, "unresolved", 0.0))
    )


def calendar(first: Column, last: Column, source: DataFrame) -> DataFrame:
    """A row for each day from the first of the first month to the end of the last; source gives one row of bounds."""
    day = source.select(F.explode(F.sequence(F.trunc(first, "MM"), F.last_day(last))).alias("date"))
    names = F.array(*map(F.lit, ("Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre")))
    d = F.col("date")
    return day.select(
        "date", F.year(d).alias("annee"), F.month(d).alias("mois"), F.element_at(names, F.month(d)).alias("nom_mois"), F.date_format(d, "yyyy-MM").alias("annee_mois"),
        F.concat(F.lit("T"), F.quarter(d).cast("string")).alias("trimestre"), F.dayofmonth(d).alias("jour"), (F.weekday(d) + 1).alias("jour_semaine"),
    )


def empty_calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "date date, annee int, mois int, nom_mois string, annee_mois string, trimestre string, jour int, jour_semaine int")


def like_date(kind: Column, s: Column) -> Column:
    """Whether a cell is a date, or a text that gives one; a bare number isn't."""
    return F.coalesce((kind == "d") | ((kind == "s") & to_date(s).isNotNull()), F.lit(False))
