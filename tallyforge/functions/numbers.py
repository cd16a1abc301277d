"""Number parsing: separators are voted on by column, never by cell."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import clean_spaces, to_text, without_currency


def bare_number(c: Column) -> Column:
    """Digits, separators and signs of a text."""
    return F.regexp_replace(without_currency(clean_spaces(c)), r"[^0-9.,+\-]", "")


def separator_vote(c: Column) -> Column:
    """',' or '.' if the text tells its decimal separator, else null.

    With both, the last one is decimal. One kind that repeats or has exactly three digits behind
    it groups thousands and speaks for the other; else it speaks for itself.
    """
    n = bare_number(c)
    commas, dots = F.length(n) - F.length(F.replace(n, F.lit(","))), F.length(n) - F.length(F.replace(n, F.lit(".")))
    last_comma, last_dot = F.locate(",", F.reverse(n)), F.locate(".", F.reverse(n))
    grouped = (commas + dots > 1) | n.rlike(r"[.,][0-9]{3}$")
    return (
        F.when((commas > 0) & (dots > 0), F.when(last_comma < last_dot, ",").otherwise("."))
        .when(commas > 0, F.when(grouped, ".").otherwise(","))
        .when(dots > 0, F.when(grouped, ",").otherwise("."))
    )


def decimal_separator(c: Column) -> Column:
    """The majority of a group's votes; a comma where they are even or none."""
    return majority(separator_vote(c))


def majority(vote: Column) -> Column:
    return F.when(F.count_if(vote == ",") >= F.count_if(vote == "."), ",").otherwise(".")


def to_number(c: Column, separator: Column) -> Column:
    """The number a text holds, by its column's separator; in brackets it is negative; null if none."""
    text = to_text(c)
    return signed(text, with_point(bare_number(text), separator))


def with_point(n: Column, separator: Column) -> Column:
    """Digits with a point for the separator and without the marks between groups."""
    return F.when(separator == ",", F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(n, F.lit(","), F.lit("")))


def signed(text: Column, point: Column) -> Column:
    """The value of digits with_point(); of several points the last one counts. text: what they stood in."""
    dots = F.length(point) - F.length(F.replace(point, F.lit(".")))
    whole = F.substring_index(point, ".", -1)
    single = F.when(dots > 1, F.concat(F.replace(F.substring(point, F.lit(1), F.length(point) - F.length(whole) - 1), F.lit("."), F.lit("")), F.lit("."), whole)).otherwise(point)
    value = single.try_cast("double")
    return F.when(text.rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)


def number_column(frame: DataFrame, name: str, text: str, separator: str) -> DataFrame:
    """frame with to_number() of a text column without outer blanks, a column for each step: the generated
    code of one expression that names its parts many times outgrows what the JVM compiles."""
    steps = frame.withColumn("_bare", bare_number(F.nullif(text, F.lit("")))).withColumn("_point", with_point(F.col("_bare"), F.col(separator)))
    return steps.withColumn(name, signed(F.col(text), F.col("_point"))).drop("_bare", "_point")


def to_integer(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def is_percent(c: Column) -> Column:
    """Whether at least half of a group's texts carry a percent sign."""
    filled = F.count_if(to_text(c).isNotNull())
    return (filled > 0) & (F.count_if(c.contains("%")) * 2 >= filled)
