"""Products as configuration: their fields, what those derive from, and how a file's rows become theirs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text

Rules = dict[str, list[tuple[str, list[str]]]]


def needed(fields: list[str], rules: Rules) -> list[str]:
    """The fields and whatever their rules take as input, in turn; each once, in order of need."""
    out = list(dict.fromkeys(fields))
    for name in out:  # grows while it is read
        out += [c for _, inputs in rules.get(name, []) for c in inputs if c not in out]
    return list(dict.fromkeys(out))


def projected(frame: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """The product's fields (name, type) in their order; one that the frame lacks is a column of nulls."""
    return frame.select(*((F.col(f) if f in frame.columns else F.lit(None)).cast(kind).alias(f) for f, kind in fields))


def with_constants(frame: DataFrame, files: DataFrame) -> DataFrame:
    """frame (source_file) with what its file says for all its rows: banque, produit_code, mois_reception, annee, source_format.

    files: path, bank, produit, period ('yyyy-MM'), source_format; a file without an entry gives nulls."""
    own = files.select(F.col("path").alias("source_file"), F.col("bank").alias("banque"), F.col("produit").alias("produit_code"), F.col("period").alias("mois_reception"), F.substring("period", 1, 4).cast("int").alias("annee"), "source_format")
    return frame.join(own, "source_file", "left")


def with_provenance(frame: DataFrame, business: list[str], ingested_at: str) -> DataFrame:
    """frame (source_file) with the run's time stamp and a hash of its business columns."""
    return frame.withColumns({"ingested_at": F.lit(ingested_at), "row_hash": text.row_hash(F.col("source_file"), *(F.col(c) for c in business))})


def missing_fields(frame: DataFrame, required: list[str]) -> DataFrame:
    """source_file, field: required fields that no row of a file has."""
    counts = frame.groupBy("source_file").agg(*(F.count(f).alias(f) for f in required))
    return counts.select("source_file", F.explode(F.array_compact(F.array(*(F.when(F.col(f) == 0, F.lit(f)) for f in required)))).alias("field"))


def derived_messages(filled: DataFrame, field: str, rule: str, inputs: list[str]) -> DataFrame:
    """source_file, message: how many values of field a rule gave in each file. filled: with <field>_source."""
    counts = filled.groupBy("source_file").agg(F.count_if(F.col(f"{field}_source") == "derived").alias("k"), F.count("*").alias("n")).where("k > 0")
    return counts.select("source_file", F.format_string(f"{field}: %d of %d values computed as {rule}({', '.join(inputs)})", "k", "n").alias("message"))


def by_family(products: DataFrame) -> DataFrame:
    """famille, produits (sorted, distinct). products: famille, produit."""
    return products.groupBy("famille").agg(F.sort_array(F.collect_set("produit")).alias("produits"))


def seed_aliases(fields: DataFrame) -> DataFrame:
    """alias, canonical: the normalised names, labels and aliases of fields for all products; of fields
    that claim one alias the first. fields: place, name, label, aliases (array), scope (null: all products)."""
    own = fields.where(F.col("scope").isNull())
    said = own.select("place", "name", F.explode(F.concat(F.array("name", "label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("said"))
    return said.select("place", "name", text.normalize_header(F.col("said")).alias("alias")).where("alias <> ''").groupBy("alias").agg(F.min_by("name", "place").alias("canonical"))
