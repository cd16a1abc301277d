"""The tables by which somebody reviews a run: files, header decisions, what was left out, what couldn't be read."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import audit

#: Words that a review shows.
UNRESOLVED, ROW, COLUMN = "(non résolu)", "ligne", "colonne"
#: Examples of unreadable values for each column.
EXAMPLES = 5


def _of_file(*more: str) -> list[Column]:
    names = {"bank": "banque", "produit": "produit", "period": "mois_reception"}
    return [text.base_name(F.col("path")).alias("fichier"), *(F.coalesce(c, F.lit("")).alias(names[c]) for c in more)]


def files_reviewed(files: DataFrame, tables: DataFrame, mappings: DataFrame, dropped: DataFrame, dropped_columns: DataFrame, missing: DataFrame, derived: DataFrame, notes: DataFrame) -> DataFrame:
    """A row for each file in 19 columns: what it is, where its table lies, what was kept and left out, what needs attention.

    files: file_id, path, sheet, bank, produit, produit_method, period, period_method, error, n_rows.
    tables: file_id, header_row, data_start, data_end. mappings: file_id, normalized, canonical,
    warnings, method, a row for each column kept. dropped, dropped_columns: file_id. missing,
    derived: file_id, field. notes: file_id, note. Everything but files may lack a file. Lists are in
    alphabetical order. The parts meet in one aggregate by file, to which each task sends one
    partial row a file, however many rows were left out.
    """
    none = F.lit(None).cast("string")

    def part(table: DataFrame, kind: str, value: Column = none, review: Column = F.lit(False)) -> DataFrame:
        return table.select("file_id", F.lit(kind).alias("kind"), value.alias("value"), review.alias("review"))

    named = F.coalesce("normalized", F.lit("")) != ""
    open_header = F.when(F.col("canonical").isNull() & named, F.lit("open"))
    parts = part(mappings, "column", open_header, named & audit.for_review())
    for table, kind, value in [(dropped, "row", none), (dropped_columns, "left", none), (missing, "missing", F.col("field")), (derived, "derived", F.col("field")), (notes, "note", F.col("note"))]:
        parts = parts.union(part(table, kind, value))
    of = lambda kind: F.col("kind") == kind
    listed = lambda kind, mark: F.array_join(F.sort_array(F.collect_set(F.when(of(kind), F.col("value")))), mark)  # noqa: E731  a file's fields and notes are few
    counts = parts.groupBy("file_id").agg(
        F.count_if(of("row")).alias("rows_out"), F.count_if(of("column")).alias("cols_in"), F.count_if(of("left")).alias("cols_out"), F.count_if(of("column") & F.col("value").isNotNull()).alias("open"),
        F.max("review").alias("review"), listed("derived", ", ").alias("derived"), listed("missing", ", ").alias("missing"), listed("note", "; ").alias("note"),
    )
    joined = files.join(tables.select("file_id", "header_row", "data_start", "data_end"), "file_id", "left").join(counts, "file_id", "left")
    state = F.when(F.col("error").isNotNull(), audit.FAILED).when(F.col("review"), audit.REVIEW).otherwise(audit.FINE)
    number, words = lambda c: F.coalesce(c, F.lit(0)).cast("long"), lambda c: F.coalesce(c, F.lit(""))
    return joined.select(
        *_of_file("bank", "produit"), F.col("produit_method").alias("produit_detecte"), words("period").alias("mois_reception"), F.col("period_method").alias("periode_source"), F.col("sheet").alias("feuille"),
        F.col("header_row").alias("ligne_entete"), F.col("data_start").alias("premiere_ligne"), F.col("data_end").alias("derniere_ligne"), number("n_rows").alias("lignes_gardees"), number("rows_out").alias("lignes_supprimees"),
        number("cols_in").alias("colonnes_gardees"), number("cols_out").alias("colonnes_supprimees"), number("open").alias("entetes_non_resolus"), words("derived").alias("champs_calcules"), words("missing").alias("champs_requis_absents"),
        state.alias("statut"), F.coalesce("error", "note", F.lit("")).alias("note"),
    )


def mappings_reviewed(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """A row for each header decision in 12 columns; columns without a header aren't shown.

    mappings: file_id, header, normalized, canonical, method, confidence, reason, warnings, suggestions."""
    shown = mappings.where(F.coalesce("normalized", F.lit("")) != "").join(files.select("file_id", "path", "bank", "produit", "period"), "file_id")
    joined = lambda c, mark: F.coalesce(F.array_join(c, mark), F.lit(""))
    return shown.select(
        *_of_file("bank", "produit", "period"), F.col("header").alias("en_tete"), F.col("normalized").alias("en_tete_normalise"), F.coalesce("canonical", F.lit(UNRESOLVED)).alias("champ"), F.coalesce("method", F.lit("")).alias("methode"),
        F.bround(F.coalesce("confidence", F.lit(0.0)), 2).alias("confiance"), F.coalesce("reason", F.lit("")).alias("raison"), joined("warnings", "; ").alias("avertissements"), joined("suggestions", ", ").alias("suggestions"),
    )


def dropped_reviewed(files: DataFrame, dropped: DataFrame, dropped_columns: DataFrame) -> DataFrame:
    """A row for each row and column left out, with its place in the sheet and why.

    dropped: file_id, row, reason, preview. dropped_columns: file_id, letter, reason, header."""
    rows = dropped.select("file_id", F.lit(ROW).alias("type"), F.concat(F.lit(f"{ROW} "), F.col("row").cast("string")).alias("position"), "reason", F.coalesce("preview", F.lit("")).alias("said"))
    columns = dropped_columns.select("file_id", F.lit(COLUMN).alias("type"), F.concat(F.lit(f"{COLUMN} "), "letter").alias("position"), "reason", F.coalesce("header", F.lit("")).alias("said"))
    joined = rows.union(columns).join(files.select("file_id", "path", "bank"), "file_id")
    return joined.select(*_of_file("bank"), "type", "position", F.col("reason").alias("motif"), F.col("said").alias("contenu"))


def conversions(values: DataFrame) -> DataFrame:
    """file_id, field, target_type, converted, blank, failed and examples (the first unreadable values by row).

    values: file_id, row, field, type, shown, and text_value, number_value, date_value as coerce.typed() gives them."""
    read = F.coalesce("text_value", F.col("number_value").cast("string"), F.col("date_value").cast("string")).isNotNull()
    blank = F.trim(F.coalesce("shown", F.lit(""))) == ""
    marked = values.select("file_id", "field", "type", "row", "shown", blank.alias("blank"), (~blank & ~read).alias("failed"))
    place = F.row_number().over(W.partitionBy("file_id", "field").orderBy("row", "shown"))
    first = marked.where("failed").withColumn("place", place).where(F.col("place") <= EXAMPLES)
    lists = first.groupBy("file_id", "field").agg(F.sort_array(F.collect_list(F.struct("place", "shown"))).alias("first"))
    counts = marked.groupBy("file_id", "field", F.col("type").alias("target_type")).agg(F.count_if(~F.col("blank") & ~F.col("failed")).alias("converted"), F.count_if("blank").alias("blank"), F.count_if("failed").alias("failed"))
    return counts.join(lists, ["file_id", "field"], "left").select(*counts.columns, F.transform("first", lambda x: x["shown"]).alias("examples"))


def coercions_reviewed(files: DataFrame, reports: DataFrame) -> DataFrame:
    """A row for each column with values that could not be read, in 10 columns.

    reports: file_id, header, target_type, separator, converted, blank, failed, examples."""
    wrong = reports.where("failed > 0").join(files.select("file_id", "path", "bank"), "file_id")
    rate = F.rint(100 * F.col("failed") / (F.col("converted") + F.col("failed"))).cast("int")
    return wrong.select(
        *_of_file("bank"), F.col("header").alias("en_tete"), F.col("target_type").alias("type_cible"), F.coalesce("separator", F.lit("")).alias("separateur_decimal"), F.col("converted").alias("converties"), F.col("blank").alias("vides"),
        F.col("failed").alias("echecs"), F.concat(rate.cast("string"), F.lit("%")).alias("taux_echec"), F.coalesce(F.array_join(F.slice("examples", 1, EXAMPLES), ", "), F.lit("")).alias("exemples"),
    )
