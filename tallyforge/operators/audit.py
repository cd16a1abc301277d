"""What a run is reviewed by: orders, filters and projections over its tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states of a file in the summary.
FAILED, REVIEW, FINE = "erreur", "à vérifier", "ok"
PREVIEW_CELLS, PREVIEW_CHARS = 4, 20


def clamp(x: Column) -> Column:
    """x as a number between 0 and 1; 0 for what is none."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x.try_cast("double"), F.lit(0.0)))), F.lit(0.0))


def only(files: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """The files whose path is wanted; all where nothing is."""
    return files if wanted is None else files.join(wanted.select("path").distinct(), "path", "left_semi")


def for_review() -> Column:
    """Whether a column has no field, has warnings, or was named by a model."""
    return F.col("canonical").isNull() | (F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0) | F.coalesce(F.col("method").isin("model", "model-table"), F.lit(False))


def needs_review(mappings: DataFrame) -> DataFrame:
    return mappings.where(for_review())


def read_files(files: DataFrame) -> DataFrame:
    """files with ok: read without an error, and with rows."""
    return files.withColumn("ok", F.col("error").isNull() & (F.coalesce("n_rows", F.lit(0)) > 0))


def losers(settled: DataFrame) -> DataFrame:
    """Mappings after conflicts: the columns that lost a field have none, a warning that names it, and
    it as their first suggestion. settled: canonical, won, warnings, suggestions (arrays of names)."""
    lost = F.col("canonical").isNotNull() & ~F.col("won")
    empty = F.array().cast("array<string>")
    swap = {
        "warnings": F.when(lost, F.concat(F.coalesce("warnings", empty), F.array(F.concat(F.lit("another column has "), "canonical")))).otherwise(F.coalesce("warnings", empty)),
        "suggestions": F.when(lost, F.concat(F.array("canonical"), F.array_remove(F.coalesce("suggestions", empty), F.col("canonical")))).otherwise(F.coalesce("suggestions", empty)),
        "canonical": F.when(~lost, F.col("canonical")),
    }
    return settled.withColumns(swap)


def preview(cells: DataFrame) -> DataFrame:
    """file_id, row, preview: the first filled cells of each row, cut short. cells: file_id, row, col, shown."""
    rows = cells.where("shown <> ''").groupBy("file_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.substring("shown", 1, PREVIEW_CHARS).alias("s")))).alias("c"))
    return rows.select("file_id", "row", F.array_join(F.transform(F.slice("c", 1, PREVIEW_CELLS), lambda x: x["s"]), " | ").alias("preview"))


def conserved(kept: DataFrame, dropped: DataFrame, extent: DataFrame) -> DataFrame:
    """file_id, kept, dropped, due: rows of each table's extent that are kept or dropped, which must add up to due.

    kept, dropped: file_id, row; extent: file_id, data_start, data_end."""
    inside = lambda rows, name: rows.select("file_id", "row").distinct().join(extent.hint("merge"), "file_id").where(F.col("row").between(F.col("data_start"), F.col("data_end"))).groupBy("file_id").agg(F.count("*").alias(name))
    both = extent.join(inside(kept, "kept").hint("merge"), "file_id", "left").join(inside(dropped, "dropped").hint("merge"), "file_id", "left")
    return both.select("file_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"), (F.col("data_end") - F.col("data_start") + 1).cast("long").alias("due"))


def summary(files: DataFrame, mappings: DataFrame, dropped: DataFrame) -> DataFrame:
    """path, statut, columns, resolved, to_review, dropped, error of every file.

    files: path, error, n_rows; mappings: path, canonical, warnings, method; dropped: path."""
    counts = mappings.groupBy("path").agg(F.count("*").alias("columns"), F.count("canonical").alias("resolved"))
    review = needs_review(mappings).groupBy("path").agg(F.count("*").alias("to_review"))
    lost = dropped.groupBy("path").agg(F.count("*").alias("dropped"))
    joined = read_files(files).join(counts, "path", "left").join(review, "path", "left").join(lost, "path", "left").na.fill(0, ["columns", "resolved", "to_review", "dropped"])
    state = F.when(~F.col("ok"), FAILED).when(F.col("to_review") > 0, REVIEW).otherwise(FINE)
    return joined.select("path", state.alias("statut"), "columns", "resolved", "to_review", "dropped", "error")


def failed_coercions(report: DataFrame) -> DataFrame:
    """The columns of a coercion report with values that could not be read."""
    return report.where("failed > 0")


def facts_in_order(frame: DataFrame) -> DataFrame:
    return frame.orderBy(*(F.col(c).asc_nulls_last() for c in ("banque", "mois_reception", "source_file", "source_row")))


def inventory_in_order(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy(F.col("proposed").asc_nulls_last(), F.desc("n_files"))


def most_common(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Headers by falling n, equal ones by name; the first k if given."""
    ordered = counts.orderBy(F.desc("n"), "header")
    return ordered.limit(k) if k is not None else ordered


def dropped_in_order(dropped: DataFrame) -> DataFrame:
    return dropped.orderBy("file_id", "row")


def gate(flags: DataFrame, mappings: DataFrame, allow_errors: bool = False, allow_review: bool = False) -> str | None:
    """Why a run must not be committed, or None: error flags, or columns to review, that nobody allowed."""
    if not allow_errors and not flags.where("severity = 'error'").isEmpty():
        return "errors"
    return "review" if not allow_review and not needs_review(mappings).isEmpty() else None
