"""The composed run: cells of sheets become a product's facts, with what was mapped and what was left out."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers
from tallyforge.operators import audit, checks, coerce, detect, facts, formats, products, resolve, review
from tallyforge.plans.warehouse import Warehouse
from tallyforge.sources import tables
from tallyforge.sources.tables import written

#: Which typed value a field's type takes, and its Spark type.
VALUES = {"identifier": ("text_value", "string"), "text": ("text_value", "string"), "category": ("text_value", "string"), "period": ("text_value", "string"), "money": ("number_value", "double"), "percent": ("number_value", "double"), "integer": ("number_value", "long"), "date": ("date_value", "date")}


#: What the checks read; a product without one of these has nulls for it.
CHECKED = {"banque": "string", "mois_reception": "string", "num_contrat": "string", "date_effet": "date", "prime_nette": "double", "frais": "double", "prime_totale": "double", "prime_totale_source": "string", "source_format": "string"}


@dataclass
class Run:
    """facts, mappings (a row for each column of a table), dropped (rows, with reasons), dropped_columns
    (likewise) and notes (sheets without a table)."""

    facts: DataFrame
    mappings: DataFrame
    dropped: DataFrame
    dropped_columns: DataFrame
    notes: DataFrame
    #: Of all tables: columns, to_review, lines (from the first data row to the last) and blank ones
    #: among them, counted while the tables were written.
    counts: dict[str, int]
    #: What a review reads: files as given, tables (file_id, header_row, data_start, data_end), cells that
    #: are filled, and typed values with the separator of their column.
    files: DataFrame
    tables: DataFrame
    cells: DataFrame
    values: DataFrame

    def review(self, required: list[str]) -> dict[str, DataFrame]:
        """files, mappings, dropped and coercions, as somebody reviews them. Of the files given, error,
        produit_method and period_method may be absent. A field counts as computed in a file if it was in some row."""
        lacking = {c: F.lit(None).cast("string") for c in ("error", "produit_method", "period_method") if c not in self.files.columns}
        files = self.files.withColumns(lacking)
        ids = files.select("file_id", F.col("path").alias("source_file"))
        names = self.facts.columns
        ways = [c.removesuffix("_source") for c in names if c.endswith("_source") and c.removesuffix("_source") in names]
        computed = F.array_compact(F.array(*(F.when(F.col(f"{f}_source") == "derived", F.lit(f)) for f in ways))).cast("array<string>")
        derived = self.facts.select("source_file", F.explode(computed).alias("field")).distinct().join(ids, "source_file")
        missing = products.missing_fields(self.facts, [f for f in required if f in names]).join(ids, "source_file")
        counted = files.join(self.facts.groupBy("source_file").agg(F.count("*").alias("n_rows")).join(ids, "source_file").drop("source_file"), "file_id", "left")
        outside = self.dropped.join(audit.preview(self.cells.join(self.dropped.select("file_id", "row"), ["file_id", "row"], "left_semi")), ["file_id", "row"], "left")
        heads = self.mappings.where("won").select("file_id", F.col("canonical").alias("field"), "header")
        reports = review.conversions(self.values).join(coerce.votes(self.values).select("file_id", "field", "separator"), ["file_id", "field"]).join(heads, ["file_id", "field"])
        reports = reports.withColumn("separator", F.when(F.col("target_type").isin("money", "percent", "integer"), F.col("separator")))
        told = self.mappings if "reason" in self.mappings.columns else self.mappings.withColumn("reason", F.lit(None).cast("string"))
        return {
            "files": review.files_reviewed(counted, self.tables, self.mappings, self.dropped, self.dropped_columns, missing, derived, self.notes),
            "mappings": review.mappings_reviewed(files, told),
            "dropped": review.dropped_reviewed(files, outside, self.dropped_columns),
            "coercions": review.coercions_reviewed(files, reports),
        }

    def flags(self, required: list[str], by_format: dict[str, list[str]] | None = None) -> DataFrame:
        """The flags of all checks over the facts."""
        lacking = {c: F.lit(None).cast(t) for c, t in CHECKED.items() if c not in self.facts.columns}
        return checks.all_checks(self.facts.withColumns(lacking), [f for f in required if f in self.facts.columns], by_format)

    def commit(self, warehouse: Warehouse, product: str, required: list[str], allow_errors: bool = False, allow_review: bool = False, **delivery) -> dict[str, int | str | None]:
        """Appends the facts, if neither error flags nor columns to review stand against it (refused says
        which, and nothing is written then). delivery: as of Warehouse.append().

        Returns the counts of severities, columns and rows; all of them come from passes that the
        run makes anyway: conserved says whether the data lines are the facts' rows and the blank lines."""
        flags, said = tables.observed(self.flags(required), "flags", **{k: F.count_if(F.col("severity") == k) for k in ("error", "warning", "info")})
        counts = self.counts | said
        refused = "errors" if said["error"] and not allow_errors else "review" if self.counts["to_review"] and not allow_review else None
        tables.free(flags)
        if refused:
            return counts | {"refused": refused, "written": 0, "replaced": 0}
        done = warehouse.append(product, self.facts, **delivery)
        return counts | done | {"refused": None, "conserved": done["written"] + counts["blank"] == counts["lines"]}


@dataclass
class Words:
    """How headers become fields. aliases: tier, scope, alias, canonical. dictionaries: source_format,
    alias, canonical; a file with a format has its dictionary alone. overrides: normalized, field.
    expected: canonical, mostly, min_value_due, max_value_due, min_unique, max_unique."""

    aliases: DataFrame
    dictionaries: DataFrame | None = None
    overrides: DataFrame | None = None
    expected: DataFrame | None = None


def mapped(labels: DataFrame, files: DataFrame, words: Words) -> DataFrame:
    """labels (file_id, col, header, normalized, leaf) with canonical, method, confidence, suggestions
    (names) and won: by their format's dictionary or by equal aliases, else by near ones, then as
    somebody chose; of the columns that claim a field one wins.

    files: file_id, produit, bank, source_format. A file without an entry meets the aliases that hold for all."""
    heads = labels.select("file_id", "col", "header", "normalized", "leaf").join(detect.of_file(files.select("file_id", "produit", "bank", "source_format")), "file_id", "left")
    known = resolve.exact(heads.where("source_format is null") if words.dictionaries is not None else heads, words.aliases)
    general = words.aliases.where(F.col("scope").isNull())
    near = resolve.fuzzy(known.where("canonical is null").select("file_id", "col", "normalized"), general).select("file_id", "col", F.col("canonical").alias("_near"), "score", "suggestions")
    both = known.join(detect.of_file(near), ["file_id", "col"], "left")
    found = both.select(
        "file_id", "col", "header", "normalized", F.coalesce("canonical", "_near").alias("canonical"),
        F.coalesce("method", F.when(F.col("_near").isNotNull(), "fuzzy")).alias("method"), F.coalesce("confidence", F.when(F.col("_near").isNotNull(), F.col("score") / 100)).alias("confidence"),
        F.transform("suggestions", lambda x: x["name"]).alias("suggestions"),
    )
    if words.dictionaries is not None:
        own = formats.dictionary(heads.where("source_format is not null"), words.dictionaries)
        sure = F.when(F.col("canonical").isNotNull(), 1.0).alias("confidence")
        found = found.unionByName(own.select("file_id", "col", "header", "normalized", "canonical", "method", sure, F.lit(None).cast("array<string>").alias("suggestions")))
    if words.overrides is not None:
        found = resolve.override(found, words.overrides)
    return resolve.settle(found)


def judged(mappings: DataFrame, block: DataFrame, extent: DataFrame, expected: DataFrame | None) -> DataFrame:
    """mappings with warnings: what a column holds against what its field expects, and fields lost to
    another column (which then has none). block: the data rows' cells."""
    if expected is None:
        held = mappings.withColumn("warnings", F.lit(None).cast("array<string>"))
    else:
        number = F.coalesce("n", numbers.to_number(F.col("s"), F.lit(",")))
        cells = block.select("file_id", "col", "shown", number.alias("number"), F.coalesce("d", dates.to_date(F.col("s"))).alias("date"))
        profile = resolve.profiles(cells, extent.select("file_id", (F.col("data_end") - F.col("data_start") + 1).cast("long").alias("rows")))
        named = profile.join(detect.of_file(mappings.where("canonical is not null").select("file_id", "col", "canonical")), ["file_id", "col"])
        told = resolve.content_warnings(named, expected).select("file_id", "col", "warnings")
        held = mappings.join(detect.of_file(told), ["file_id", "col"], "left")
    return audit.losers(held)


def records(values: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """file_id, row and a column for each field (name, type) of typed values; a field that no column of a file has is null."""

    def value(name: str, kind: str) -> Column:
        column, sql = VALUES[kind]
        return F.max(F.when(F.col("field") == name, F.col(column))).cast(sql).alias(name)

    return values.groupBy("file_id", "row").agg(*(value(*f) for f in fields))


def consolidate(cells: DataFrame, files: DataFrame, words: Words | DataFrame, fields: list[tuple[str, str]], rules: products.Rules, ingested_at: str, settings: detect.Settings = detect.Settings()) -> Run:
    """One product's run over sheets.

    cells: as in detect, one chosen sheet a file. files: file_id, path, sheet, bank, produit, period,
    source_format. words: how headers resolve, or the aliases alone. fields: (name, type) in the
    facts' order; rules: how a field derives from others. A sheet without a table gives no facts, a note
    and all its rows below the header as dropped ones; an empty table of cells gives empty results.
    """
    words = words if isinstance(words, Words) else Words(words)
    lines = written(detect.headed(detect.filled(cells), vocabulary(words), settings), "rows")
    found = detect.headers(lines, vocabulary(words), settings)
    extent, spans = tables.observed(detect.extents(lines, found, settings), "extents", lines=F.coalesce(F.sum(F.col("data_end") - F.col("data_start") + 1), F.lit(0)))
    labels = detect.header_labels(lines, found)
    columns = detect.selected_columns(lines, labels, extent, settings)
    block = detect.with_text(detect.block(lines, extent))
    told = judged(mapped(columns, files, words), block, extent, words.expected)
    mappings, named = tables.observed(told, "mappings", columns=F.count("*"), to_review=F.count_if(audit.for_review()))
    dropped, left = tables.observed(detect.dropped_rows(lines, found, extent, settings), "dropped", blank=F.count_if(F.col("reason") == detect.BLANK))
    kinds = F.create_map(*(F.lit(x) for f in fields for x in f))
    chosen = mappings.where("won").select("file_id", "col", F.col("canonical").alias("field"), F.element_at(kinds, F.col("canonical")).alias("type")).where("type is not null")
    values = block.join(detect.of_file(chosen), ["file_id", "col"]).select("file_id", "row", "field", "type", "kind", "s", "n", "d", "shown")
    typed = coerce.typed(values)
    rows = records(typed, fields)
    for name, ways in rules.items():
        rows = facts.fill(rows, name, ways)
    own = rows.join(detect.of_file(files.select("file_id", F.col("path").alias("source_file"), F.col("sheet").alias("source_sheet"))), "file_id").withColumnRenamed("row", "source_row").drop("file_id")
    full = products.with_provenance(products.with_constants(own, detect.of_file(files)), [f for f, _ in fields], ingested_at)
    return Run(full, mappings, dropped, detect.dropped_columns(lines, labels, extent, settings), detect.notes(files, lines, found, extent), spans | named | left, files, extent.join(detect.of_file(found.select("file_id", "header_row")), "file_id"), detect.with_text(detect.cells_of(lines)), typed)


def vocabulary(words: Words) -> DataFrame:
    """norm: every alias that a header may be."""
    own = words.aliases.select(F.col("alias").alias("norm"))
    return own if words.dictionaries is None else own.union(words.dictionaries.select("alias"))
