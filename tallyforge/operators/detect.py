"""Tables in untyped sheets, by group-bys over cells and windows over rows.

cells: file_id, sheet, row, col (from 1), kind ('n' number, 's' text, 'b' boolean, 'd' date,
't' time), s (text), n (number), d (date). A file here is one sheet of a workbook that has been
chosen. Every row that is left out is reported with its place and reason.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import text

#: The shapes of text that count as data.
NUMBER_TEXT = r"^[\s(+\-]*[0-9][0-9\s.,]*\s*(%|€|\$|£|(?i)(da|dzd|dt|tnd|eur|usd|dh|mad))?\)?$"
DATE_TEXT = r"^[0-9]{1,4}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}$|^[0-9]{1,2}[\- /.]+[^0-9\s]{3,}[\- /.]+[0-9]{2,4}$"
#: Weights of a header row's shares.
WEIGHTS = {"vocab": 3.0, "label": 1.2, "unique": 0.8, "width": 1.0, "below_fill": 1.5, "below_data": 1.0, "wordy": -2.0}
BELOW_ROWS, WORDY, ANCHOR, SPARSE, LEAD_COLUMNS, SECOND_DATA = 7, 5, 0.9, 0.4, 3, 0.3

#: Columns that a row's mask holds, one bit each.
MASKED = 62

BLANK = "blank row inside table"


@dataclass(frozen=True)
class Settings:
    header_search_rows: int = 30
    blank_run: int = 2
    terminators: tuple[str, ...] = ("total", "sous total", "somme", "cumul", "totaux")
    min_column_fill: float = 0.05


def filled(cells: DataFrame) -> DataFrame:
    """The cells that aren't blank, as they are; with_text() has what they show."""
    blank = r"(?U)[^\s" + text.WIDE_SPACES + text.NO_WIDTH + "]"
    shows = F.when(F.col("s").isNotNull(), F.col("s").rlike(blank)).otherwise(F.col("n").isNotNull() | F.col("d").isNotNull())
    return cells.where(shows | F.col("kind").isin("b", "t"))


def with_text(cells: DataFrame) -> DataFrame:
    """cells with shown (text), norm (normalised) and data (looks like data)."""
    shown = F.coalesce(text.clean_spaces(F.col("s")), F.when(F.col("n").isNotNull(), text.identifier_of_number(F.col("n"))), F.col("d").cast("string"))
    data = F.col("kind").isin("n", "d", "t") | ((F.col("kind") == "s") & (F.col("shown").rlike(NUMBER_TEXT) | F.col("shown").rlike(DATE_TEXT)))
    # What a number or a date shows holds no other marks than these.
    plain = F.trim(F.lower(F.translate("shown", "+-.", "   ")))
    norm = F.when(F.col("s").isNotNull(), text.normalize_header(F.col("shown"))).otherwise(F.coalesce(plain, F.lit("")))
    return cells.withColumn("shown", shown).withColumns({"norm": norm, "data": F.coalesce(data, F.lit(False))})


def of_file(table: DataFrame) -> DataFrame:
    """A table with rows for each file, to be joined by a shuffle: it grows with the input, and its Parquet files
    are so much smaller than its rows that Spark would send it whole through the driver."""
    return table.hint("merge")


def dealt(table: DataFrame, by: str = "file_id") -> DataFrame:
    """table dealt by sheet over as many tasks as the session's shuffles have. Left to itself Spark goes by
    bytes, of which sheets have few, and merges partitions until about one a core is left: the last ones then
    run alone for as long as all before."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def in_order() -> WindowSpec:
    return W.partitionBy("file_id").orderBy("row")


def whole_sheet() -> WindowSpec:
    return in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def scored(cells: DataFrame, vocabulary: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Row records with before (the last row above that isn't blank) and, on the rows that can be headers,
    score and end: the last row of the header, two where the row repeats labels or has gaps that the next
    one fills, and the next one isn't data.

    One window over a sheet's rows puts the next ones beside each; columns that two rows share are counted
    by bits. Plain columns in place of an array of rows, since these are compiled."""
    order, n, places = in_order(), F.col("filled"), range(1, BELOW_ROWS + 1)
    near = F.struct("row", "mask", "data_mask", "beyond", "data_beyond")
    width = F.max(F.when(F.col("row") <= settings.header_search_rows, n)).over(whole_sheet())
    beside = {"before": F.lag("row").over(order), "width": width, "lower": F.lead(F.struct("row", "filled", "data", "cols")).over(order)} | {f"below_{k}": F.lead(near, k).over(order) for k in places}

    def shared(k: int, mask: str, beyond: str) -> Column:
        other = F.col(f"below_{k}.{beyond}")
        wide = F.when((F.size(other) > 0) & (F.size("beyond") > 0), F.size(F.array_intersect(other, F.col("beyond")))).otherwise(0)
        return F.bit_count(F.col(f"below_{k}.{mask}").bitwiseAND(F.col("mask"))) + wide

    every = {f"every_{k}": F.when(F.col(f"below_{k}.row") <= F.col("row") + BELOW_ROWS, shared(k, "mask", "beyond")).otherwise(0) for k in places}
    data = {f"data_{k}": F.when(F.col(f"every_{k}") > 0, shared(k, "data_mask", "data_beyond")).otherwise(0) for k in places}
    total = lambda one: sum((one(k) for k in places), F.lit(0))
    sums = {"hits": total(lambda k: (F.col(f"every_{k}") > 0).cast("int")), "all": total(lambda k: F.col(f"every_{k}")), "in_data": total(lambda k: F.col(f"data_{k}"))}
    summed = sheet_rows(cells, vocabulary).withColumns(beside).withColumns(every).withColumns(data).withColumns(sums)
    mean = lambda part: F.col(part) / F.col("hits")
    share = {"vocab": F.col("vocab") / n, "label": 1 - F.col("data") / n, "unique": F.col("unique") / n, "width": n / F.col("width"), "below_fill": mean("all") / n, "below_data": mean("in_data") / n, "wordy": F.col("wordy") / n}
    score = sum((F.lit(w) * share[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    lower = F.col("lower")
    incomplete = (n > F.col("unique")) | (F.size(F.array_except(lower["cols"], F.col("cols"))) > 0)
    two = (lower["row"] == F.col("row") + 1) & (lower["data"] / lower["filled"] < SECOND_DATA) & incomplete
    can = (F.col("row") <= settings.header_search_rows) & (n >= 2) & (F.col("hits") > 0)
    end = F.col("row") + F.coalesce(two, F.lit(False)).cast("int")
    return summed.withColumns({"score": F.when(can, score), "end": F.when(can, end)}).drop("width", "lower", *(f"below_{k}" for k in places), *every, *data, *sums)


def header_scores(cells: DataFrame, vocabulary: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """file_id, row, score of the rows that can be headers."""
    return scored(cells, vocabulary, settings).where("score is not null").select("file_id", "row", "score")


def headed(cells: DataFrame, vocabulary: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Row records with their sheet's header_row, header_end and score (of the best row, the first of equal
    ones, with a second one where it needs that; null without a header), before, and stop as bounded() has
    it. All windows go over a sheet's rows in their order, so they share a shuffle and a sort, and what
    reads these records needs neither a join nor a window for it. cells: of filled(), or their row records."""
    rows = scored(cells, vocabulary, settings)
    best = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("worse"), "row", "end"))).over(whole_sheet())
    told = rows.withColumn("best", best).withColumns({"header_row": F.col("best.row"), "header_end": F.col("best.end"), "score": -F.col("best.worse")})
    return bounded(told.drop("best", "end"), settings)


def headers(cells: DataFrame, vocabulary: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """file_id, header_row, header_end, score of the sheets that have a header. cells: of filled(), their row records, or those of headed()."""
    rows = cells if "stop" in cells.columns else headed(cells, vocabulary, settings)
    return rows.where("row = header_row").select("file_id", "header_row", "header_end", "score")


def header_labels(cells: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, col, header, parts, normalized, leaf: parts from top to bottom, equal neighbours once."""
    rows = with_headers(cells, found).where(F.col("row").between(F.col("header_row"), F.col("header_end"))).select("file_id", "row", "held")
    parts = with_text(cells_of(rows)).groupBy("file_id", "col").agg(F.sort_array(F.collect_list(F.struct("row", "shown", "norm"))).alias("p"))  # two at most
    once = F.filter("p", lambda x, k: (k == 0) | (x["norm"] != F.get(F.col("p"), k - 1)["norm"]))
    named = parts.select("file_id", "col", F.transform(once, lambda x: x["shown"]).alias("parts"))
    header = F.array_join("parts", " ")
    return named.select("file_id", "col", header.alias("header"), "parts", text.normalize_header(header).alias("normalized"), text.normalize_header(F.element_at("parts", -1)).alias("leaf"))


def is_terminator(norm: Column, settings: Settings) -> Column:
    return norm.rlike("^(" + "|".join(settings.terminators) + ")( |$)")


def sheet_rows(cells: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """One record for each row that isn't blank: file_id, row, filled, first_col, lead (norm of the first
    filled cell), cols, mask and beyond (cols up to MASKED as bits, and the others), data (cells that look
    like data), data_mask and data_beyond (their columns), unique (different norms), wordy (cells of many
    words), held (its cells by column) and, with a vocabulary, vocab (cells whose norm it has). What follows
    reads these, which are far fewer than cells; row records given here are returned as they are, with vocab
    if they lack it. cells: of filled(); vocabulary: norm, a table that fits in memory."""
    words = None if vocabulary is None else F.broadcast(vocabulary.select("norm").distinct().withColumn("known", F.lit(True)))
    if "lead" in cells.columns:
        if words is None or "vocab" in cells.columns:
            return cells
        known = cells.select("file_id", "row", F.explode("held.norm").alias("norm")).join(words, "norm").groupBy("file_id", "row").agg(F.count("*").cast("int").alias("vocab"))
        return cells.join(of_file(known), ["file_id", "row"], "left").withColumn("vocab", F.coalesce("vocab", F.lit(0)))
    told = with_text(cells.select("file_id", "row", "col", "kind", "s", "n", "d"))
    spaces = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))
    bit = F.when(F.col("col") <= MASKED, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("col") - 1)).otherwise(0)
    bits = lambda c: F.coalesce(F.bit_or(c), F.lit(0).cast("long"))
    told = told if words is None else told.join(words, "norm", "left")
    count = [] if words is None else [F.count_if("known").cast("int").alias("vocab")]
    own = told.groupBy("file_id", "row").agg(
        *count, F.sort_array(F.collect_list(F.struct("col", "norm", F.when(F.col("data"), F.col("col")).alias("data_col"), "kind", "s", "n", "d"))).alias("held"), F.count_if("data").cast("int").alias("data"), F.count_if(spaces >= WORDY).cast("int").alias("wordy"),
        bits(bit).alias("mask"), bits(F.when(F.col("data"), bit)).alias("data_mask"),
    )
    first, last = F.col("held")[0], F.element_at("held", -1)
    beyond = lambda c: F.when(last["col"] > MASKED, F.filter(c, lambda k: k > MASKED)).otherwise(F.array().cast("array<int>"))
    return own.select(
        "file_id", "row", F.size("held").alias("filled"), first["col"].alias("first_col"), first["norm"].alias("lead"), F.col("held.col").alias("cols"), "mask", beyond("held.col").alias("beyond"),
        "data", "data_mask", beyond("held.data_col").alias("data_beyond"), F.size(F.array_distinct("held.norm")).alias("unique"), "wordy", "held", *(["vocab"] if count else []),
    )


def cells_of(rows: DataFrame) -> DataFrame:
    """The cells of row records: file_id, row, col, kind, s, n, d."""
    return rows.select("file_id", "row", F.explode("held").alias("c")).select("file_id", "row", "c.col", "c.kind", "c.s", "c.n", "c.d")


def with_headers(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Row records with header_row and header_end, those of found; records of headed() have their own."""
    rows = sheet_rows(cells)
    if "stop" in rows.columns:
        return rows.where("header_row is not null")
    return dealt(rows).join(of_file(found.select("file_id", "header_row", "header_end")), "file_id")


def bounded(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows (with before and header_end) with stop: of the first row below the header that ends the table its
    row, and at, where the table ends; null if none does. A run of blank rows ends it, or a line by its first
    filled cell, if that is one of the first three columns."""
    above = F.greatest("before", "header_end")
    line = (F.col("first_col") <= LEAD_COLUMNS) & is_terminator(F.col("lead"), settings)
    at = F.when(F.col("row") > F.col("header_end"), F.when(F.col("row") - above > settings.blank_run, above + 1).when(line, F.col("row")))
    return rows.withColumn("at", at).withColumn("stop", F.min(F.when(F.col("at").isNotNull(), F.struct("row", "at"))).over(whole_sheet())).drop("at")


def placed(cells: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Row records of the sheets with a header, with header_row, header_end, before and stop."""
    rows = with_headers(cells, found)
    return rows if "stop" in rows.columns else bounded(rows.withColumn("before", F.lag("row").over(in_order())), settings)


def complete(anchors: Column, least: Column) -> tuple[Column, Column]:
    """Whether a row fills every column that nearly all rows fill, and whether it isn't far emptier than most."""
    return F.size(F.array_except(anchors, "cols")) == 0, F.col("filled") >= least


def extents(cells: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """file_id, data_start, data_end, cut (first row beyond), anchors, least: up to a terminator or a run
    of blank rows, then without the last rows that lack a column which nearly all rows fill (anchors), or
    have fewer than `least` cells. cells: of filled(), or their row records."""
    rows = placed(cells, found, settings).where((F.col("row") > F.col("header_end")) & (F.col("stop").isNull() | (F.col("row") < F.col("stop.row"))))
    kept = rows.select("file_id", "header_end", F.col("stop.at").alias("at"), "row", "filled", "cols")
    columns = kept.select("file_id", "header_end", "at", "row", F.explode("cols").alias("col")).groupBy("file_id", "header_end", "at", "col").agg(F.count("*").alias("n"), F.max("row").alias("last"))
    ends = columns.groupBy("file_id", "header_end", "at").agg(F.max("last").alias("last"), F.sum("n").alias("cells"), F.collect_list(F.struct("col", "n")).alias("c"))  # a sheet's columns are few
    size = F.col("last") - F.col("header_end")
    sized = ends.select("file_id", F.coalesce("at", F.col("last") + 1).alias("cut"), F.greatest(F.lit(2.0), SPARSE * F.col("cells") / size).alias("least"), size.alias("size"), "c")
    anchors = F.transform(F.filter("c", lambda x: x["n"] >= ANCHOR * F.col("size")), lambda x: x["col"])
    known = sized.select("file_id", "cut", "least", F.sort_array(anchors).alias("anchors"))
    whole, dense = complete(F.col("anchors"), F.col("least"))
    last = dealt(kept.select("file_id", "header_end", "row", "filled", "cols")).join(of_file(known), "file_id").where(whole & dense)
    return last.groupBy("file_id").agg((F.first("header_end") + 1).alias("data_start"), F.max("row").alias("data_end"), *(F.first(c).alias(c) for c in ("cut", "anchors", "least")))


def dropped_rows(cells: DataFrame, found: DataFrame, extent: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """file_id, row, reason of the rows outside the table, and blank ones within. A sheet with a header
    and no record beneath has all its rows below reported."""
    rows = placed(cells, found, settings).select("file_id", "row", "cols", "header_row", "header_end", "before")
    told = dealt(rows).join(of_file(extent.select("file_id", "data_end", "cut", "anchors")), "file_id", "left")
    row, above = F.col("row"), F.greatest("before", "header_end")
    lacks = F.size(F.array_except("anchors", "cols")) > 0
    reason = (
        F.when(row < F.col("header_row"), "above the header row")
        .when(row >= F.col("cut"), "beyond the end of the table")
        .when((row > F.col("data_end")) & lacks, "missing identifying columns")
        .when(row > F.col("data_end"), "too sparse to be a record")
        .when(F.col("cut").isNull() & (row > F.col("header_end")), "no record beneath the header")
    )
    # A row is left out, or stands in the table below blank ones, or neither.
    blank = (row > F.col("header_end")) & (row <= F.col("data_end")) & (row - above > 1)
    left = told.withColumn("reason", reason).where(F.col("reason").isNotNull() | blank)
    outside = F.col("reason").isNotNull()
    return left.select("file_id", F.explode(F.when(outside, F.array("row")).otherwise(F.sequence(above + 1, row - 1))).alias("row"), F.coalesce("reason", F.lit(BLANK)).alias("reason"))


def filled_columns(cells: DataFrame, labels: DataFrame, extent: DataFrame) -> DataFrame:
    """labels and every column that the block fills, with fill: its share of the block's rows."""
    rows = dealt(sheet_rows(cells).select("file_id", "row", "cols")).join(of_file(extent.select("file_id", "data_start", "data_end")), "file_id").where(F.col("row").between(F.col("data_start"), F.col("data_end")))
    fill = rows.select("file_id", F.explode("cols").alias("col"), (F.col("data_end") - F.col("data_start") + 1).alias("rows")).groupBy("file_id", "col").agg((F.count("*") / F.first("rows")).alias("fill"))
    own = labels.join(of_file(extent.select("file_id")), "file_id", "left_semi")  # a sheet without a block has no columns to judge
    return fill.join(of_file(own), ["file_id", "col"], "full")


def selected_columns(cells: DataFrame, labels: DataFrame, extent: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """labels of the columns that stay, with fill (share of the block's rows): not empty, and filled enough if they have no name."""
    named = F.coalesce("normalized", F.lit("")) != ""
    return filled_columns(cells, labels, extent).where(F.col("fill").isNotNull() & (named | (F.col("fill") >= settings.min_column_fill)))


def dropped_columns(cells: DataFrame, labels: DataFrame, extent: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """file_id, col, letter, header, reason of the columns that selected_columns() leaves out."""
    every = filled_columns(cells, labels, extent)
    named = F.coalesce("normalized", F.lit("")) != ""
    reason = F.when(F.col("fill").isNull(), "empty in data block").when(~named & (F.col("fill") < settings.min_column_fill), F.format_string("no header and only %d%% filled", F.rint(F.col("fill") * 100).cast("int")))
    return every.select("file_id", "col", text.column_letter(F.col("col")).alias("letter"), F.coalesce("header", F.lit("")).alias("header"), reason.alias("reason")).where("reason is not null")


def uncached_columns(cells: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """file_id, col, label of the columns with formulas below the header that have no value; the column's
    letter where it has no header. cells: as the reader gives them, since these cells show nothing."""
    below = cells.where(F.col("is_formula") & ~F.col("cached")).select("file_id", "row", "col").join(found.select("file_id", "header_end"), "file_id").where("row > header_end")
    named = below.select("file_id", "col").distinct().join(labels.select("file_id", "col", "header"), ["file_id", "col"], "left")
    return named.select("file_id", "col", F.coalesce(F.nullif("header", F.lit("")), text.column_letter(F.col("col"))).alias("label"))


def notes(files: DataFrame, cells: DataFrame, found: DataFrame, extent: DataFrame) -> DataFrame:
    """file_id, note of the sheets that give no table, and why. files: file_id of all sheets that were read."""
    seen = lambda t, name: t.select("file_id").distinct().withColumn(name, F.lit(True)).hint("merge")
    joined = files.select("file_id").distinct().join(seen(cells, "any"), "file_id", "left").join(seen(found, "head"), "file_id", "left").join(seen(extent, "body"), "file_id", "left")
    note = F.when(F.col("any").isNull(), "sheet is empty").when(F.col("head").isNull(), "no plausible header row found").when(F.col("body").isNull(), "header found but no data rows beneath it")
    return joined.select("file_id", note.alias("note")).where("note is not null")


def block_rows(rows: DataFrame, extent: DataFrame) -> DataFrame:
    """The data rows of row records, or of cells."""
    return rows.join(of_file(extent.select("file_id", "data_start", "data_end")), "file_id").where(F.col("row").between(F.col("data_start"), F.col("data_end"))).drop("data_start", "data_end")


def block(cells: DataFrame, extent: DataFrame) -> DataFrame:
    """The cells of the data rows. cells: of filled(), or their row records."""
    return cells_of(block_rows(cells.select("file_id", "row", "held"), extent)) if "lead" in cells.columns else block_rows(cells, extent)


def choose_sheets(cells: DataFrame, preference: DataFrame | None = None, rows: int = 200) -> DataFrame:
    """path, sheet: a preferred sheet if there is one (in workbook order), else that with the most cells in its first rows, the first of equals.

    cells: path, sheet, sheet_index, row. preference: path, sheet (any case)."""
    sizes = cells.groupBy("path", "sheet", "sheet_index").agg(F.count_if(F.col("row") <= rows).alias("n"))
    if preference is not None:
        liked = preference.select(F.col("path").alias("p"), F.lower("sheet").alias("name"), F.lit(True).alias("liked")).distinct()
        sizes = sizes.join(liked, (F.col("path") == F.col("p")) & (F.lower("sheet") == F.col("name")), "left").drop("p", "name")
    else:
        sizes = sizes.withColumn("liked", F.lit(None).cast("boolean"))
    rank = F.struct(F.col("liked").isNull(), F.when(F.col("liked").isNull(), -F.col("n")).otherwise(0), "sheet_index")
    return sizes.groupBy("path").agg(F.min_by("sheet", rank).alias("sheet"))


def expand_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """cells with each merged range filled from its first cell. ranges: file_id, r0, c0, r1, c1."""
    down = ranges.select(F.col("file_id").alias("range_id"), "r0", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("new_row"))
    spread = down.select("range_id", "r0", "c0", "new_row", F.explode(F.sequence("c0", "c1")).alias("new_col"))
    first = spread.join(cells, (F.col("file_id") == F.col("range_id")) & (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0")))
    copied = first.select(*(F.col({"row": "new_row", "col": "new_col"}.get(c, c)).alias(c) for c in cells.columns))
    own = cells.join(copied.select("file_id", "row", "col"), ["file_id", "row", "col"], "left_anti").select(*cells.columns)
    return own.unionByName(copied)
