"""Plans for a whole table: columns whose headers stand beside their values.

A header row that has slipped sideways gives every column its neighbour's field. One header alone can't
tell; the table can: moved by the right number of columns, the fields fit what the columns hold.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import resolve

#: How sure a proposal must be, and how sure all must be where nothing was wrong before.
FLOOR, SURE = 0.70, 0.90
#: Columns that a header row may have slipped by.
SPAN = 3


def proposals(mappings: DataFrame, profile: DataFrame, expected: DataFrame, span: int = SPAN) -> DataFrame:
    """file_id, col, field, confidence, warnings: for each table the shift of its fields by up to `span`
    columns that fits its columns best; nothing where that is none.

    mappings: file_id, col, canonical. profile: as of resolve.profiles(); expected: as in
    resolve.content_warnings(). Every field moves by the same number of columns and must meet a column
    that holds something; the best shift has the fewest warnings, then the fewest steps, then goes
    right. confidence is the share of the moved fields that fit without a warning."""
    moves = mappings.where("canonical is not null").select("file_id", F.col("col").alias("from"), "canonical", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("by"))
    placed = moves.withColumn("col", F.col("from") + F.col("by")).join(profile, ["file_id", "col"], "left")
    told = resolve.content_warnings(placed, expected).withColumn("n", F.when(F.coalesce("non_blank", F.lit(0)) == 0, 1).otherwise(F.size("warnings")))
    totals = told.groupBy("file_id", "by").agg(F.sum("n").alias("total"), F.avg((F.col("n") == 0).cast("double")).alias("fit"), F.count_if(F.col("non_blank").isNull()).alias("outside"))
    best = totals.where("outside = 0").groupBy("file_id").agg(F.min_by(F.struct("by", "fit"), F.struct("total", F.abs("by"), -F.col("by"))).alias("b")).where("b.by <> 0")
    chosen = told.join(best, "file_id").where("by = b.by")
    given = chosen.select("file_id", "col", F.col("canonical").alias("field"), F.col("b.fit").alias("confidence"), "warnings")
    left = moves.where("by = 0").select("file_id", F.col("from").alias("col")).join(given.select("file_id", "col"), ["file_id", "col"], "left_anti").join(best, "file_id")
    return given.unionByName(left.select("file_id", "col", F.lit(None).cast("string").alias("field"), F.col("b.fit").alias("confidence"), F.array().cast("array<string>").alias("warnings")))


def accept(mappings: DataFrame, proposed: DataFrame, candidates: list[str] | None = None, floor: float = FLOOR) -> DataFrame:
    """mappings with the plans that are complete, unique and safer in place, and planned: whether a row was changed.

    mappings: file_id, col, canonical, method, confidence, warnings (array). proposed: file_id, col,
    field (null: none), confidence, warnings (that the column would have). A proposal below the floor, for
    a column or a field (of candidates) that there isn't, or for what the column has already is none.
    A table's plan holds if no field is then claimed twice and the warnings of its columns get fewer; or,
    where there were none, if it names as many columns as had fields and is sure of each. Several
    proposals for one column: the surest, then the first by name."""
    words = F.array().cast("array<string>")
    once = proposed.groupBy("file_id", "col").agg(F.max_by(F.struct(F.col("field"), F.col("confidence").alias("sure"), F.coalesce("warnings", words).alias("told")), F.struct("confidence", F.col("field").isNull(), F.coalesce("field", F.lit("")))).alias("p"), F.lit(True).alias("named"))
    both = mappings.join(once, ["file_id", "col"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    known = F.lit(True) if candidates is None else F.col("p.field").isNull() | F.col("p.field").isin(*candidates)
    changed = F.col("named") & known & (F.col("p.sure") >= floor) & ~F.col("p.field").eqNullSafe(F.col("canonical"))
    marked = both.withColumn("changed", F.coalesce(changed, F.lit(False)))
    marked = marked.withColumns({"claim": F.when(F.col("changed"), F.col("p.field")).otherwise(F.col("canonical")), "was": F.size(F.coalesce("warnings", words)), "will": F.when(F.col("changed"), F.size("p.told")).otherwise(F.size(F.coalesce("warnings", words)))})
    had = F.col("canonical").isNotNull()
    sums = marked.groupBy("file_id").agg(
        F.count_if("changed").alias("changes"), F.count("claim").alias("claims"), F.count_distinct("claim").alias("different"), F.sum(F.when(had, F.col("was")).otherwise(0)).alias("before"),
        F.sum(F.when(had | F.col("changed"), F.col("will")).otherwise(0)).alias("after"), F.count_if(had).alias("fields"),
    )
    offered = proposed.groupBy("file_id").agg(F.count("*").alias("offers"), F.min("confidence").alias("least"))
    sure = (F.col("before") == 0) & (F.col("offers") >= F.col("fields")) & (F.col("least") >= SURE)
    holds = (F.col("changes") > 0) & (F.col("claims") == F.col("different")) & ((F.col("after") < F.col("before")) | sure)
    plans = sums.join(offered, "file_id").where(holds).select("file_id", F.lit(True).alias("holds"))
    done = marked.join(plans, "file_id", "left").withColumn("planned", F.col("changed") & F.coalesce("holds", F.lit(False)))
    swap = {"canonical": "p.field", "method": F.lit("model-table"), "confidence": "p.sure", "warnings": "p.told"}
    new = {c: F.when(F.col("planned"), F.col(v) if isinstance(v, str) else v).otherwise(F.col(c)) for c, v in swap.items()}
    return done.withColumns(new).select(*mappings.columns, "planned")
