"""Headers to fields: dictionaries first, then similarity, then conflicts and checks on content."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import similarity

ACCEPT, SUGGEST, TOP_ALIASES, TOP_FIELDS = 92.0, 70.0, 10, 3


def exact(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """headers with canonical, method and confidence where an alias is equal.

    headers: file_id, col, normalized, leaf, produit, bank. aliases: tier, scope, alias, canonical;
    tiers in order: product and bank (scope names the one or the other), global, seed. The whole header
    is looked up in every tier before its last part is. What no tier has may be an alias of the seed
    but for spaces.
    """
    ranks = {"product": 0, "bank": 1, "global": 2, "seed": 3}
    rank = F.element_at(F.create_map(*(F.lit(x) for p in ranks.items() for x in p)), F.col("tier"))
    table = aliases.select("scope", "alias", "canonical", "tier", rank.alias("rank"))
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    loose = table.where("tier = 'seed'").select("scope", squeezed(F.col("alias")).alias("alias"), "canonical", F.lit("seed_loose").alias("tier"), F.lit(4).alias("rank"))
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("normalized").alias("alias")), F.struct(F.lit(1).alias("part"), F.col("leaf").alias("alias")))
    keys = headers.select("file_id", "col", "produit", "bank", F.explode(parts).alias("k")).select("file_id", "col", "produit", "bank", "k.*").where("alias <> ''")
    held = F.when(F.col("tier") == "product", F.col("scope") == F.col("produit")).when(F.col("tier") == "bank", F.col("scope") == F.col("bank")).otherwise(F.col("scope").isNull())
    hits = keys.join(table, "alias").where(held).unionByName(keys.withColumn("alias", squeezed(F.col("alias"))).join(loose, "alias").where(held))
    best = hits.groupBy("file_id", "col").agg(F.min_by(F.struct("canonical", "tier"), F.struct("part", "rank", "canonical")).alias("m"))
    return headers.join(best.hint("merge"), ["file_id", "col"], "left").select(*headers.columns, F.col("m.canonical").alias("canonical"), F.col("m.tier").alias("method"), F.when(F.col("m").isNotNull(), 1.0).alias("confidence"))


def near_pairs(names: DataFrame, aliases: DataFrame, floor: float = SUGGEST) -> DataFrame:
    """normalized, alias, score of all pairs of distinct texts that score `floor` or more.

    names: normalized; aliases: alias. Pairs are met by the first elements of both (a pair once, by the
    first that it shares), and those whose lengths or common characters can't reach the floor go before
    any is scored, so what is scored is what scoring all pairs would keep and little more."""
    share = floor / 100
    chars = similarity.characters

    def prepared(t: DataFrame, name: str) -> DataFrame:
        words = similarity.sorted_words(F.col(name))
        own = t.select(name).where(f"{name} <> ''").distinct().select(name, chars(F.col(name)).alias("chars"), chars(words).alias("words"))
        return own.withColumn("parts", similarity.elements(F.col("chars"))).withColumn("first", similarity.prefix(F.col("parts"), share))

    left = prepared(names, "normalized").select("normalized", F.struct("chars", "words", "parts", "first").alias("a"), F.explode("first").alias("part"))
    known = prepared(aliases, "alias").withColumns({"mask": similarity.masks(F.col("chars")), "words_mask": similarity.masks(F.col("words"))})
    right = known.select("alias", F.struct("mask", "words_mask", "parts", "first").alias("b"), F.explode("first").alias("part"))
    met = left.join(right, "part").where(F.get(F.array_intersect("a.first", "b.first"), F.lit(0)) == F.col("part"))
    least = F.ceil(share * (F.size("a.parts") + F.size("b.parts")) / 2 - 1e-9)
    near = met.where((F.least(F.size("a.parts"), F.size("b.parts")) >= least) & (F.size(F.array_intersect("a.parts", "b.parts")) >= least))
    score = similarity.score(F.col("b.mask"), F.col("b.words_mask"), F.size("b.parts"), F.col("a.chars"), F.col("a.words"))
    return near.select("normalized", "alias", score.alias("score")).where(F.col("score") >= floor)


def fuzzy(unresolved: DataFrame, aliases: DataFrame) -> DataFrame:
    """file_id, col, canonical, score, suggestions of headers that no alias equals: of the nearest
    aliases the best of each field, and that of the best field where it is near enough."""
    scored = near_pairs(unresolved, aliases).join(aliases.select("alias", "canonical").distinct(), "alias")
    near = scored.withColumn("k", F.row_number().over(W.partitionBy("normalized").orderBy(F.desc("score"), "alias"))).where(F.col("k") <= TOP_ALIASES)
    fields = near.groupBy("normalized", "canonical").agg(F.max("score").alias("score"))
    top = fields.withColumn("k", F.row_number().over(W.partitionBy("normalized").orderBy(F.desc("score"), "canonical"))).where(F.col("k") <= TOP_FIELDS)
    lists = top.groupBy("normalized").agg(F.max_by("canonical", F.struct("score", -F.col("k"))).alias("best"), F.max("score").alias("score"), F.transform(F.sort_array(F.collect_list(F.struct("k", "canonical", "score"))), lambda x: F.struct(x["canonical"].alias("name"), x["score"].alias("score"))).alias("suggestions"))
    out = unresolved.join(lists, "normalized", "left")
    return out.select("file_id", "col", F.when(F.col("score") >= ACCEPT, F.col("best")).alias("canonical"), "score", "suggestions")


def settle(mappings: DataFrame) -> DataFrame:
    """mappings with won: of several columns on one field the surest, exact before near, the first of equals.

    mappings: file_id, col, canonical, method, confidence."""
    order = [F.desc("confidence"), F.col("method").isin("fuzzy", "model").asc(), F.asc("col")]
    place = F.row_number().over(W.partitionBy("file_id", "canonical").orderBy(*order))
    return mappings.withColumn("won", F.col("canonical").isNotNull() & (place == 1))


def override(mappings: DataFrame, chosen: DataFrame) -> DataFrame:
    """mappings with the given fields in place; `__ignore__` clears one. chosen: normalized, field."""
    ours = chosen.select("normalized", F.col("field").alias("_field"))
    joined = mappings.join(ours, "normalized", "left")
    cleared = F.nullif("_field", F.lit("__ignore__"))
    given = F.col("_field").isNotNull()
    swap = {"canonical": F.when(given, cleared).otherwise(F.col("canonical")), "method": F.when(given, "manual").otherwise(F.col("method")), "confidence": F.when(given, 1.0).otherwise(F.col("confidence"))}
    return joined.withColumns(swap).select(*mappings.columns)


def profiles(cells: DataFrame, total: DataFrame) -> DataFrame:
    """By file and column: counts, shares of numbers, dates and distinct values, bounds, mean length.

    cells: filled cells of the data rows with shown, number (double) and date; total: file_id, rows.
    """
    got = cells.groupBy("file_id", "col").agg(
        F.count("*").alias("non_blank"), F.count("number").alias("numbers"), F.count("date").alias("dates"), F.count_distinct("shown").alias("distinct"),
        F.min("number").alias("min_value"), F.max("number").alias("max_value"), F.avg(F.length("shown")).alias("mean_length"),
    )
    share = lambda c: F.col(c) / F.col("non_blank")
    return got.join(total.hint("merge"), "file_id").select("file_id", "col", F.col("rows").alias("total"), "non_blank", share("numbers").alias("numeric_ratio"), share("dates").alias("date_ratio"), share("distinct").alias("unique_ratio"), "min_value", "max_value", "mean_length")


def content_warnings(profile: DataFrame, expected: DataFrame) -> DataFrame:
    """profile rows with warnings (array). profile also has canonical; expected: canonical, mostly,
    min_value_due, max_value_due, min_unique, max_unique."""
    j = profile.join(expected, "canonical", "left")
    c = F.col
    some = c("non_blank") > 0
    return j.withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(some & (c("mostly") == "numeric") & (c("numeric_ratio") < 0.6), "too few numbers"),
                F.when(some & (c("mostly") == "date") & (c("date_ratio") < 0.6), "too few dates"),
                F.when(some & c("mostly").isin("text", "identifier") & (c("numeric_ratio") > 0.9) & (c("date_ratio") < 0.5), "numbers instead of text"),
                F.when(some & (c("min_value") < c("min_value_due")), "below the least value"),
                F.when(some & (c("max_value") > c("max_value_due")), "above the largest value"),
                F.when(some & (c("unique_ratio") < c("min_unique")), "too few distinct values"),
                F.when(some & (c("unique_ratio") > c("max_unique")), "too many distinct values"),
            )
        ),
    )
