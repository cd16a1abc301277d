"""Registered queries on products, formats and audit tables, each with its SQL."""

from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import audit, detect, facts, formats, products, resolve, review, shift
from tallyforge.plans import consolidate
from tallyforge.plans.catalogue import GRID_SQL, grid, query, sheet_tables
from tallyforge.plans.sales import sales, table

FIELDS = [("num_contrat", "string"), ("prime_totale", "double"), ("capital_assure", "double"), ("frais", "double")]
RULES = {"prime_totale": [("sum", ["prime_nette", "frais"])], "prime_nette": [("difference", ["prime_totale", "frais"])]}


@query(
    """SELECT source_file, num_contrat, CAST(prime_totale AS DOUBLE) AS prime_totale, CAST(NULL AS DOUBLE) AS capital_assure, CAST(frais AS DOUBLE) AS frais,
       banque AS bank_of_file, mois_reception AS period_of_file, CAST(substr(mois_reception, 1, 4) AS INTEGER) AS annee FROM sales""",
    on_sales=True,
)
def product_projection(spark, sf_dir):
    """Only what the product needs is read, its missing field is null, and the file's constants join in."""
    raw = sales(spark, sf_dir)
    need = [c for c in products.needed([f for f, _ in FIELDS], RULES) if c in raw.columns]
    files = raw.groupBy(F.col("source_file").alias("path")).agg(F.min("banque").alias("bank"), F.min("mois_reception").alias("period"), F.lit("p").alias("produit"), F.lit(None).cast("string").alias("source_format"))
    own = products.projected(raw.select("source_file", *need), [("source_file", "string"), *FIELDS])
    out = products.with_constants(own, files)
    return out.select("source_file", *(f for f, _ in FIELDS), F.col("banque").alias("bank_of_file"), F.col("mois_reception").alias("period_of_file"), "annee")


@query(
    """SELECT source_file, field FROM (SELECT source_file, unnest(['date_effet', 'prime_totale', 'source_format']) AS field,
         unnest([count(date_effet), count(prime_totale), count(source_format)]) AS n FROM sales GROUP BY source_file) WHERE n = 0""",
    on_sales=True,
)
def required_missing_in_file(spark, sf_dir):
    return products.missing_fields(sales(spark, sf_dir), ["date_effet", "prime_totale", "source_format"])


@query(
    """SELECT source_file, 'prime_totale: ' || count(*) FILTER (prime_totale IS NULL AND prime_nette IS NOT NULL AND frais IS NOT NULL) || ' of ' || count(*) || ' values computed as sum(prime_nette, frais)' AS message
       FROM sales GROUP BY source_file HAVING count(*) FILTER (prime_totale IS NULL AND prime_nette IS NOT NULL AND frais IS NOT NULL) > 0""",
    on_sales=True,
)
def derived_count_messages(spark, sf_dir):
    filled = facts.fill(sales(spark, sf_dir), "prime_totale", RULES["prime_totale"])
    return products.derived_messages(filled, "prime_totale", *RULES["prime_totale"][0])


@query("SELECT p_brand AS famille, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS produits FROM part GROUP BY p_brand")
def products_by_family(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("famille"), F.col("p_type").alias("produit"))
    return products.by_family(p).select("famille", F.array_join("produits", "|").alias("produits"))


@query(
    """SELECT alias, arg_min(name, place) AS canonical FROM (
         SELECT p_partkey AS place, p_name AS name, unnest([lower(p_name), lower(p_brand), lower(p_type)]) AS a FROM part WHERE p_size % 5 <> 0) t,
         LATERAL (SELECT trim(regexp_replace(regexp_replace(a, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS alias) GROUP BY alias"""
)
def seed_alias_table(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.col("p_brand").alias("label"), F.array("p_type").alias("aliases"), F.when(F.col("p_size") % 5 == 0, "auto").alias("scope"))
    return products.seed_aliases(p)


@query(
    """SELECT path, CASE WHEN k % 5 = 0 THEN 'd6' WHEN k % 5 = 1 THEN 't24' END AS source_format, CASE WHEN k % 5 = 2 THEN 'several formats fit: any, t24' END AS error
       FROM (SELECT o_orderkey AS k, 'root/' || o_custkey || '/' || CASE o_orderkey % 5 WHEN 0 THEN 'P_ADE_' || o_orderkey || '_D6' WHEN 1 THEN 'c-ade ' || o_orderkey || ' T24' WHEN 2 THEN 'Q_ADE_' || o_orderkey || '_T24' WHEN 3 THEN 'P_ADE_' || o_orderkey || '_D6' ELSE 'P_ADE_' || o_orderkey || '_D66' END || '.xlsx' AS path FROM orders)"""
)
def format_detection(spark, sf_dir):
    k = F.col("o_orderkey")
    s = k.cast("string")
    names = [F.concat(F.lit("P_ADE_"), s, F.lit("_D6")), F.concat(F.lit("c-ade "), s, F.lit(" T24")), F.concat(F.lit("Q_ADE_"), s, F.lit("_T24")), F.concat(F.lit("P_ADE_"), s, F.lit("_D6")), F.concat(F.lit("P_ADE_"), s, F.lit("_D66"))]
    name = F.element_at(F.array(*names), (k % 5 + 1).cast("int"))
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("root/"), F.col("o_custkey").cast("string"), F.lit("/"), name, F.lit(".xlsx")).alias("path"), F.when(k % 5 == 3, "auto").otherwise("ade").alias("produit"))
    known = spark.createDataFrame([("ade", "d6", "[pc] ade [0-9]+ d6"), ("ade", "t24", "[pcq] ade [0-9]+ t24"), ("ade", "any", "q ade .*"), ("vie", "v", ".*")], "produit string, format string, pattern string")
    return formats.detect(files, known)


@query(
    """SELECT c_custkey AS file_id, CASE WHEN c_custkey % 2 = 0 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'prime_totale' WHEN 'MACHINERY' THEN 'frais' WHEN 'AUTOMOBILE' THEN 'num_contrat' END
         ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'agence' END END AS canonical FROM customer"""
)
def format_dictionary(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    headers = c.select(F.col("c_custkey").alias("file_id"), F.lit(1).alias("col"), F.when(F.col("c_custkey") % 2 == 0, "d6").otherwise("t24").alias("source_format"), F.when(F.col("c_mktsegment") == "AUTOMOBILE", "contrat automobile").otherwise(F.lower("c_mktsegment")).alias("normalized"), F.lower("c_mktsegment").alias("leaf"))
    own = spark.createDataFrame([("d6", "building", "prime_totale"), ("d6", "machinery", "frais"), ("d6", "automobile", "num_contrat"), ("t24", "building", "agence")], "source_format string, alias string, canonical string")
    return formats.dictionary(headers, own).select("file_id", "canonical")


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 0.0 ELSE least(1.0, greatest(0.0, value / 100)) END AS share FROM events"""
)
def clamped_share(spark, sf_dir):
    value = F.when(F.col("event_type") == "click", "none").otherwise((F.col("value") / 100).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", audit.clamp(value).alias("share"))


@query(
    """SELECT o_custkey AS file_id, o_orderkey AS "row", array_to_string(list_slice(list_filter([substr(o_orderstatus, 1, 20), substr(o_orderpriority, 1, 20), CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE substr(CAST(o_custkey AS VARCHAR) || ' customer of the order', 1, 20) END, 'x', 'never shown unless one is blank'[1:20]], lambda x: x IS NOT NULL), 1, 4), ' | ') AS preview FROM orders"""
)
def row_preview(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shown = F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(" customer of the order"))), F.lit("x"), F.lit("never shown unless one is blank"))
    return audit.preview(o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("row"), F.posexplode(shown).alias("col", "shown")))


@query(
    """SELECT o_custkey AS file_id, o_orderkey AS col, CASE WHEN k = 1 THEN o_orderstatus END AS canonical, CASE WHEN k > 1 THEN 'another column has ' || o_orderstatus ELSE '' END AS warnings, CASE WHEN k > 1 THEN o_orderstatus ELSE '' END AS suggestions
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 0.95 ELSE 1.0 END DESC, o_orderkey) AS k FROM orders)"""
)
def conflict_warnings(spark, sf_dir):
    near = F.col("o_orderkey") % 3 == 0
    none = F.array().cast("array<string>")
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("col"), F.col("o_orderstatus").alias("canonical"), F.when(near, "fuzzy").otherwise("seed").alias("method"), F.when(near, 0.95).otherwise(1.0).alias("confidence"), none.alias("warnings"), none.alias("suggestions"))
    out = audit.losers(resolve.settle(claims))
    return out.select("file_id", "col", "canonical", F.array_join("warnings", ", ").alias("warnings"), F.array_join("suggestions", ", ").alias("suggestions"))


@query(
    """SELECT c.c_custkey AS path, CASE WHEN c_custkey % 11 = 0 OR n IS NULL THEN 'erreur' WHEN r > 0 THEN 'à vérifier' ELSE 'ok' END AS statut, coalesce(n, 0) AS columns, coalesce(f, 0) AS resolved, coalesce(r, 0) AS to_review, coalesce(d, 0) AS dropped
       FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS f, count(*) FILTER (o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 7 = 0)) AS r, count(*) FILTER (o_orderkey % 2 = 0) AS d FROM orders GROUP BY 1) o ON o_custkey = c_custkey"""
)
def audit_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mappings = o.select(F.col("o_custkey").alias("path"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("canonical"), F.array().cast("array<string>").alias("warnings"), F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 7 == 0), "model").otherwise("seed").alias("method"))
    rows = o.groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("n_rows"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.when(F.col("c_custkey") % 11 == 0, "unreadable").alias("error")).join(rows, "path", "left")
    return audit.summary(files, mappings, o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("path"))).drop("error")


def review_files(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("file_id"), F.concat(F.lit("in/"), k.cast("string"), F.lit(".xlsx")).alias("path"), F.lit("Ventes").alias("sheet"), F.col("c_mktsegment").alias("bank"), F.when(k % 4 != 0, "ade").alias("produit"),
        F.lit("folder").alias("produit_method"), F.when(k % 6 != 0, "2024-03").alias("period"), F.lit("name").alias("period_method"), F.when(k % 11 == 0, "unreadable").alias("error"),
    )


def review_claims(spark, sf_dir):
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("header"), F.when(k % 5 == 0, "").otherwise(F.lower("o_orderpriority")).alias("normalized"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("canonical"),
        F.when(k % 3 == 0, "fuzzy").otherwise("seed").alias("method"), F.when(k % 3 == 0, 0.954).otherwise(1.0).alias("confidence"), F.lit(None).cast("string").alias("reason"), F.when(k % 7 == 0, F.array(F.lit("odd"), F.lit("few"))).otherwise(none).alias("warnings"), F.when(k % 7 == 1, F.array("o_orderstatus")).alias("suggestions"),
    )


REVIEW_FILE = "c_custkey || '.xlsx' AS fichier, c_mktsegment AS banque"


@query(
    f"""SELECT {REVIEW_FILE}, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'ade' END AS produit, 'folder' AS produit_detecte, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE '2024-03' END AS mois_reception, 'name' AS periode_source, 'Ventes' AS feuille,
        CASE WHEN n > 0 THEN 1 END AS ligne_entete, CASE WHEN n > 0 THEN 2 END AS premiere_ligne, 1 + n AS derniere_ligne, coalesce(n, 0) AS lignes_gardees, coalesce(out, 0) AS lignes_supprimees, coalesce(n, 0) AS colonnes_gardees, coalesce(gone, 0) AS colonnes_supprimees,
        coalesce(open, 0) AS entetes_non_resolus, coalesce(derived, '') AS champs_calcules, coalesce(missing, '') AS champs_requis_absents, CASE WHEN c_custkey % 11 = 0 THEN 'erreur' WHEN r THEN 'à vérifier' ELSE 'ok' END AS statut,
        CASE WHEN c_custkey % 11 = 0 THEN 'unreadable' WHEN c_custkey % 10 = 0 THEN 'another sheet; sheet is empty' ELSE '' END AS note
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS out, count(*) FILTER (o_orderkey % 3 = 0) AS gone, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 5 <> 0) AS open,
          bool_or(o_orderkey % 5 <> 0 AND (o_orderstatus = 'P' OR o_orderkey % 7 = 0)) AS r, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (o_orderkey % 9 = 0) AS derived,
          string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) FILTER (o_orderkey % 4 = 0) AS missing FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def review_of_files(spark, sf_dir):
    """All 19 columns of a run's file summary."""
    o, files = table(spark, sf_dir, "orders").withColumn("file_id", F.col("o_custkey")), review_files(spark, sf_dir)
    own = o.groupBy("file_id").agg(F.count("*").alias("n_rows"))
    spans = own.select("file_id", F.lit(1).alias("header_row"), F.lit(2).alias("data_start"), (F.col("n_rows") + 1).alias("data_end"))
    notes = files.where("file_id % 10 = 0").select("file_id", F.explode(F.array(F.lit("sheet is empty"), F.lit("another sheet"))).alias("note"))
    missing, derived = o.where("o_orderkey % 4 = 0").select("file_id", F.col("o_orderstatus").alias("field")), o.where("o_orderkey % 9 = 0").select("file_id", F.col("o_orderpriority").alias("field"))
    return review.files_reviewed(files.join(own, "file_id", "left"), spans, review_claims(spark, sf_dir), o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), missing, derived, notes)


@query(
    f"""SELECT {REVIEW_FILE}, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'ade' END AS produit, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE '2024-03' END AS mois_reception, o_orderpriority AS en_tete, lower(o_orderpriority) AS en_tete_normalise,
        CASE WHEN o_orderstatus = 'P' THEN '(non résolu)' ELSE o_orderstatus END AS champ, CASE WHEN o_orderkey % 3 = 0 THEN 'fuzzy' ELSE 'seed' END AS methode, CASE WHEN o_orderkey % 3 = 0 THEN 0.95 ELSE 1.0 END::DOUBLE AS confiance, '' AS raison,
        CASE WHEN o_orderkey % 7 = 0 THEN 'odd; few' ELSE '' END AS avertissements, CASE WHEN o_orderkey % 7 = 1 THEN o_orderstatus ELSE '' END AS suggestions
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0"""
)
def review_of_mappings(spark, sf_dir):
    return review.mappings_reviewed(review_files(spark, sf_dir), review_claims(spark, sf_dir))


@query(
    f"""SELECT {REVIEW_FILE}, 'ligne' AS type, 'ligne ' || o_orderkey AS position, o_orderstatus AS motif, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END, '') AS contenu FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0
        UNION ALL SELECT {REVIEW_FILE}, 'colonne', 'colonne B', 'empty in data block', c_name FROM customer WHERE c_custkey % 3 = 0"""
)
def review_of_dropped(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("reason"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("preview"))
    columns = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("file_id"), F.lit("B").alias("letter"), F.lit("empty in data block").alias("reason"), F.col("c_name").alias("header"))
    return review.dropped_reviewed(review_files(spark, sf_dir), rows, columns)


@query(
    f"""SELECT {REVIEW_FILE}, 'f' || l_linenumber AS en_tete, 'money' AS type_cible, ',' AS separateur_decimal, count(*) FILTER (l_returnflag = 'N') AS converties, count(*) FILTER (l_returnflag = 'R') AS vides, count(*) FILTER (l_returnflag = 'A') AS echecs,
        CAST(round_even(100 * count(*) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag <> 'R'), 0) AS INTEGER) || '%' AS taux_echec,
        array_to_string(list_slice(list('no ' || l_partkey ORDER BY l_orderkey, 'no ' || l_partkey) FILTER (l_returnflag = 'A'), 1, 5), ', ') AS exemples
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, l_linenumber HAVING count(*) FILTER (l_returnflag = 'A') > 0"""
)
def review_of_coercions(spark, sf_dir):
    flag, owner = F.col("l_returnflag"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("file_id"))
    shown = F.when(flag == "A", F.concat(F.lit("no "), F.col("l_partkey").cast("string"))).when(flag == "R", " ").otherwise(F.col("l_quantity").cast("string"))
    lines = table(spark, sf_dir, "lineitem").join(owner, "l_orderkey")
    values = lines.select("file_id", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_orderkey").alias("row"), F.lit("money").alias("type"), shown.alias("shown"), F.lit(None).cast("string").alias("text_value"), F.when(flag == "N", F.col("l_quantity").cast("double")).alias("number_value"), F.lit(None).cast("date").alias("date_value"))
    return review.coercions_reviewed(review_files(spark, sf_dir), review.conversions(values).withColumns({"header": F.col("field"), "separator": F.lit(",")}))


@query(
    """SELECT source_file, source_row, num_contrat, '2025-01-31T00:00:00' AS ingested_at, substr(sha256(source_file || '::' || coalesce(num_contrat, '') || '|' || coalesce(CAST(date_effet AS VARCHAR), '') || '|' || coalesce(CAST(prime_totale AS VARCHAR), '')), 1, 16) AS row_hash FROM sales""",
    on_sales=True,
)
def provenance_columns(spark, sf_dir):
    out = products.with_provenance(sales(spark, sf_dir), ["num_contrat", "date_effet", "prime_totale"], "2025-01-31T00:00:00")
    return audit.facts_in_order(out).select("source_file", "source_row", "num_contrat", "ingested_at", "row_hash")


@query("SELECT c_mktsegment AS header, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, header LIMIT 3")
def most_common_headers(spark, sf_dir):
    return audit.most_common(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("header")).agg(F.count("*").alias("n")), 3)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true WHEN doc_id % 4 = 1 THEN true ELSE false END AS like_date FROM documents")
def date_likeness(spark, sf_dir):
    k = F.col("doc_id") % 4
    cells = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "d").when(k == 3, "n").otherwise("s").alias("kind"), F.when(k == 1, "31/12/2024").when(k == 2, "31/02/2024").alias("s"))
    return cells.select("doc_id", dates.like_date(F.col("kind"), F.col("s")).alias("like_date"))


@query(f"WITH {GRID_SQL} SELECT f AS file_id, count(*) AS kept, CAST(0 AS BIGINT) AS dropped, count(*) AS due FROM o GROUP BY f")
def rows_conserved(spark, sf_dir):
    """Of every sheet: rows kept, dropped within the table, and what they must add up to."""
    rows, found, extent = sheet_tables(spark, sf_dir)
    return audit.conserved(detect.block_rows(rows, extent), detect.dropped_rows(rows, found, extent), extent)


#: Sheets with f % 4 = 0 have no total premium, those with f % 5 = 0 spell the net premium otherwise.
def run_over_grid(spark, sf_dir) -> consolidate.Run:
    f = F.col("file_id")
    cells = grid(spark, sf_dir).where(~((f % 4 == 0) & (F.col("col") == 5) & (F.col("kind") == "n")))
    cells = cells.withColumn("s", F.when((F.col("s") == "Prime nette") & (f % 5 == 0), "Prime nettes").otherwise(F.col("s")))
    files = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("file_id"), F.concat(F.lit("in/"), F.col("c_custkey").cast("string"), F.lit(".xlsx")).alias("path"), F.lit("Ventes").alias("sheet"),
        F.col("c_mktsegment").alias("bank"), F.lit("ade").alias("produit"), F.lit("2024-03").alias("period"), F.lit(None).cast("string").alias("source_format"),
    )
    named = [("n contrat", "num_contrat"), ("date d effet", "date_effet"), ("prime nette", "prime_nette"), ("frais", "frais"), ("prime totale", "prime_totale")]
    aliases = spark.createDataFrame([("seed", None, a, c) for a, c in named], "tier string, scope string, alias string, canonical string")
    fields = [("num_contrat", "identifier"), ("date_effet", "date"), ("prime_nette", "money"), ("frais", "money"), ("prime_totale", "money"), ("agence", "text")]
    return consolidate.consolidate(cells, files, aliases, fields, {"prime_totale": RULES["prime_totale"]}, "2025-01-31T00:00:00")


@query(
    f"""WITH {GRID_SQL} SELECT 'in/' || f || '.xlsx' AS source_file, CAST(f % 3 + i + 3 AS INTEGER) AS source_row, 'C-' || o_orderkey AS num_contrat, CAST(o_orderdate AS DATE) AS date_effet,
        CAST(o_totalprice AS DOUBLE) AS prime_nette, 5.0::DOUBLE AS frais, CAST(round((o_totalprice + 5) * 100) AS BIGINT) AS total_cents, CASE WHEN f % 4 = 0 THEN 'derived' ELSE 'reported' END AS prime_totale_source,
        CAST(NULL AS VARCHAR) AS agence, c_mktsegment AS banque, '2024-03' AS mois_reception, 2024 AS annee FROM o JOIN customer ON c_custkey = f"""
)
def consolidated_facts(spark, sf_dir):
    """The whole run: tables found in sheets, columns resolved, values typed, totals derived, constants joined."""
    out = run_over_grid(spark, sf_dir).facts
    cents = F.rint(F.col("prime_totale") * 100).cast("long").alias("total_cents")
    return out.select("source_file", "source_row", "num_contrat", "date_effet", "prime_nette", "frais", cents, "prime_totale_source", "agence", "banque", "mois_reception", "annee")


@query(
    """SELECT f AS file_id, header, canonical, CASE WHEN header = 'Prime nettes' THEN 'fuzzy' ELSE 'seed' END AS method, true AS won
       FROM (SELECT DISTINCT o_custkey AS f FROM orders),
         LATERAL (SELECT unnest(['N° Contrat', 'Date d''effet', CASE WHEN f % 5 = 0 THEN 'Prime nettes' ELSE 'Prime nette' END, 'Frais', 'Prime totale']) AS header,
                         unnest(['num_contrat', 'date_effet', 'prime_nette', 'frais', 'prime_totale']) AS canonical)
       WHERE header <> 'Prime totale' OR f % 4 <> 0"""
)
def consolidated_mappings(spark, sf_dir):
    return run_over_grid(spark, sf_dir).mappings.select("file_id", "header", "canonical", "method", "won")


#: An order is a table and its lines are columns, in plans that move each field one column on.
SHIFT_SQL = """lines AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax, min(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL),
       m AS (SELECT l_orderkey AS file_id, l_linenumber AS col, CASE WHEN l_quantity >= 5 THEN 'f' || l_linenumber END AS canonical, CAST(l_tax * 100 AS BIGINT) % 3 AS was FROM lines),
       p AS (SELECT l_orderkey AS file_id, l_linenumber AS col, CASE WHEN l_linenumber > 1 THEN 'f' || (l_linenumber - 1) END AS field, 1 - l_discount AS sure, CAST(l_discount * 100 AS BIGINT) % 2 AS told FROM lines WHERE l_returnflag <> 'R')"""


@query(
    f"""WITH {SHIFT_SQL},
        b AS (SELECT m.file_id, m.col, canonical, was, field, told, sure, coalesce(sure >= 0.945 AND field IS DISTINCT FROM canonical, false) AS changed FROM m LEFT JOIN p ON m.file_id = p.file_id AND m.col = p.col),
        c AS (SELECT *, CASE WHEN changed THEN field ELSE canonical END AS claim FROM b),
        s AS (SELECT file_id, count(*) FILTER (changed) AS changes, count(claim) AS claims, count(DISTINCT claim) AS different, sum(CASE WHEN canonical IS NOT NULL THEN was ELSE 0 END) AS before,
                sum(CASE WHEN changed THEN told WHEN canonical IS NOT NULL THEN was ELSE 0 END) AS after, count(canonical) AS fields FROM c GROUP BY file_id),
        o AS (SELECT file_id, count(*) AS offers, min(sure) AS least FROM p GROUP BY file_id),
        h AS (SELECT s.file_id FROM s JOIN o ON s.file_id = o.file_id WHERE changes > 0 AND claims = different AND (after < before OR (before = 0 AND offers >= fields AND least >= 0.895)))
        SELECT c.file_id, c.col, CASE WHEN changed AND h.file_id IS NOT NULL THEN field ELSE canonical END AS canonical, changed AND h.file_id IS NOT NULL AS planned FROM c LEFT JOIN h ON c.file_id = h.file_id"""
)
def shift_plan(spark, sf_dir):
    """Plans over whole tables: accepted where they are complete, unique and safer."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("col")).agg(*(F.min(c).alias(c) for c in ("l_quantity", "l_tax", "l_discount", "l_returnflag")))  # numbers repeat within an order
    told = lambda n: F.array_repeat(F.lit("odd"), n.cast("int"))
    cents = lambda c: F.rint(F.col(c) * 100).cast("int")
    name = lambda k: F.concat(F.lit("f"), k.cast("string"))
    mappings = lines.select("file_id", "col", F.when(F.col("l_quantity") >= 5, name(F.col("col"))).alias("canonical"), F.lit("seed").alias("method"), F.lit(1.0).alias("confidence"), told(cents("l_tax") % 3).alias("warnings"))
    given = lines.where("l_returnflag <> 'R'").select("file_id", "col", F.when(F.col("col") > 1, name(F.col("col") - 1)).alias("field"), (1 - cents("l_discount") / 100 + 0.005).alias("confidence"), told(cents("l_discount") % 2).alias("warnings"))
    return shift.accept(mappings, given, floor=0.95).select("file_id", "col", "canonical", "planned")
