"""The registered queries over the driver's tables, each with its SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers, text
from tallyforge.operators import checks, detect, facts, metrics, paths, resolve
from tallyforge.plans.sales import REQUIRED, SQL, sales, table
from tallyforge.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, on_sales: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {SQL}{sql}" if on_sales and sql.lstrip().startswith(",") else f"WITH {SQL} {sql}" if on_sales else sql
        return f

    return add


# Totals and counts


@query(
    """SELECT banque, mois_reception, count(*) AS lignes, count(DISTINCT source_file) AS fichiers,
       CAST(coalesce(sum(prime_nette), 0) AS DOUBLE) AS prime_nette_total, CAST(coalesce(sum(frais), 0) AS DOUBLE) AS frais_total,
       CAST(coalesce(sum(prime_totale), 0) AS DOUBLE) AS prime_totale_total, count(*) FILTER (prime_totale_source = 'derived') AS primes_calculees
       FROM sales GROUP BY ALL""",
    on_sales=True,
)
def reconciliation_by_bank_month(spark, sf_dir):
    return metrics.reconciliation(sales(spark, sf_dir))


@query(
    "SELECT banque, produit_code, count(*) AS lignes, count(DISTINCT mois_reception) AS mois, CAST(coalesce(sum(prime_totale), 0) AS DOUBLE) AS prime_totale FROM sales GROUP BY ALL",
    on_sales=True,
)
def status_by_bank_product(spark, sf_dir):
    return metrics.status(sales(spark, sf_dir))


# Checks


@query(
    """SELECT banque, mois_reception, source_file, source_row, field, count(*) AS n FROM (
         SELECT *, unnest(list_filter(['num_contrat', 'date_effet', 'prime_totale'],
           lambda f: (f = 'num_contrat' AND num_contrat IS NULL) OR (f = 'date_effet' AND date_effet IS NULL AND source_format IS DISTINCT FROM 'a')
                  OR (f = 'prime_totale' AND prime_totale IS NULL))) AS field FROM sales) GROUP BY ALL""",
    on_sales=True,
)
def required_missing(spark, sf_dir):
    flags = checks.required(sales(spark, sf_dir), REQUIRED, {"a": ["num_contrat", "prime_totale"]})
    return flags.groupBy("banque", "mois_reception", "source_file", "source_row", "field").agg(F.count("*").alias("n"))


@query(
    """SELECT banque, mois_reception, source_file, source_row, count(*) AS n FROM sales
       WHERE prime_totale_source = 'reported' AND abs(prime_nette + frais - prime_totale) > 0.01 GROUP BY ALL""",
    on_sales=True,
)
def premium_mismatch(spark, sf_dir):
    return checks.premium(sales(spark, sf_dir)).groupBy("banque", "mois_reception", "source_file", "source_row").agg(F.count("*").alias("n"))


@query(
    """, e AS (SELECT source_file, banque, mois_reception, strftime(date_effet, '%Y-%m') AS effect, count(*) AS n FROM sales WHERE date_effet IS NOT NULL GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY source_file, banque, mois_reception ORDER BY n DESC, effect) AS k FROM e)
       SELECT source_file, banque, mois_reception, CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(CASE WHEN effect = mois_reception THEN n ELSE 0 END) AS BIGINT) AS agreeing,
              max(CASE WHEN k = 1 THEN effect END) AS modal FROM r GROUP BY source_file, banque, mois_reception
       HAVING sum(CASE WHEN effect = mois_reception THEN n ELSE 0 END) < sum(n) * 0.5""",
    on_sales=True,
)
def period_agreement(spark, sf_dir):
    return checks.period_shares(sales(spark, sf_dir)).where(F.col("agreeing") < F.col("rows") * checks.AGREEMENT)


@query(
    """, f AS (SELECT DISTINCT banque, mois_reception, source_format, source_file FROM sales),
       u AS (SELECT banque, mois_reception, bool_or(source_format IS NULL) AS unknown FROM f GROUP BY ALL)
       SELECT f.banque, f.mois_reception, CASE WHEN unknown THEN NULL ELSE source_format END AS source_format, string_agg(DISTINCT source_file, '|' ORDER BY source_file) AS files
       FROM f JOIN u ON f.banque = u.banque AND f.mois_reception = u.mois_reception GROUP BY ALL HAVING count(DISTINCT source_file) >= 2""",
    on_sales=True,
)
def period_coverage(spark, sf_dir):
    return checks.coverage(sales(spark, sf_dir)).withColumn("files", F.array_join("files", "|"))


LAG_SQL = "(CAST(substr(mois_reception, 1, 4) AS INTEGER) - year(date_effet)) * 12 + CAST(substr(mois_reception, 6, 2) AS INTEGER) - month(date_effet)"


@query(
    f"""SELECT CASE WHEN lag > 3 THEN 'late_declaration' ELSE 'future_effect' END AS code, banque, mois_reception, count(*) AS n
        FROM (SELECT *, {LAG_SQL} AS lag FROM sales) WHERE lag > 3 OR lag < -1 GROUP BY ALL""",
    on_sales=True,
)
def declaration_lag(spark, sf_dir):
    return checks.lag(sales(spark, sf_dir)).groupBy("code", "banque", "mois_reception").agg(F.count("*").alias("n"))


@query(
    """SELECT source_file, num_contrat, CAST(date_effet AS VARCHAR) AS date_effet, CAST(prime_totale AS DOUBLE) AS prime_totale, count(*) AS n, string_agg(CAST(source_row AS VARCHAR), ',' ORDER BY source_row) AS source_rows
       FROM sales GROUP BY source_file, num_contrat, date_effet, prime_totale HAVING count(*) > 1""",
    on_sales=True,
)
def duplicates_in_file(spark, sf_dir):
    found = checks.repeated_rows(sales(spark, sf_dir))
    return found.select("source_file", "num_contrat", F.col("date_effet").cast("string").alias("date_effet"), F.col("prime_totale").cast("double").alias("prime_totale"), "n", F.array_join(F.col("source_rows").cast("array<string>"), ",").alias("source_rows"))


@query(
    """, c AS (SELECT num_contrat, string_agg(DISTINCT source_file, '|' ORDER BY source_file) AS files, count(DISTINCT source_file) AS k FROM sales GROUP BY num_contrat),
       r AS (SELECT *, row_number() OVER (PARTITION BY files ORDER BY num_contrat) AS p FROM c WHERE k > 1)
       SELECT files, count(*) AS n_contracts, string_agg(CASE WHEN p <= 5 THEN num_contrat END, ',' ORDER BY num_contrat) AS contracts FROM r GROUP BY files""",
    on_sales=True,
)
def duplicates_across_files(spark, sf_dir):
    found = checks.shared_contracts(sales(spark, sf_dir))
    return found.select(F.array_join("files", "|").alias("files"), "n_contracts", F.array_join("contracts", ",").alias("contracts"))


@query(
    f""", flags AS (
        SELECT 'error' AS severity, 'missing_required' AS code, (CASE WHEN num_contrat IS NULL THEN 1 ELSE 0 END) + (CASE WHEN date_effet IS NULL THEN 1 ELSE 0 END) + (CASE WHEN prime_totale IS NULL THEN 1 ELSE 0 END) AS n FROM sales
        UNION ALL SELECT 'warning', 'premium_mismatch', 1 FROM sales WHERE abs(prime_nette + frais - prime_totale) > 0.01
        UNION ALL SELECT 'warning', CASE WHEN {LAG_SQL} > 3 THEN 'late_declaration' ELSE 'future_effect' END, 1 FROM sales WHERE {LAG_SQL} > 3 OR {LAG_SQL} < -1
        UNION ALL SELECT 'error', 'duplicate_in_file', 1 FROM (SELECT 1 FROM sales GROUP BY source_file, num_contrat, date_effet, prime_totale HAVING count(*) > 1)
        UNION ALL SELECT 'error', 'period_disagreement', 1 FROM (SELECT 1 FROM sales WHERE date_effet IS NOT NULL GROUP BY source_file, mois_reception
             HAVING count(*) FILTER (strftime(date_effet, '%Y-%m') = mois_reception) < count(*) * 0.5)
        UNION ALL SELECT 'error', 'period_covered_twice', 1 FROM (SELECT 1 FROM
             (SELECT banque, mois_reception, source_file, CASE WHEN bool_or(source_format IS NULL) OVER (PARTITION BY banque, mois_reception) THEN NULL ELSE source_format END AS sf FROM sales)
             GROUP BY banque, mois_reception, sf HAVING count(DISTINCT source_file) >= 2)
        UNION ALL SELECT 'info', 'duplicate_across_files', 1 FROM (SELECT 1 FROM
             (SELECT string_agg(DISTINCT source_file, '|' ORDER BY source_file) AS files FROM sales GROUP BY num_contrat HAVING count(DISTINCT source_file) > 1) GROUP BY files))
        SELECT severity, code, CAST(sum(n) AS BIGINT) AS n FROM flags GROUP BY ALL HAVING sum(n) > 0""",
    on_sales=True,
)
def flags_by_severity_code(spark, sf_dir):
    return metrics.flag_counts(checks.all_checks(sales(spark, sf_dir), REQUIRED))


# Derivations, identity, replacement


@query(
    """SELECT source_file, CAST(sum(coalesce(prime_totale, prime_nette + frais)) AS DOUBLE) AS total,
       count(*) FILTER (prime_totale IS NOT NULL) AS reported, count(*) FILTER (prime_totale IS NULL AND prime_nette + frais IS NOT NULL) AS derived FROM sales GROUP BY ALL""",
    on_sales=True,
)
def derive_total_with_source(spark, sf_dir):
    filled = facts.fill(sales(spark, sf_dir).drop("prime_totale_source"), "prime_totale", [("sum", ["prime_nette", "frais"])])
    is_ = lambda s: F.count_if(F.col("prime_totale_source") == s)
    return filled.groupBy("source_file").agg(F.sum("prime_totale").cast("double").alias("total"), is_("reported").alias("reported"), is_("derived").alias("derived"))


@query("SELECT banque, CAST(sum(prime_totale - prime_nette) AS DOUBLE) AS fees, count(prime_totale - prime_nette) AS n FROM sales GROUP BY ALL", on_sales=True)
def derive_difference(spark, sf_dir):
    rows = sales(spark, sf_dir).withColumn("frais", F.lit(None).cast("decimal(18,2)"))
    filled = facts.fill(rows, "frais", [("difference", ["prime_totale", "prime_nette"])])
    return filled.groupBy("banque").agg(F.sum("frais").cast("double").alias("fees"), F.count("frais").alias("n"))


HASH_SQL = "substr(sha256(source_file || '::' || num_contrat || '|' || coalesce(CAST(date_effet AS VARCHAR), '') || '|' || coalesce(CAST(prime_totale AS VARCHAR), '')), 1, 16)"


@query(f"SELECT {HASH_SQL} AS row_hash, count(*) AS n FROM sales GROUP BY ALL", on_sales=True)
def row_identity_hash(spark, sf_dir):
    hashed = text.row_hash(F.col("source_file"), F.col("num_contrat"), F.col("date_effet"), F.col("prime_totale"))
    return sales(spark, sf_dir).select(hashed.alias("row_hash")).groupBy("row_hash").agg(F.count("*").alias("n"))


REPLACED_SQL = """, x AS (SELECT source_file, source_row, num_contrat, CAST(prime_nette AS DOUBLE) AS prime_nette, banque FROM sales),
       old AS (SELECT source_file, min(source_row) AS source_row, source_file || '#' || num_contrat AS row_hash, 'old' AS version FROM x GROUP BY source_file, num_contrat),
       new AS (SELECT source_file, source_row, row_hash, 'new' AS version FROM old WHERE source_file LIKE 'A%' AND row_hash NOT LIKE '%7'),
       result AS (SELECT * FROM old WHERE source_file NOT IN (SELECT source_file FROM new) UNION ALL SELECT * FROM new)"""


@query(f"{REPLACED_SQL} SELECT version, source_file, count(*) AS n FROM result GROUP BY ALL", on_sales=True)
def replace_append_dedup(spark, sf_dir):
    name = F.concat("source_file", F.lit("#"), "num_contrat")
    old = sales(spark, sf_dir).groupBy("source_file", "num_contrat").agg(F.min("source_row").alias("source_row")).select("source_file", "source_row", name.alias("row_hash"), F.lit("old").alias("version"))
    new = old.where(F.col("source_file").startswith("A") & ~F.col("row_hash").endswith("7")).withColumn("version", F.lit("new"))
    return facts.replace_files(old, new).groupBy("version", "source_file").agg(F.count("*").alias("n"))


@query(
    """, f AS (SELECT DISTINCT source_file AS path, md5(source_file) AS content_hash FROM sales),
       m AS (SELECT path, CASE WHEN path LIKE '%_R' THEN 'other' ELSE content_hash END AS known FROM f WHERE path NOT LIKE '%_A')
       SELECT f.path, content_hash, CASE WHEN known IS NULL THEN 'new' WHEN known = content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM f LEFT JOIN m ON f.path = m.path""".replace("'%_R'", "'%R'").replace("'%_A'", "'%A'"),
    on_sales=True,
)
def incremental_status(spark, sf_dir):
    files = sales(spark, sf_dir).select(F.col("source_file").alias("path")).distinct().withColumn("content_hash", F.md5("path"))
    known = F.when(F.col("path").endswith("R"), "other").otherwise(F.col("content_hash"))
    return facts.file_status(files, files.where(~F.col("path").endswith("A")).withColumn("content_hash", known))


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) // 400 + 1 AS INTEGER) AS part FROM customer")
def excel_part_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return facts.part_numbers(rows, 400, F.col("c_mktsegment"), F.col("c_custkey")).select("c_custkey", "part")


@query(
    """SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier"""
)
def union_sparse(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return facts.sparse_union(c, s)


# Dates and dimensions

MONTH_LIST = "['Janvier', 'Février', 'Mars', 'Avril', 'Mai', 'Juin', 'Juillet', 'Août', 'Septembre', 'Octobre', 'Novembre', 'Décembre']"


@query(
    f""", b AS (SELECT date_trunc('month', min(date_effet)) AS a, last_day(max(date_effet)) AS z FROM sales),
        d AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS "date" FROM b)
        SELECT CAST("date" AS VARCHAR) AS "date", CAST(year("date") AS INTEGER) AS annee, CAST(month("date") AS INTEGER) AS mois, {MONTH_LIST}[month("date")] AS nom_mois, strftime("date", '%Y-%m') AS annee_mois,
               'T' || quarter("date") AS trimestre, CAST(day("date") AS INTEGER) AS jour, CAST(isodow("date") AS INTEGER) AS jour_semaine FROM d""",
    on_sales=True,
)
def date_dimension(spark, sf_dir):
    return dates.calendar(F.col("first"), F.col("last"), metrics.date_bounds(sales(spark, sf_dir))).withColumn("date", F.col("date").cast("string"))


@query("SELECT DISTINCT banque AS code, coalesce(r_name, banque) AS label FROM sales LEFT JOIN nation ON n_name = banque LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3", on_sales=True)
def dim_bank(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")
    banks = sales(spark, sf_dir).select(F.col("banque").alias("code")).distinct()
    return banks.join(names, F.col("n_name") == F.col("code"), "left").select("code", F.coalesce("r_name", "code").alias("label"))


@query("SELECT p_type AS code, count(*) AS parts, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands FROM part GROUP BY ALL")
def dim_product(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("code")).agg(F.count("*").alias("parts"), F.array_join(F.sort_array(F.collect_set("p_brand")), "|").alias("brands"))


@query(
    """SELECT event_type, CAST((2024 - year(ts)) * 12 + 3 - month(ts) AS INTEGER) AS months_late, count(*) AS n FROM events GROUP BY ALL"""
)
def event_month_lateness(spark, sf_dir):
    late = dates.months_between(F.col("ts"), F.lit("2024-03-01").cast("date")).cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type", late.alias("months_late")).agg(F.count("*").alias("n"))


DAY = "CAST(o_orderdate AS DATE)"


@query(
    f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE CAST({DAY} AS VARCHAR) END AS parsed FROM orders"""
)
def parse_dates_day_first(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    names = F.array(*map(F.lit, dates.MONTHS))
    written = (
        F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy-M-dd"))
        .when(k == 2, F.concat(F.date_format(d, "d"), F.lit(" "), F.substring(F.element_at(names, F.month(d)), 1, 9), F.lit(" "), F.date_format(d, "yyyy")))
        .when(k == 3, F.date_format(d, "dd.MM.yy")).when(k == 4, F.concat(F.lit("31/02/"), F.date_format(d, "yyyy"))).otherwise("99/99/9999")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.to_date(written).cast("string").alias("parsed"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST({DAY} AS VARCHAR) END AS parsed FROM orders"""
)
def excel_serial_dates(spark, sf_dir):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.serial_date(F.when(F.col("o_orderkey") % 5 == 0, serial - 10000.0 - 25000.0).otherwise(serial)).cast("string").alias("parsed"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m') END AS period FROM orders"""
)
def resolve_period_from_name(spark, sf_dir):
    d, k = F.add_months("o_orderdate", 120), F.col("o_orderkey") % 4
    names = F.array(*map(F.lit, dates.MONTHS))
    name = (
        F.when(k == 0, F.concat(F.lit("Ventes_"), F.date_format(d, "yyyyMM"), F.lit(".xlsx"))).when(k == 1, F.concat(F.lit("ventes "), F.date_format(d, "MM-yyyy"), F.lit(".xlsx")))
        .when(k == 2, F.concat(F.element_at(names, F.month(d)), F.lit("_"), F.date_format(d, "yyyy"), F.lit(".xlsm"))).otherwise("janvier_mars.xlsx")
    )
    found = dates.resolve_period(name, F.lit(None))
    period = F.when(found["method"] != "unresolved", F.format_string("%04d-%02d", found["year"], found["month"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", period.alias("period"))


# Text and numbers

DIRTY_SQL = "' N°  ' || c_name || ' -- Prime_Réelle (' || c_mktsegment || ') '"


@query(f"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(strip_accents({DIRTY_SQL})), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS normalized FROM customer")
def normalize_labels(spark, sf_dir):
    dirty = F.concat(F.lit(" N°  "), "c_name", F.lit(" -- Prime_Réelle ("), "c_mktsegment", F.lit(") "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_header(dirty).alias("normalized"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey * 1000003 AS VARCHAR) WHEN 1 THEN '00' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS id FROM orders")
def identifier_repair(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    number = text.identifier_of_number((F.col("o_orderkey") * 1000003).cast("double"))
    other = text.identifier_of_text(F.when(k == 1, F.concat(F.lit(" 00"), "o_orderkey")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, number).otherwise(other).alias("id"))


@query(
    """SELECT l_shipmode_like AS "group", CASE WHEN l_shipmode_like = 'N' THEN '.' ELSE ',' END AS separator, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n
       FROM (SELECT l_returnflag AS l_shipmode_like, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem) GROUP BY ALL"""
)
def parse_french_numbers(spark, sf_dir):
    amount = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    french = F.concat(F.translate(amount, ",.", " ,"), F.lit(" DT"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), F.when(F.col("l_returnflag") == "N", amount).otherwise(french).alias("raw"))
    votes = rows.groupBy("group").agg(numbers.decimal_separator(F.col("raw")).alias("separator"))
    parsed = rows.join(F.broadcast(votes), "group").withColumn("v", numbers.to_number(F.col("raw"), F.col("separator")).cast("decimal(18,2)"))  # a row for each return flag
    return parsed.groupBy("group", "separator").agg(F.sum("v").cast("double").alias("total"), F.count("v").alias("n"))


@query(
    """SELECT l_returnflag AS "group", count(*) FILTER (v % 3 = 0) AS commas, count(*) FILTER (v % 3 = 1) AS dots, CASE WHEN count(*) FILTER (v % 3 = 0) >= count(*) FILTER (v % 3 = 1) THEN ',' ELSE '.' END AS separator
       FROM (SELECT l_returnflag, l_linenumber AS v FROM lineitem) GROUP BY ALL"""
)
def decimal_separator_vote(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    raw = F.when(k == 0, "1.234,56").when(k == 1, "1234.5").otherwise("1200")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), raw.alias("raw"))
    vote = numbers.separator_vote(F.col("raw"))
    return rows.groupBy("group").agg(F.count_if(vote == ",").alias("commas"), F.count_if(vote == ".").alias("dots"), numbers.decimal_separator(F.col("raw")).alias("separator"))


@query(
    """SELECT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN true ELSE false END AS percent, CAST(sum(CAST(l_discount AS DECIMAL(18,2)) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 100 END) AS DOUBLE) AS total
       FROM lineitem GROUP BY ALL"""
)
def percent_vote_rescale(spark, sf_dir):
    whole = F.rint(F.col("l_discount") * 100).cast("int").cast("string")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(whole, F.lit(" %"))).otherwise(whole)
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", raw.alias("raw"))
    votes = rows.groupBy("l_linenumber").agg(numbers.is_percent(F.col("raw")).alias("percent"))
    value = numbers.to_number(F.col("raw"), F.lit(",")).cast("decimal(18,2)")
    parsed = rows.join(votes, "l_linenumber").withColumn("v", F.when(F.col("percent"), (value / 100).cast("decimal(18,2)")).otherwise(value))
    return parsed.groupBy("l_linenumber", "percent").agg(F.sum("v").cast("double").alias("total"))


@query(
    """SELECT o_orderstatus AS field, count(*) AS total, count(*) FILTER (k IN (0, 1)) AS converted, count(*) FILTER (k = 2) AS blank, count(*) FILTER (k = 3) AS failed,
       array_to_string(list_sort(list(CASE WHEN k = 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END) FILTER (k = 3))[1:3], ',') AS failures
       FROM (SELECT *, o_orderkey % 4 AS k FROM orders) GROUP BY ALL"""
)
def coercion_report(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "12,5").when(k == 1, "1 000 DA").when(k == 2, "  ").otherwise("n/a")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("field"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"), raw.alias("raw"))
    from tallyforge.operators.coerce import report

    return report(rows, "field", F.col("raw"), numbers.to_number(F.col("raw"), F.lit(",")), F.col("key"), keep=3)


# Sheets as cells: every customer is a sheet with a title, a header, its orders, a total line and a stray number

GRID_SQL = """o AS (SELECT o_custkey AS f, o_orderkey, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders)"""
HEADERS = ["N° Contrat", "Date d'effet", "Prime nette", "Frais", "Prime totale"]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one sheet for each customer with orders; sheets start 0 to 2 rows further down."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("f"), "o_orderkey", "o_totalprice", "o_orderdate")
    w = W.partitionBy("f")
    o = detect.dealt(o, "f").withColumns({"i": F.row_number().over(w.orderBy("o_orderkey")).cast("int"), "k": F.count("*").over(w).cast("int"), "off": (F.col("f") % 3).cast("int")})

    # Cells of an order are numbered from 1; its sheet's own (headers, title, total line, stray number) follow on its first order.
    numbered = o.withColumn("c", F.explode(F.sequence(F.lit(1), F.when(F.col("i") == 1, 5 + len(HEADERS) + 4).otherwise(5))))
    c, heads = F.col("c"), len(HEADERS)
    title, total, amount, stray = (c == 5 + heads + k for k in (1, 2, 3, 4))
    head, end = c.between(6, 5 + heads), F.col("off") + F.col("k")
    return numbered.select(
        F.col("f").alias("file_id"), F.lit("Ventes").alias("sheet"),
        F.when(c <= 5, F.col("off") + F.col("i") + 3).when(head, F.col("off") + 3).when(title, F.col("off") + 1).when(stray, end + 7).otherwise(end + 4).alias("row"),
        F.when(c <= 5, c).when(head, c - 5).when(amount, 5).when(stray, 8).otherwise(1).alias("col"),
        F.when((c == 1) | head | title | total, "s").when(c == 2, "d").otherwise("n").alias("kind"),
        F.when(c == 1, F.concat(F.lit("C-"), "o_orderkey")).when(head, F.get(F.array(*map(F.lit, HEADERS)), c - 6)).when(title, "Etat des ventes du mois pour la banque").when(total, "TOTAL").alias("s"),
        F.when(c == 3, F.col("o_totalprice")).when(c == 4, 5.0).when(c == 5, F.col("o_totalprice") + 5).when(amount, 1e6).when(stray, 7.0).alias("n"),
        F.when(c == 2, F.col("o_orderdate").cast("date")).alias("d"),
    )


def vocabulary(spark: SparkSession) -> DataFrame:
    names = spark.createDataFrame([(h,) for h in HEADERS], "name string")
    return names.select(text.normalize_header(F.col("name")).alias("norm"))


def sheet_tables(spark: SparkSession, sf_dir: str, held: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row records with their headers, written, since each of the steps behind reads them; the headers among
    them; extents). held: the cells that these steps read; the windows carry rows without any where it is None."""
    rows = detect.sheet_rows(detect.filled(grid(spark, sf_dir)), vocabulary(spark))
    rows = rows.drop("held") if held is None else rows.withColumn("held", held)
    rows = tables.written(detect.headed(rows, vocabulary(spark)), "rows")
    found = detect.headers(rows, vocabulary(spark))
    return rows, found, tables.written(detect.extents(rows, found), "extents")


@query(f"WITH {GRID_SQL} SELECT f AS file_id, CAST(f % 3 + 3 AS INTEGER) AS header_row, CAST(f % 3 + 3 AS INTEGER) AS header_end FROM o GROUP BY f")
def header_row_score(spark, sf_dir):
    found = detect.headers(detect.filled(grid(spark, sf_dir)), vocabulary(spark))
    return found.select("file_id", "header_row", "header_end")


@query(f"WITH {GRID_SQL} SELECT f AS file_id, CAST(f % 3 + 4 AS INTEGER) AS data_start, CAST(f % 3 + 3 + max(k) AS INTEGER) AS data_end FROM o GROUP BY f")
def table_extent(spark, sf_dir):
    return sheet_tables(spark, sf_dir)[2].select("file_id", "data_start", "data_end")


@query(
    f"""WITH {GRID_SQL}, h AS (SELECT f, max(k) AS k FROM o GROUP BY f)
        SELECT f AS file_id, CAST(f % 3 + 1 AS INTEGER) AS "row", 'above the header row' AS reason FROM h
        UNION ALL SELECT f, CAST(f % 3 + k + 4 AS INTEGER), 'beyond the end of the table' FROM h
        UNION ALL SELECT f, CAST(f % 3 + k + 7 AS INTEGER), 'beyond the end of the table' FROM h"""
)
def dropped_rows(spark, sf_dir):
    rows, found, extent = sheet_tables(spark, sf_dir)
    return detect.dropped_rows(rows, found, extent)


@query(
    """SELECT o_custkey AS file_id, unnest(['n contrat', 'date d effet', 'prime nette', 'frais', 'prime totale']) AS normalized, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS col, 1.0::DOUBLE AS fill
       FROM (SELECT DISTINCT o_custkey FROM orders)"""
)
def column_selection(spark, sf_dir):
    rows, found, extent = sheet_tables(spark, sf_dir, F.col("held"))
    kept = detect.selected_columns(rows, detect.header_labels(rows, found), extent)
    return kept.select("file_id", "col", "normalized", "fill")


@query(
    """SELECT o_custkey AS file_id, count(*) AS total, count(*) AS non_blank, 1.0::DOUBLE AS numeric_ratio, CAST(count(DISTINCT o_totalprice) AS DOUBLE) / count(*) AS unique_ratio, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value
       FROM orders GROUP BY ALL"""
)
def column_profile(spark, sf_dir):
    sheet, _, extent = sheet_tables(spark, sf_dir, F.filter("held", lambda c: c["col"] == 3))
    rows = extent.select("file_id", (F.col("data_end") - F.col("data_start") + 1).cast("long").alias("rows"))
    data = detect.block(detect.cells_of(sheet), extent).withColumns({"shown": F.col("n").cast("string"), "number": F.col("n"), "date": F.col("d")})
    return resolve.profiles(data, rows).select("file_id", "total", "non_blank", "numeric_ratio", "unique_ratio", "min_value", "max_value")


@query(
    """SELECT o_custkey AS file_id, CASE WHEN max(o_totalprice) > 400000 THEN 'above the largest value' ELSE '' END AS warnings FROM orders GROUP BY ALL"""
)
def content_warnings(spark, sf_dir):
    due = spark.createDataFrame([("prime_nette", "numeric", 0.0, 400000.0, None, None)], "canonical string, mostly string, min_value_due double, max_value_due double, min_unique double, max_unique double")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.lit(3).alias("col"), F.col("o_totalprice").cast("string").alias("shown"), F.col("o_totalprice").alias("number"), F.col("o_orderdate").cast("date").alias("date"))
    rows = o.groupBy("file_id").agg(F.count("*").alias("rows"))
    profile = resolve.profiles(o, rows).withColumn("canonical", F.lit("prime_nette"))
    return resolve.content_warnings(profile, due).select("file_id", F.array_join("warnings", ", ").alias("warnings"))


@query(
    """SELECT f AS file_id, "row", col, v AS s FROM (SELECT n_nationkey AS f, n_name AS v, unnest([1, 1, 2, 2]) AS "row", unnest([1, 2, 1, 2]) AS col FROM nation)
       UNION ALL SELECT n_nationkey, 3, 1, 'alone' FROM nation"""
)
def merged_fill(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), "n_name")
    cells = n.select("file_id", F.explode(F.array(F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.col("n_name").alias("s")), F.struct(F.lit(3).alias("row"), F.lit(1).alias("col"), F.lit("alone").alias("s")))).alias("c")).select("file_id", "c.*")
    ranges = n.select("file_id", F.lit(1).alias("r0"), F.lit(1).alias("c0"), F.lit(2).alias("r1"), F.lit(2).alias("c1"))
    return detect.expand_merged(cells, ranges)


@query(
    """SELECT o_custkey AS path, o_orderpriority AS sheet FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0) DESC, n DESC, o_orderpriority) AS k
         FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE k = 1"""
)
def sheet_choice(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cells = o.select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("sheet"), F.ascii(F.col("o_orderpriority")).alias("sheet_index"), F.lit(1).alias("row"))
    liked = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("path")).distinct().withColumn("sheet", F.lit("1-urgent"))
    return detect.choose_sheets(cells, liked)


# Headers to fields

ALIASES = [("product", "P1", "prime", "prime_nette"), ("bank", "B1", "prime", "frais"), ("global", None, "prime", "prime_totale"), ("seed", None, "prime", "taxe"), ("seed", None, "prime totale", "prime_totale"), ("seed", None, "montant prime", "prime_totale")]


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "tier string, scope string, alias string, canonical string")


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"))
    k = F.col("file_id")
    header = F.when(k % 4 == 0, "Prime").when(k % 4 == 1, "PRIME  Totale").when(k % 4 == 2, "PrimeTotale").otherwise("Inconnu")
    produit, bank = F.when(k % 3 == 0, "P1").otherwise("P2"), F.when(k % 5 == 0, "B1").otherwise("B2")
    return n.select("file_id", F.lit(1).alias("col"), text.normalize_header(header).alias("normalized"), F.lit("").alias("leaf"), produit.alias("produit"), bank.alias("bank"))


@query(
    """SELECT c_custkey AS file_id,
       CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'prime_nette' WHEN c_custkey % 5 = 0 THEN 'frais' ELSE 'prime_totale' END WHEN 1 THEN 'prime_totale' WHEN 2 THEN 'prime_totale' END AS canonical,
       CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'product' WHEN c_custkey % 5 = 0 THEN 'bank' ELSE 'global' END WHEN 1 THEN 'seed' WHEN 2 THEN 'seed_loose' END AS method FROM customer"""
)
def alias_exact_join(spark, sf_dir):
    return resolve.exact(header_rows(spark, sf_dir), alias_table(spark)).select("file_id", "canonical", "method")


@query(
    """SELECT c_custkey AS file_id, CASE WHEN c_custkey % 2 = 0 THEN 'prime_totale' END AS canonical FROM customer"""
)
def alias_fuzzy_topk(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.lit(1).alias("col"), F.when(F.col("c_custkey") % 2 == 0, "primes totale").otherwise("zone geographique").alias("normalized"))
    return resolve.fuzzy(n, alias_table(spark).where("tier = 'seed'")).select("file_id", "canonical")


@query(
    """SELECT o_custkey AS file_id, o_orderkey AS col FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 0.95 ELSE 1.0 END DESC, o_orderkey % 3 = 0, o_orderkey) AS k FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderkey FROM orders)) WHERE k = 1"""
)
def claim_conflict_winner(spark, sf_dir):
    near = F.col("o_orderkey") % 3 == 0
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("col"), F.col("o_orderstatus").alias("canonical"), F.when(near, "fuzzy").otherwise("seed").alias("method"), F.when(near, 0.95).otherwise(1.0).alias("confidence"))
    return resolve.settle(claims).where("won").select("file_id", "col")


@query(
    """SELECT c_custkey AS file_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'batiment' WHEN 'MACHINERY' THEN NULL ELSE lower(c_mktsegment) END AS canonical,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'manual' ELSE 'seed' END AS method FROM customer"""
)
def overrides_applied(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_mktsegment").alias("normalized"), F.lower("c_mktsegment").alias("canonical"), F.lit("seed").alias("method"), F.lit(1.0).alias("confidence"))
    chosen = spark.createDataFrame([("BUILDING", "batiment"), ("MACHINERY", "__ignore__")], "normalized string, field string")
    return resolve.override(c, chosen).select("file_id", "canonical", "method")


@query(
    """SELECT lower(c_mktsegment) AS normalized, CAST(c_nationkey % 3 AS VARCHAR) AS produit, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS variants, string_agg(DISTINCT n_name, ' | ' ORDER BY n_name) AS banks, count(DISTINCT c_custkey) AS n_files
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
)
def header_inventory(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.select(F.lower("c_mktsegment").alias("normalized"), F.col("c_mktsegment").alias("header"), (F.col("c_nationkey") % 3).cast("string").alias("produit"), F.col("n_name").alias("bank"), F.col("c_custkey").alias("path"), F.lit(1).alias("col_index"), F.lit(None).cast("string").alias("canonical"))
    return metrics.header_inventory(m).drop("proposed")


@query("SELECT c_mktsegment AS header, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL")
def unresolved_frequency(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("header"), F.lower("c_mktsegment").alias("normalized"), F.when(F.col("c_custkey") % 3 != 0, "x").alias("canonical"))
    return metrics.unresolved_frequency(c)


@query(
    """SELECT 'root/' || CASE c_custkey % 3 WHEN 0 THEN 'NORDIA 2025' WHEN 1 THEN 'sud_maritime' ELSE 'nordiax' END || '/SERENA/' || c_custkey || '_mars_2024.xlsx' AS path,
       CASE c_custkey % 3 WHEN 0 THEN 'NORDIA' WHEN 1 THEN 'SUDMAR' END AS bank, CASE c_custkey % 3 WHEN 1 THEN NULL ELSE 'serena' END AS produit, '2024-03' AS period,
       CASE WHEN c_custkey % 3 = 2 THEN 'no known bank in the path' END AS error FROM customer"""
)
def path_metadata(spark, sf_dir):
    k = F.col("c_custkey")
    folder = F.when(k % 3 == 0, "NORDIA 2025").when(k % 3 == 1, "sud_maritime").otherwise("nordiax")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("root/"), folder, F.lit("/SERENA/"), k.cast("string"), F.lit("_mars_2024.xlsx")).alias("path"))
    tokens = spark.createDataFrame([("nordia", "NORDIA"), ("nordia banque", "NORDIA"), ("sud maritime", "SUDMAR"), ("sud", "SUDMAR")], "token string, code string")
    words = spark.createDataFrame([("serena", "serena", ["NORDIA", None])], "token string, produit string, partners array<string>")
    found = paths.describe(files, tokens, words.withColumn("partners", F.array_compact("partners")))
    return found.select("path", "bank", "produit", "period", "error")


@query(
    """SELECT o_custkey AS "row", max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS "F", max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS "O" FROM orders GROUP BY ALL"""
)
def long_to_wide(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row"), F.col("o_orderstatus").alias("field"), "o_totalprice")
    return o.groupBy("row").pivot("field", ["F", "O"]).agg(F.max("o_totalprice"))
