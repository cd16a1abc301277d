"""Functions, detection, checks, workbooks and the warehouse on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates, numbers, text
from tallyforge.operators import checks, detect, facts, paths, resolve
from tallyforge.plans.warehouse import Warehouse
from tallyforge.sources import tables, workbooks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw,out", [(" N° Contrat ", "n contrat"), ("Prime_Réelle (DT)", "prime reelle dt"), (None, ""), ("A  b", "a b"), ("  ", "")])
def test_headers(spark, raw, out):
    assert one(spark, raw, text.normalize_header) == out


@pytest.mark.parametrize("raw,sep,out", [("1 234,56", ",", 1234.56), ("1.234,56 DT", ",", 1234.56), ("(12.5)", ".", -12.5), ("abc", ",", None), ("1,234.5", ".", 1234.5), ("", ",", None), ("12 %", ",", 12.0)])
def test_numbers(spark, raw, sep, out):
    assert one(spark, raw, lambda c: numbers.to_number(c, F.lit(sep))) == out


@pytest.mark.parametrize("raw,vote", [("1.234,56", ","), ("1,234.56", "."), ("12,5", ","), ("1.234.567", ","), ("0,125", "."), ("12", None)])
def test_votes(spark, raw, vote):
    assert one(spark, raw, numbers.separator_vote) == vote


@pytest.mark.parametrize(
    "raw,out", [("03/04/2025", dt.date(2025, 4, 3)), ("2025-04-03", dt.date(2025, 4, 3)), ("3 avril 2025", dt.date(2025, 4, 3)), ("31/02/2025", None), ("99/99/9999", None), ("1.2.69", dt.date(2069, 2, 1)), ("1-jui-2025", None), (None, None)]
)
def test_dates(spark, raw, out):
    assert one(spark, raw, dates.to_date) == out


@pytest.mark.parametrize("name,year,month,method", [("x_202503.xlsx", 2025, 3, "digits"), ("03-2025 x.xlsx", 2025, 3, "digits"), ("SERENA_Mars_2025.xlsx", 2025, 3, "name"), ("janvier mars 2025.xlsx", 2025, None, "unresolved"), ("x.xlsx", None, None, "unresolved"), ("juin.xlsx", None, 6, "unresolved")])
def test_periods(spark, name, year, month, method):
    got = one(spark, name, lambda c: dates.resolve_period(c, F.lit(None)))
    assert (got.year, got.method) == (year, method) and (month is None or method == "unresolved" or got.month == month)


def test_fill_and_source(spark):
    frame = spark.createDataFrame([(1.0, 2.0, None), (1.0, 2.0, 9.0), (None, 2.0, None)], "a double, b double, t double")
    got = [tuple(r) for r in facts.fill(frame, "t", [("sum", ["a", "b"]), ("difference", ["zz", "b"])]).select("t", "t_source").collect()]
    assert got == [(3.0, "derived"), (9.0, "reported"), (None, None)]


FACTS = "banque string, mois_reception string, num_contrat string, date_effet date, prime_nette double, frais double, prime_totale double, prime_totale_source string, source_format string, source_file string, source_row int"


def frame(spark, *changes):
    rows = [["NORDIA", "2025-01", f"C{k}", dt.date(2025, 1, 5), 10.0, 1.0, 11.0, "reported", None, "a.xlsx", k] for k in range(3)]
    for k, column, value in changes:
        rows[k][column] = value
    return spark.createDataFrame([tuple(r) for r in rows], FACTS)


@pytest.mark.parametrize(
    "changes,code",
    [([], None), ([(1, 2, None)], "missing_required"), ([(1, 6, 15.0)], "premium_mismatch"), ([(k, 3, dt.date(2024, 12, 1)) for k in range(3)], "period_disagreement"), ([(1, 3, dt.date(2024, 6, 1))], "late_declaration"), ([(1, 3, dt.date(2025, 4, 1))], "future_effect"), ([(1, 2, "C0")], "duplicate_in_file"), ([(1, 9, "b.xlsx"), (1, 2, "C0")], "duplicate_across_files")],
)
def test_one_defect_each(spark, changes, code):
    got = {r.code for r in checks.all_checks(frame(spark, *changes), ["num_contrat", "date_effet", "prime_totale"]).collect()}
    assert got - {"period_covered_twice"} == ({code} if code else set())


def test_workbook_to_table(spark, tmp_path):
    day = dt.date(2025, 1, 2)
    rows = [["Etat des ventes du mois de janvier 2025", None], [], [None, "Contrat", "Date effet", "Prime"], *[[None, f"C-{k}", day, 10.5 + k] for k in range(5)], [None, "TOTAL", None, 60], [], [], [None, None, None, None, 3]]
    (tmp_path / "NORDIA").mkdir()
    workbooks.write({"Param": [["x"]], "Ventes": rows}, tmp_path / "NORDIA" / "v_202501.xlsx")
    (tmp_path / "NORDIA" / "bad.xlsx").write_text("not a workbook")
    (tmp_path / "NORDIA" / "~$lock.xlsx").write_text("")
    cells = workbooks.read(workbooks.find(spark, str(tmp_path), content=True)).persist()
    assert cells.where("error is not null").count() == 1 and cells.select("path").distinct().count() == 2
    good = cells.where("error is null")
    sheet = detect.choose_sheets(good)
    own = detect.filled(good.join(sheet, ["path", "sheet"]).withColumn("file_id", F.col("path"))).persist()
    words = spark.createDataFrame([("contrat",), ("date effet",), ("prime",)], "norm string")
    found = detect.headers(own, words).persist()
    extent = detect.extents(own, found)
    e = extent.first()
    assert (found.first().header_row, e.data_start, e.data_end) == (3, 4, 8)
    kept = detect.selected_columns(own, detect.header_labels(own, found), extent)
    assert sorted(r.normalized for r in kept.collect()) == ["contrat", "date effet", "prime"]
    assert detect.block(own, extent).where("col = 4").agg(F.sum("n")).first()[0] == 62.5


def test_warehouse_replaces_by_file(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    rows = [("a", 1, "h1", 1.0, "NORDIA", dt.date(2025, 1, 1)), ("b", 1, "h2", 2.0, None, dt.date(2025, 2, 1))]
    schema = "source_file string, source_row int, row_hash string, v double, banque string, date_effet date"
    first = spark.createDataFrame(rows, schema)
    assert w.append("p", first) == {"written": 2, "replaced": 0}
    assert w.append("p", first) == {"written": 2, "replaced": 2} and w.read("p").count() == 2
    new = spark.createDataFrame([("a", 1, "h3", 5.0, "NORDIA", dt.date(2025, 1, 1)), ("a", 2, "h4", 6.0, "NORDIA", dt.date(2025, 1, 3))], schema)
    assert w.append("p", new, dry_run=True)["written"] == 2 and w.read("p").count() == 2
    w.append("p", new)
    assert sorted(r.v for r in w.read("p").collect()) == [2.0, 5.0, 6.0]
    with pytest.raises(facts.ContractError):
        w.append("p", new.drop("v"))
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    w.record(files)
    changed = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, content_hash string")
    assert {r.path: r.status for r in w.pending(changed).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    w.extracts("p")
    w.dimensions({"NORDIA": "NORDIA Banque"}, [("p", "P")])
    assert spark.read.parquet(f"{w.root}/dim_date").count() == 59 and w.products() == ["p"]


def test_conflicts_keep_the_surest(spark):
    m = spark.createDataFrame([("f", 1, "x", "fuzzy", 1.0), ("f", 2, "x", "seed", 1.0), ("f", 3, "x", "seed", 1.0), ("f", 4, None, None, None)], "file_id string, col int, canonical string, method string, confidence double")
    assert [r.col for r in resolve.settle(m).where("won").collect()] == [2]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_products_of_paths(spark):
    long_name = "assurance des emprunteurs pour le credit immobilier"
    words = spark.createDataFrame([("serena", "serena", ["NORDIA"]), (long_name, "ade", []), ("visa", "visa", None), ("ctp", "ctp", []), ("vie", "vie", ["BNA"])], "token string, produit string, partners array<string>")
    tokens = spark.createDataFrame([("nordia", "NORDIA"), ("sud maritime", "SUDMAR")], "token string, code string")
    due = {
        "root/nordiax/SERENA/1_mars_2024.xlsx": (None, "serena", "name"),
        "root/sud_maritime/SERENA/2_mars_2024.xlsx": ("SUDMAR", None, "unresolved"),
        "root/NORDIA 2025/SERENA/3_mars_2024.xlsx": ("NORDIA", "serena", "name"),
        "SERENA/x/NORDIA 2025/4_mars_2024.xlsx": ("NORDIA", "serena", "name"),
        f"root/sud_maritime/{long_name}/5_mars_2024.xlsx": ("SUDMAR", "ade", "name"),
        "root/sud_maritime/Visa/6_mars_2024.xlsx": ("SUDMAR", "visa", "name"),
        "root/sud_maritime/visas/7_mars_2024.xlsx": ("SUDMAR", None, "unresolved"),
        "root/vie/ctp/8_mars_2024.xlsx": (None, None, "ambiguous"),
        "root/NORDIA/vie/9_mars_2024.xlsx": ("NORDIA", None, "unresolved"),
    }
    got = paths.describe(spark.createDataFrame([(p,) for p in due], "path string"), tokens, words).collect()
    assert {r.path: (r.bank, r.produit, r.produit_method) for r in got} == due
    assert {r.period for r in got} == {"2024-03"}


def test_path_metadata_of_low_ids(spark, tmp_path):
    """All ids count, those up to 999 too, in the query and in the operator by itself."""
    import duckdb

    from tallyforge.plans.catalogue import ORACLE_SQL, QUERIES

    spark.range(1200).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    sql = ORACLE_SQL["path_metadata"]
    due = con.execute(f"SELECT path, bank, produit, period, error FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, QUERIES["path_metadata"](spark, str(tmp_path)).collect()))) == sorted(map(repr, due)) and len(due) == 1200
    files = con.execute(f"SELECT path, bank, produit, period, error FROM ({sql})").fetchall()
    tokens = spark.createDataFrame([("nordia", "NORDIA"), ("sud maritime", "SUDMAR")], "token string, code string")
    words = spark.createDataFrame([("serena", "serena", ["NORDIA"])], "token string, produit string, partners array<string>")
    got = paths.describe(spark.createDataFrame([(r[0],) for r in files], "path string"), tokens, words).select("path", "bank", "produit", "period", "error").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, files)) and len(files) == 1200


def test_path_metadata_of_ids_like_periods(spark, tmp_path):
    """Ids that look like a year or a period don't stand for the month's year behind its name; a path twice gives two rows."""
    import duckdb

    from tallyforge.plans.catalogue import ORACLE_SQL, QUERIES

    ids = [*range(1990, 2105), *range(200001, 200014), 202412, 12024, 12025, 122024, 122025, 1202403, 5, 5]
    spark.createDataFrame([(k,) for k in ids], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    due = con.execute(f"SELECT path, bank, produit, period, error FROM ({ORACLE_SQL['path_metadata']})").fetchall()
    got = QUERIES["path_metadata"](spark, str(tmp_path)).select("path", "bank", "produit", "period", "error").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, due)) and len(got) == len(ids)


def test_short_headers_meet_every_alias(spark):
    names = ["prmie", "tuax", "cl no", "prime", "zzz", ""]
    aliases = ["prime", "taux", "no cl", "frais"]
    headers = spark.createDataFrame([(1, k, n) for k, n in enumerate(names)], "file_id int, col int, normalized string")
    table = spark.createDataFrame([("seed", None, a, a) for a in aliases], "tier string, scope string, alias string, canonical string")
    got = {names[r.col]: (r.canonical, r.score, [x["name"] for x in r.suggestions or []]) for r in resolve.fuzzy(headers, table).collect()}
    assert got["prmie"] == (None, 80.0, ["prime"]) and got["tuax"] == (None, 75.0, ["taux"]) and got["cl no"] == ("no cl", 95.0, ["no cl"])
    assert got["prime"][0] == "prime" and got["zzz"] == got[""] == (None, None, [])


def test_rows_conserved_and_gates(spark):
    from tallyforge.operators import audit
    from tallyforge.plans import catalogue_run

    rows = catalogue_run.rows_conserved(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.kept + r.dropped == r.due for r in rows)
    flags = spark.createDataFrame([("error",), ("info",)], "severity string")
    fine = spark.createDataFrame([("frais", ["odd"], "seed")], "canonical string, warnings array<string>, method string")
    assert audit.gate(flags, fine) == "errors" and audit.gate(flags, fine, allow_errors=True) == "review"
    assert audit.gate(flags.where("severity = 'info'"), fine, allow_review=True) is None
    assert audit.only(fine.withColumn("path", F.lit("a")), spark.createDataFrame([("b",)], "path string")).count() == 0


def sheet(spark, lines, file_id="f"):
    """Filled cells of a sheet given as lists of values; None is blank."""
    cells = []
    for r, line in enumerate(lines, 1):
        for c, v in enumerate(line, 1):
            if v is not None:
                number = isinstance(v, int | float)
                cells.append((file_id, r, c, "n" if number else "s", None if number else v, float(v) if number else None, None))
    return detect.filled(spark.createDataFrame(cells, "file_id string, row int, col int, kind string, s string, n double, d date"))


def found_in(spark, lines, words=("contrat", "prime", "nette", "totale", "frais")):
    cells = sheet(spark, lines)
    found = tables.written(detect.headers(cells, spark.createDataFrame([(w,) for w in words], "norm string")), "found")
    return cells, found, tables.written(detect.extents(cells, found), "extent")


def test_two_header_rows_and_trimmed_rows(spark):
    lines = [["Contrat", "Prime", "Prime", "Vide", None], [None, "Nette", "Totale", None, None], *[[f"C{k}", 10 + k, 20 + k, None, None] for k in range(30)]]
    lines[10][4] = "once"  # a column without a name, filled in one of 30 rows
    lines += [[None, 5, 6, None, None], ["C99", None, None, None, None]]
    cells, found, extent = found_in(spark, lines, ("contrat", "prime", "vide"))
    assert (found.first().header_row, found.first().header_end) == (1, 2)
    labels = detect.header_labels(cells, found)
    assert {r.col: (r.normalized, r.leaf) for r in labels.collect()} == {1: ("contrat", "contrat"), 2: ("prime nette", "nette"), 3: ("prime totale", "totale"), 4: ("vide", "vide")}
    e = extent.first()
    assert (e.data_start, e.data_end, e.anchors) == (3, 32, [1, 2, 3])
    dropped = {r.row: r.reason for r in detect.dropped_rows(cells, found, extent).collect()}
    assert dropped == {33: "missing identifying columns", 34: "missing identifying columns"}
    assert sorted(r.col for r in detect.selected_columns(cells, labels, extent).collect()) == [1, 2, 3]
    gone = {r.col: (r.letter, r.header, r.reason) for r in detect.dropped_columns(cells, labels, extent).collect()}
    assert gone == {4: ("D", "Vide", "empty in data block"), 5: ("E", "", "no header and only 3% filled")}


def test_ends_of_tables(spark):
    body = [["Contrat", "Prime", "Frais", "Nette"], *[[f"C{k}", 1, 2, 3] for k in range(6)]]
    ends = lambda more: found_in(spark, body + more)[2].first().data_end
    assert ends([["Total", 6, 12, 18]]) == ends([[None, None, "TOTAL", 9]]) == ends([["total general", 1, 1, 1]]) == 7
    assert ends([["C9", "total", 2, 3]]) == 8 and ends([["totalement", 1, 2, 3]]) == 8  # not the first filled cell, not a whole word
    assert found_in(spark, [[None, *r] for r in body] + [[None, None, None, "Total", 9]])[2].first().cut == 9  # in the fourth column: no end by itself
    assert ends([[], ["C9", 1, 2, 3]]) == 9 and ends([[], [], ["C9", 1, 2, 3]]) == 7
    cells, found, extent = found_in(spark, body + [[], ["C9", 1, 2, 3], ["x", None, None, None]])
    assert {r.row: r.reason for r in detect.dropped_rows(cells, found, extent).collect()} == {8: "blank row inside table", 10: "too sparse to be a record"}  # with the blank row no column fills nine tenths


def test_wide_header_rows_share_columns(spark):
    """Columns beyond those of a row's mask count: the header over 70 columns, not the line over the first few."""
    lines = [["Note", "x"] + [None] * 68, [f"Titre {k}" for k in range(70)], *[[None] * 60 + [float(k)] * 10 for k in range(4)]]
    cells = sheet(spark, lines)
    got = {r.row: r.score for r in detect.header_scores(cells, spark.createDataFrame([("titre 3",)], "norm string")).collect()}
    rows = detect.sheet_rows(cells).where("row = 2").first()
    assert (len(rows.beyond), rows.data, rows.unique, rows.data_beyond) == (8, 0, 70, [])
    # vocabulary 1 of 70, no data, all different, full width, 10 of 70 below, all of them data
    assert got[2] == pytest.approx(3 / 70 + 1.2 + 0.8 + 1 + 1.5 * 10 / 70 + 10 / 70)
    assert got[1] == pytest.approx(1.2 + 0.8 + 2 / 70 + 1.5)


def test_tables_of_files_are_never_broadcast(spark):
    """Joins of a run by file are shuffled whatever Spark thinks of the sizes: what it would broadcast grows with the files."""
    cells, found, extent = found_in(spark, [["Contrat", "Prime"], *[[f"C{k}", float(k)] for k in range(5)]])
    rows = tables.written(detect.sheet_rows(cells), "rows")
    labels = detect.header_labels(rows, found)
    for t in (detect.extents(rows, found), labels, detect.selected_columns(rows, labels, extent), detect.dropped_rows(rows, found, extent), detect.block(rows, extent)):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_headers_normalise_as_step_by_step(spark):
    """One pass over a text equals cleaning, folding and replacing one after the other."""
    import random

    rng = random.Random(4)
    marks = " \t\n\u00a0\u202f\u2009\u200b\ufeff_-./'°éÀßÆaZ09İ€\u0301"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 9))) for _ in range(800)]
    bare = F.regexp_replace(F.lower(text.strip_accents(text.clean_spaces(F.col("s")))), r"(?U)[^\w\s]|_", " ")
    due = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    wrong = spark.createDataFrame([(t,) for t in texts], "s string").where(text.normalize_header(F.col("s")) != due)
    assert wrong.count() == 0
    values = [0.0, -5.5, 1e300, 1.5e-7, 12345678.0, float("nan"), float("-inf")]
    told = detect.with_text(spark.createDataFrame([(v,) for v in values], "n double").selectExpr("'n' kind", "cast(null as string) s", "n", "cast(null as date) d"))
    assert told.where(F.col("norm") != text.normalize_header(F.col("shown"))).count() == 0 and told.where("shown is null").count() == 0


def test_sheets_without_tables(spark):
    cells, found, extent = found_in(spark, [["Contrat", "Prime"], ["Total", 3]])
    assert extent.count() == 0 and {r.row: r.reason for r in detect.dropped_rows(cells, found, extent).collect()} == {2: "no record beneath the header"}
    lone = sheet(spark, [["alone"]], "lone")
    files = spark.createDataFrame([("f",), ("lone",), ("none",)], "file_id string")
    told = detect.notes(files, cells.union(lone), found, extent)
    assert {r.file_id: r.note for r in told.collect()} == {"f": "header found but no data rows beneath it", "lone": "no plausible header row found", "none": "sheet is empty"}
