"""Workbooks into the warehouse, by stream and at once."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.plans.consolidate import Words
from tallyforge.plans.warehouse import Warehouse
from tallyforge.sources import workbooks
from tallyforge.streaming.ingest import Ingest, Product, Setup

HEAD = ["N° Contrat", "Date d'effet", "Prime nette", "Frais"]


def book(folder, name, n, start=0, extra=0.0):
    os.makedirs(folder, exist_ok=True)
    rows = [["Etat des ventes"], [], HEAD, *[[f"C-{start + k}", dt.date(2025, 1, 1 + k), 10.5 + k + extra, 2] for k in range(n)], ["Total", None, 1, 2]]
    workbooks.write({"Ventes": rows}, f"{folder}/{name}")


@pytest.fixture
def setup(spark):
    aliases = [("seed", None, a, c) for a, c in (("n contrat", "num_contrat"), ("date d effet", "date_effet"), ("prime nette", "prime_nette"), ("frais", "frais"))]
    fields = [("num_contrat", "identifier"), ("date_effet", "date"), ("prime_nette", "money"), ("frais", "money"), ("prime_totale", "money")]
    rules = {"prime_totale": [("sum", ["prime_nette", "frais"])]}
    return Setup(
        spark.createDataFrame([("alpha", "ALPHA"), ("beta", "BETA")], "token string, code string"), spark.createDataFrame([("vie", "vie", None), ("auto", "auto", None)], "token string, produit string, partners array<string>"),
        Words(spark.createDataFrame(aliases, "tier string, scope string, alias string, canonical string")), {"vie": Product(fields, rules, ["num_contrat"]), "auto": Product(fields[:4])},
    )


def table(w, product):
    return sorted((os.path.basename(r.source_file), r.banque, r.mois_reception, r.num_contrat, str(r.date_effet), r.prime_nette, r.source_row) for r in w.read(product).collect())


def fill(root):
    book(f"{root}/Alpha/vie", "v_202501.xlsx", 3)
    book(f"{root}/Beta/vie", "v_202502.xlsx", 2, 50)
    book(f"{root}/Alpha/auto", "a_202501.xlsx", 4, 100)
    book(f"{root}/Gamma/auto", "a_202501.xlsx", 4)
    book(f"{root}/Alpha/boat", "b_202501.xlsx", 4)
    with open(f"{root}/Beta/vie/bad_202503.xlsx", "w") as f:
        f.write("no workbook")


def due(name, bank, month, n, start):
    return [(name, bank, month, f"C-{start + k}", f"2025-01-{1 + k:02d}", 10.5 + k, 4 + k) for k in range(n)]


def test_stream_restarts_within_a_batch(spark, setup, tmp_path, monkeypatch):
    root = f"{tmp_path}/in"
    fill(root)
    w = Warehouse(spark, f"file://{tmp_path}/w")
    ingest = Ingest(spark, w, setup, clock=lambda: "t")
    append, calls = w.append, []

    def dying(product, *a, **b):
        calls.append(product)
        if len(calls) == 2:
            raise RuntimeError("killed between two products")
        return append(product, *a, **b)

    monkeypatch.setattr(w, "append", dying)
    with pytest.raises(Exception, match="killed"):
        ingest.stream(root, f"{tmp_path}/check").awaitTermination()
    assert calls == ["auto", "vie"] and w.products() == ["auto"]
    monkeypatch.setattr(w, "append", append)
    ingest.stream(root, f"{tmp_path}/check").awaitTermination()
    assert table(w, "auto") == due("a_202501.xlsx", "ALPHA", "2025-01", 4, 100) and w.versions("auto") == [1]
    assert table(w, "vie") == due("v_202501.xlsx", "ALPHA", "2025-01", 3, 0) + due("v_202502.xlsx", "BETA", "2025-02", 2, 50)
    first = w.read("vie").first()
    assert (first.prime_totale, first.prime_totale_source) == (first.prime_nette + 2, "derived")
    ingest.stream(root, f"{tmp_path}/check").awaitTermination()  # nothing new
    assert w.versions("vie") == [1]
    problems = {os.path.basename(os.path.dirname(os.path.dirname(r.path))) + "/" + os.path.basename(r.path): r.error for r in spark.read.parquet(f"{w.root}/problems").collect()}
    assert problems == {"Gamma/a_202501.xlsx": "no known bank in the path", "Alpha/b_202501.xlsx": "no known product in the path", "Beta/bad_202503.xlsx": "unreadable workbook: BadZipFile"}


def test_changed_and_unchanged_files(spark, setup, tmp_path):
    root = f"{tmp_path}/in"
    book(f"{root}/Alpha/vie", "v_202501.xlsx", 3)
    book(f"{root}/Beta/vie", "v_202502.xlsx", 2, 50)
    w = Warehouse(spark, f"file://{tmp_path}/w")
    ingest = Ingest(spark, w, setup)
    ingest.catch_up(root)
    assert ingest.catch_up(root) == {} and w.versions("vie") == [1]
    book(f"{root}/Alpha/vie", "v_202501.xlsx", 2, extra=100)
    assert ingest.catch_up(root) == {"vie": {"written": 2, "replaced": 3}}
    assert sorted(r.prime_nette for r in w.read("vie").collect()) == [10.5, 11.5, 110.5, 111.5]
    assert w.read("vie").select(F.max("mois_reception")).first()[0] == "2025-02"


def test_run_with_all_its_parts(spark, tmp_path):
    """Format dictionaries, overrides, content warnings, lost claims, reasons, notes, gates and counts."""
    from tallyforge.plans import consolidate

    def cells(name, lines):
        for r, line in enumerate(lines, 1):
            for c, v in enumerate(line, 1):
                if v is not None:
                    number = isinstance(v, int | float)
                    yield (name, r, c, "n" if number else "s", None if number else v, float(v) if number else None, None)

    body = [[f"C{k}", 10.0 + k, 3, "text"] for k in range(8)]
    sheets = {
        "plain": [["Contrat", "Prime", "Primes", "Libelle"], *body, [], ["C9", 5.0, 3, "text"], ["Total", 1, 2, "x"]],
        "named": [["Contrat", "PX", "Primes", "Libelle"], *body],
        "empty": [["Contrat", "Prime"], ["Total", 3]],
    }
    table = spark.createDataFrame([c for n, s in sheets.items() for c in cells(n, s)], "file_id string, row int, col int, kind string, s string, n double, d date")
    files = spark.createDataFrame([(n, n, "S", "ALPHA", "vie", "2025-02" if n == "named" else "2025-01", "fmt" if n == "named" else None) for n in [*sheets, "nothing"]], "file_id string, path string, sheet string, bank string, produit string, period string, source_format string")
    words = consolidate.Words(
        spark.createDataFrame([("seed", None, "contrat", "num_contrat"), ("seed", None, "prime", "prime_nette"), ("seed", None, "primes", "prime_nette")], "tier string, scope string, alias string, canonical string"),
        spark.createDataFrame([("fmt", "contrat", "num_contrat"), ("fmt", "px", "prime_nette")], "source_format string, alias string, canonical string"),
        spark.createDataFrame([("libelle", "note")], "normalized string, field string"),
        spark.createDataFrame([("prime_nette", "numeric", 0.0, 15.0, None, None), ("note", "numeric", None, None, None, None)], "canonical string, mostly string, min_value_due double, max_value_due double, min_unique double, max_unique double"),
    )
    run = consolidate.consolidate(table, files, words, [("num_contrat", "identifier"), ("prime_nette", "money"), ("note", "text")], {}, "t")
    got = {(r.file_id, r.header): (r.canonical, r.method, r.suggestions, r.warnings) for r in run.mappings.collect()}
    above, few = ["above the largest value"], ["too few numbers"]
    assert got["plain", "Prime"] == ("prime_nette", "seed", [], above) and got["named", "PX"] == ("prime_nette", "source", [], above)
    canonical, method, suggestions, warnings = got["plain", "Primes"]
    assert (canonical, suggestions, warnings) == (None, ["prime_nette"], ["another column has prime_nette"])
    assert got["named", "Primes"][0] is None  # a named format has its dictionary alone
    assert got["plain", "Libelle"] == ("note", "manual", [], few) and got["named", "Libelle"][:2] == ("note", "manual")
    assert {r.file_id: r.note for r in run.notes.collect()} == {"empty": "header found but no data rows beneath it", "nothing": "sheet is empty"}
    assert sorted((r.file_id, r.row, r.reason) for r in run.dropped.collect()) == [("empty", 2, "no record beneath the header"), ("plain", 10, "blank row inside table"), ("plain", 12, "beyond the end of the table")]
    w = Warehouse(spark, f"file://{tmp_path}/w")
    assert run.commit(w, "vie", ["num_contrat"])["refused"] == "review" and w.products() == []
    done = run.commit(w, "vie", ["num_contrat"], allow_review=True)
    assert done["conserved"] and (done["written"], done["lines"], done["blank"], done["columns"], done["error"]) == (17, 18, 1, 8, 0)
    assert run.commit(w, "vie", ["num_contrat", "note", "prime_nette"], allow_review=True)["replaced"] == 17
    missing = consolidate.consolidate(table.where("not (col = 1 and s = 'C3')"), files, words, [("num_contrat", "identifier"), ("prime_nette", "money"), ("note", "text")], {}, "t")
    refused = missing.commit(w, "vie", ["num_contrat"], allow_review=True)
    assert (refused["refused"], refused["error"]) == ("errors", 2)
