"""The workbook formats: reading as a data source, and deliveries in parts."""

import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import detect
from tallyforge.sources import workbooks, xlsx

MERGED = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData><mergeCells count="2">{merged}</mergeCells></worksheet>'


@pytest.fixture
def folder(tmp_path):
    day = dt.date(2025, 3, 4)
    (tmp_path / "b").mkdir()
    workbooks.write({"Param": [["x"]], "Ventes": [["Contrat", "Prime", "Total"], ["C1", 10.5, "=B2+1"], ["C2", True, "=B3+1"], [None, day, None]]}, tmp_path / "b" / "one.xlsx")
    workbooks.write({"Ventes": [["a", "b"], ["c", "d"]], "Big": [[k, k] for k in range(300)], "Long": [["x"] for _ in range(190)]}, tmp_path / "two.XLSM")
    workbooks.write({"S": []}, tmp_path / "empty.xlsx")
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04 no zip")
    (tmp_path / "csv.xlsx").write_text("a;b\n1;2")
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    for name in ("~$lock.xlsx", ".hidden.xlsx", "notes.txt"):
        (tmp_path / name).write_text("")
    return str(tmp_path)


def test_one_task_a_file(spark, folder):
    workbooks.register(spark)
    source = spark.read.format("workbooks")
    cells = source.load(folder)
    assert cells.rdd.getNumPartitions() == 6
    errors = {os.path.basename(r.path): (r.error, r.note) for r in cells.where("error is not null").collect()}
    assert errors == {"bad.xlsx": ("unreadable workbook: BadZipFile", None), "csv.xlsx": ("unreadable workbook: BadZipFile", None), "old.xls": ("unreadable workbook: BadZipFile", workbooks.OLD_NOTE), "empty.xlsx": ("no cells", None)}
    sheets = {(os.path.basename(r.path), r.sheet) for r in cells.where("error is null").select("path", "sheet").distinct().collect()}
    assert sheets == {("one.xlsx", "Ventes"), ("two.XLSM", "Big")}  # most cells in the first 200 rows
    wanted = source.option("sheets", "nothing|VENTES").load(f"file://{folder}").where("error is null")
    assert {(os.path.basename(r.path), r.sheet) for r in wanted.select("path", "sheet").distinct().collect()} == {("one.xlsx", "Ventes"), ("two.XLSM", "Ventes")}
    every = source.option("sheets", "*").load(folder)
    both = workbooks.read(workbooks.find(spark, folder, content=True))
    key = lambda df: sorted(repr((os.path.basename(r.path), *r[1:])) for r in df.collect())
    assert key(every) == key(both) and every.where("error is null").select("sheet").distinct().count() == 4
    hashes = {(os.path.basename(r.path), r.content_hash) for r in every.select("path", "content_hash").distinct().collect()}
    assert hashes == {(os.path.basename(r.path), r.content_hash) for r in workbooks.find(spark, folder, content=True).collect()}


def test_filters_keep_files_and_sheets_unread(spark, folder):
    workbooks.register(spark)
    cells = spark.read.format("workbooks").option("sheets", "*").load(folder)
    own = cells.where(F.col("path") == f"{folder}/two.XLSM").where(F.col("sheet").isin("Ventes", "Long"))
    assert own.rdd.getNumPartitions() == 1 and own.count() == 4 + 190


def test_formulas_without_values(spark, folder):
    workbooks.register(spark)
    cells = spark.read.format("workbooks").load(folder).where("error is null").withColumn("file_id", F.element_at(F.split("path", "/"), -1))
    own = detect.filled(cells)
    found = detect.headers(own, spark.createDataFrame([("contrat",), ("prime",), ("total",)], "norm string"))
    labels = detect.header_labels(own, found)
    assert [tuple(r) for r in detect.uncached_columns(cells, found, labels).collect()] == [("one.xlsx", 3, "Total")]
    assert [tuple(r) for r in workbooks.uncached_formulas(cells).select("sheet", "col").collect()] == [("Ventes", 3)]


def test_merged_ranges(tmp_path):
    at = tmp_path / "m.xlsx"
    workbooks.write({"S": [["x"]]}, at)
    rows = '<row r="1"><c r="A1"><v>1</v></c><c t="inlineStr"><is><t>next</t></is></c></row><row r="4"><c r="B4"><v>4</v></c></row><row r="9"><c r="A9"><v>9</v></c></row>'
    with zipfile.ZipFile(at) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/sheet1.xml"] = MERGED.format(rows=rows, merged='<mergeCell ref="B4:C6"/><mergeCell ref="A1:A2"/><mergeCell ref="D1:E1"/>').encode()
    with zipfile.ZipFile(at, "w") as z:
        for n, body in parts.items():
            z.writestr(n, body)
    book = xlsx.Book(at.read_bytes())
    got = [(r, c, n if s is None else s) for r, c, _, s, n, *_ in book.cells(book.sheets[0][2])]
    assert got == [(1, 1, 1.0), (1, 2, "next"), (2, 1, 1.0), *[(r, c, 4.0) for r in (4, 5, 6) for c in (2, 3)], (9, 1, 9.0)]
    assert [x[:2] for x in book.cells(book.sheets[0][2], 5)] == [(1, 1), (1, 2), (2, 1), (4, 2), (4, 3), (5, 2), (5, 3)]


def delivered(spark, folder):
    cells = spark.read.format("workbooks").load(folder).where("row > 1")
    rows = cells.groupBy("path", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("s", F.col("n").cast("string"), F.col("d").cast("string"))))).alias("c"))
    out = {}
    for r in rows.orderBy("path", "row").collect():
        out.setdefault(os.path.basename(r.path), []).append(tuple(r.c.get(k) for k in (1, 2, 3)))
    return out


def test_deliveries_in_parts(spark, tmp_path):
    frame = spark.range(25).select((F.col("id") * 7 % 25).alias("k"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B<&\x01").alias("bank"), F.lit(dt.date(2025, 1, 2)).alias("day")).repartition(5)
    at = str(tmp_path)
    workbooks.deliver(frame, at, "ventes", ["k"], limit=10, labels={"k": "Numéro"})
    assert sorted(os.listdir(at)) == ["ventes_part001.xlsx", "ventes_part002.xlsx", "ventes_part003.xlsx"]
    got = delivered(spark, at)
    assert [len(got[n]) for n in sorted(got)] == [10, 10, 5]
    assert [float(r[0]) for n in sorted(got) for r in got[n]] == list(range(25)) and all(r[2] == "2025-01-02" for n in got for r in got[n])
    assert {r[1] for n in got for r in got[n]} == {"A", "B<&", None}
    heads = spark.read.format("workbooks").load(at).where("row = 1").select("s").distinct()
    assert {r.s for r in heads.collect()} == {"Numéro", "bank", "day"}
    workbooks.deliver(frame.where("k < 4"), at, "ventes", ["k"], limit=10)
    assert os.listdir(at) == ["ventes.xlsx"]  # old parts went
    with pytest.raises(Exception, match="broken"):
        workbooks.deliver(frame.withColumn("k", F.when(F.col("k") == 24, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("k"))), at, "ventes", ["bank"], limit=10)
    assert os.listdir(at) == ["ventes.xlsx"] and len(delivered(spark, at)["ventes.xlsx"]) == 4
    workbooks.deliver(frame.limit(0), at, "ventes", ["k"])
    assert os.listdir(at) == ["ventes.xlsx"] and delivered(spark, at) == {}
    with pytest.raises(ValueError):
        workbooks.deliver(frame, at, "ventes", ["k"], limit=xlsx.MOST_ROWS)


def test_deliveries_by_bank(spark, tmp_path):
    frame = spark.range(40).select("id", F.when(F.col("id") < 30, "A").when(F.col("id") < 36, "B").alias("bank")).repartition(6)
    workbooks.deliver(frame, str(tmp_path), "v", ["id"], limit=9, by="bank")
    got = delivered(spark, str(tmp_path))
    assert {n: len(r) for n, r in got.items()} == {"A_v_part001.xlsx": 9, "A_v_part002.xlsx": 9, "A_v_part003.xlsx": 9, "A_v_part004.xlsx": 3, "B_v.xlsx": 6}
    assert [float(r[0]) for n in sorted(got) for r in got[n]] == list(range(36))


def test_failed_writer_leaves_no_draft(spark, tmp_path):
    workbooks.register(spark)
    rows = spark.range(20).selectExpr("'x' stem", "1 part", "if(id = 19, raise_error('broken'), id) v").coalesce(1)
    with pytest.raises(Exception, match="broken"):
        rows.write.format("delivery").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
