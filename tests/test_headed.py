"""Row records that carry their sheet's header and end: nothing is joined or put in order again for them."""

from pyspark.sql import functions as F

from tallyforge.operators import detect


def sheets(spark):
    """a: two header rows, a blank row and a total; b: columns beyond the mask, a gap that ends it; c: a header only; d: numbers only."""
    rows = {
        "a": {1: ["Etat des ventes"], 3: ["Contrat", "Prime", "Prime"], 4: [None, "nette", "totale"], 5: ["C-1", 10.0, 12.0], 7: ["C-2", 11.0, 13.0], 8: ["TOTAL", 21.0, 25.0], 9: ["C-9", 1.0, 1.0]},
        "b": {2: ["Contrat", *[None] * 69, "Prime"], **{r: [f"C-{r}", *[None] * 69, float(r)] for r in (3, 4, 5, 9)}, 6: [None, 7.0]},
        "c": {1: ["Contrat", "Prime"], 2: ["TOTAL", 5.0]},
        "d": {1: [1.0], 2: [2.0]},
    }
    cells = [(f, r, k, "s" if isinstance(v, str) else "n", v if isinstance(v, str) else None, v if isinstance(v, float) else None, None) for f, own in rows.items() for r, line in own.items() for k, v in enumerate(line, 1) if v is not None]
    return detect.filled(spark.createDataFrame(cells, "file_id string, row int, col int, kind string, s string, n double, d date"))


def test_records_with_headers_equal_the_joined_ones(spark, tmp_path):
    cells, words = sheets(spark), spark.createDataFrame([("contrat",), ("prime",), ("prime",), (None,)], "norm string")
    detect.headed(cells, words).write.parquet(f"{tmp_path}/rows")
    detect.sheet_rows(cells).write.parquet(f"{tmp_path}/plain")
    rows, plain = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("rows", "plain"))
    found = detect.headers(rows, words)
    assert sorted(tuple(r)[:3] for r in found.collect()) == [("a", 3, 4), ("b", 2, 2), ("c", 1, 1)]
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(found, detect.headers(plain, words))
    extent = detect.extents(rows, found).persist()
    assert {r.file_id: (r.data_start, r.data_end, r.cut) for r in extent.collect()} == {"a": (5, 7, 8), "b": (3, 5, 7)}
    assert same(extent, detect.extents(plain, found))
    dropped = detect.dropped_rows(rows, found, extent)
    assert {(r.file_id, r.row): r.reason for r in dropped.collect()} == {
        ("a", 1): "above the header row", ("a", 6): detect.BLANK, ("a", 8): "beyond the end of the table", ("a", 9): "beyond the end of the table",
        ("b", 6): "too sparse to be a record", ("b", 9): "beyond the end of the table", ("c", 2): "no record beneath the header",
    }
    assert same(dropped, detect.dropped_rows(plain, found, extent))
    assert same(detect.header_labels(rows, found), detect.header_labels(plain, found))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(detect.extents(rows, found)) + plan(dropped) and "Join" not in plan(detect.header_labels(rows, found))


def test_whole_numbers_as_text(spark):
    from tallyforge.functions import text

    values = [0.0, -0.0, -7.0, 999999999999999.0, 1e15, 123456789012345680.0, 1e22, -1e15, 1.5]
    got = spark.createDataFrame([(v,) for v in values], "n double").select("n", text.identifier_of_number(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == ["0", "0", "-7", "999999999999999", "1000000000000000", "123456789012345680", "1.0E22", "-1000000000000000", "1.5"]
