"""Versions of the warehouse: killed, competing and damaged deliveries."""

import os
from glob import glob

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import warehouse
from tallyforge.plans.warehouse import Conflict, Warehouse, WarehouseCorrupt

SCHEMA = "source_file string, source_row int, row_hash string, v double, banque string, mois_reception string"


def rows(spark, file, n, v=1.0, bank="A"):
    return spark.createDataFrame([(file, k, f"{file}-{k}-{v}", v, bank, f"2025-{k % 12 + 1:02d}") for k in range(n)], SCHEMA)


def state(w):
    got = w.read("p")
    return None if got is None else sorted((r.source_file, r.source_row, r.v) for r in got.collect())


@pytest.fixture
def w(spark, tmp_path):
    return Warehouse(spark, f"file://{tmp_path}/w")


def test_killed_deliveries_leave_the_last_version(spark, w, monkeypatch):
    broken = rows(spark, "a", 40, 2.0).withColumn("v", F.when(F.col("source_row") == 39, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        w.append("p", broken)
    assert w.products() == [] and w.read("p") is None
    w.append("p", rows(spark, "a", 40).union(rows(spark, "b", 5)))
    before = state(w)
    with pytest.raises(Exception, match="killed"):
        w.append("p", broken)  # some of its tasks had written
    assert state(w) == before and w.versions("p") == [1]
    with monkeypatch.context() as m:
        m.setattr(w, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            w.append("p", rows(spark, "a", 3, 9.0))  # all is written but the version
    assert state(w) == before
    assert w.append("p", rows(spark, "a", 3, 9.0)) == {"written": 3, "replaced": 40}
    assert state(w) == sorted([("a", k, 9.0) for k in range(3)] + [("b", k, 1.0) for k in range(5)])
    assert sorted((r.source_file, r.v) for r in w.read("p", 1).collect()) == sorted((f, v) for f, _, v in before)


def test_competing_deliveries(spark, w, monkeypatch):
    w.append("p", rows(spark, "a", 2))
    one, two = Warehouse(spark, w.root), Warehouse(spark, w.root)
    original = one._publish

    def after(product, meta, other):
        monkeypatch.setattr(one, "_publish", original)
        two.append("p", other)
        return original(product, meta)

    monkeypatch.setattr(one, "_publish", lambda p, m: after(p, m, rows(spark, "c", 3)))
    assert one.append("p", rows(spark, "b", 4)) == {"written": 4, "replaced": 0}  # other files: both count
    assert {f for f, *_ in state(w)} == {"a", "b", "c"} and w.versions("p") == [1, 2, 3]
    monkeypatch.setattr(one, "_publish", lambda p, m: after(p, m, rows(spark, "b", 1, 7.0)))
    with pytest.raises(Conflict):
        one.append("p", rows(spark, "b", 9, 8.0))
    assert [x for x in state(w) if x[0] == "b"] == [("b", 0, 7.0)]


def test_damage_and_backups(spark, w):
    w.append("p", rows(spark, "a", 6))
    w.append("p", rows(spark, "b", 4))
    assert w.verify("p") == 10
    last = w.version("p")
    own = next(c for c in last["commits"] if c not in w.version("p", 1)["commits"])
    part = glob(f"{w.root[7:]}/fact_p/data/commit={own}/part-*.parquet")[0]
    whole = open(part, "rb").read()
    open(part, "wb").write(whole[:-20])
    with pytest.raises(WarehouseCorrupt, match="version 1 with 6 rows is whole"):
        w.read("p")
    open(part, "wb").write(whole[:40] + bytes(len(whole) - 80) + whole[-40:])  # as long as before
    with pytest.raises(WarehouseCorrupt, match="version 1 with 6 rows is whole"):
        w.verify("p")
    assert w.restore("p", 1) == 3 and w.verify("p") == 6 and {f for f, *_ in state(w)} == {"a"}
    for p in glob(f"{w.root[7:]}/fact_p/data/commit=*/part-*.parquet"):
        os.remove(p)
    with pytest.raises(WarehouseCorrupt, match="no older version is whole"):
        w.read("p")


def test_vacuum_and_compaction(spark, w, monkeypatch):
    for k in range(4):
        w.append("p", rows(spark, "a", 3, float(k)).union(rows(spark, f"f{k}", 2)))
    with monkeypatch.context() as m:
        m.setattr(w, "_publish", lambda *a: (_ for _ in ()).throw(SystemExit()))
        with pytest.raises(SystemExit):
            w.append("p", rows(spark, "dead", 3))
    before = state(w)
    assert len(before) == 3 + 4 * 2
    w.compact("p")
    assert state(w) == before and len(w.version("p")["commits"]) == 1
    assert "SortMergeJoin" not in w.read("p")._jdf.queryExecution().toString()
    assert w.vacuum("p", hours=1) and state(w) == before  # versions went, files are too young
    w.vacuum("p", keep=1, hours=0)
    assert state(w) == before and len(os.listdir(f"{w.root[7:]}/fact_p/data")) == 1 and w.versions("p") == [5]
    w.append("p", rows(spark, "a", 1, 9.0))
    assert len(state(w)) == len(before) - 2


def test_files_hashes_and_batches(spark, w):
    hashes = spark.createDataFrame([("a", "1"), ("none", "2")], "path string, content_hash string")
    assert w.append("p", rows(spark, "a", 3), hashes=hashes, batch=("s", 0)) == {"written": 3, "replaced": 0}
    assert w.append("p", rows(spark, "a", 3), hashes=hashes, batch=("s", 0)) == {"written": 0, "replaced": 0} and w.versions("p") == [1]
    files = spark.createDataFrame([("a", "1"), ("none", "3"), ("z", "9")], "path string, content_hash string")
    assert {r.path: r.status for r in w.pending(files).collect()} == {"a": "unchanged", "none": "changed", "z": "new"}
    empty = rows(spark, "a", 1).limit(0)
    assert w.append("p", empty, hashes=spark.createDataFrame([("a", "4")], "path string, content_hash string"), dry_run=True) == {"written": 0, "replaced": 3} and len(state(w)) == 3
    assert w.append("p", empty, hashes=spark.createDataFrame([("a", "4")], "path string, content_hash string")) == {"written": 0, "replaced": 3} and state(w) == []
    with pytest.raises(warehouse.facts.ContractError, match="no source_file"):
        w.append("p", rows(spark, "a", 2).withColumn("source_file", F.lit(None).cast("string")))


def test_rows_are_clustered(spark, w):
    mixed = rows(spark, "x", 60, bank="B").union(rows(spark, "y", 60, bank="A")).union(rows(spark, "z", 60, bank="C")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w.append("p", mixed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [spark.read.parquet(p).select("banque", "mois_reception", "source_file", "source_row").collect() for p in sorted(glob(f"{w.root[7:]}/fact_p/data/*/part-*.parquet"))]
    parts = [list(map(tuple, p)) for p in parts if p]
    assert len(parts) > 2 and all(p == sorted(p) for p in parts)
    parts.sort()
    assert all(a[-1] <= b[0] for a, b in zip(parts, parts[1:], strict=False))  # ranges don't overlap, so a filter by bank and month skips files
