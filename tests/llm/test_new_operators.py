"""Fill-in-the-middle, whitening and streaming dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import fill_in_middle, queries, stream_dedup, whitening
from tests.llm import helpers


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def rearranged(i, t) -> tuple:
    t = t or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted([h1 % (len(w) + 1), h2 % (len(w) + 1)])
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, len(w), "plain", None, None, t
    if h4 % 100 < 20:
        return i, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    pieces = ["a", "Z", "@", "[", "`", "{", "é", "日", "𝄞", "\n", " ", "abc", "0", "<P", ">", "\x7f", "ÿ"]
    odd = [(100 + k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 300)))) for k in range(300)]
    odd += [(500, "x<P>y"), (501, "<S>"), (502, "a<M>"), (503, "a<" * 40), (504, "z" * 3_000_000), (505, "é " * 1_500_000), (None, "null id " * 9)]
    docs = helpers.awkward(spark).unionByName(spark.createDataFrame([(i, t, "en", "key", 7, "n") for i, t in odd], helpers.empty(spark).schema)).repartition(4)
    out = fill_in_middle.rearrange(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(rearranged(*r)) for r in rows)
    back = out.select("doc_id", fill_in_middle.restored().alias("t")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)
    assert fill_in_middle.rearrange(helpers.empty(spark)).count() == 0
    assert {r[2] for r in map(tuple, out.collect())} == {"plain", "psm", "spm"}


def test_rank_and_select():
    rng = random.Random(8)
    texts = ["", "a" * 700, "".join(rng.choice("ab.é") for _ in range(3000)), "", "b", "ends", "." * 1024, ""]
    body, offsets = fill_in_middle._buffers.raw(pa.array(texts))
    starts = fill_in_middle.Starts(body, offsets)
    plain, at = [], 0
    for t in texts:
        for w in re.findall("[A-Za-z]+|[^A-Za-z]", t):
            plain.append(at)
            at += len(w.encode())
    assert starts.select(np.arange(len(plain))).tolist() == plain
    places = np.arange(len(body) + 1)
    assert starts.rank(places).tolist() == np.searchsorted(plain, places).tolist()


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "label", 1) for i, v in rows], "vec_id long, embedding array<float>, whitened string, n int").repartition(parts)


def whitened(rows, k=4):
    """By the contract, with the covariance formed and decomposed whole."""
    used = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in used})
    n, sums = len(fit), np.array(fit).sum(axis=0)
    centred = np.array(fit) - sums / n
    cov = centred.T @ centred / n
    values, vec = np.linalg.eigh(cov)
    values, vec = values[::-1][:k], vec[:, ::-1][:, :k]
    return used, n, sums, values, vec, np.trace(cov)


@pytest.mark.parametrize("shape", ["spread", "clustered", "repeated", "low rank", "equal values"])
def test_whitening(spark, shape):
    rng = np.random.default_rng(3)
    d = 24
    base = rng.standard_normal((300, d))
    if shape == "spread":
        base *= np.linspace(3, 0.2, d)
    if shape == "clustered":
        base = base * 0.1 + rng.standard_normal((5, d))[rng.integers(0, 5, 300)]
    if shape == "repeated":
        base[40:] = base[0]
    if shape == "low rank":
        base[:, 2:] = 0
    if shape == "equal values":  # every sign of each axis: all eigenvalues are equal in pairs
        base = np.vstack([s * 3 * np.eye(d)[j] for s in (1, -1) for j in range(d)])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [(900, None), (901, [1.0] * (d - 1) + [None]), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1)), rows[0], (None, rows[1][1])]
    used, n, sums, values, vec, trace = whitened(rows)
    got = whitening.whiten(vectors(spark, rows)).collect()
    k = 2 if shape == "low rank" else 4
    assert len(got) == k * len(used) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert all(0 <= r.identity_error < 1e-9 for r in got)
    due = {i: x for i, x in used}
    for r in got:
        x = due[r.vec_id]
        assert r.deviation == sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums, strict=True))
        assert abs(r.explained * trace / values[r.component - 1] - 1) < 1e-9
    if shape != "equal values":
        for j in range(k):
            exact = {i: (np.array(x) - sums / n) @ vec[:, j] / np.sqrt(values[j]) for i, x in used}
            mine = [(r.whitened, exact[r.vec_id]) for r in got if r.component == j + 1]
            sign = np.sign(sum(a * b for a, b in mine))
            assert max(abs(a - sign * b) for a, b in mine) < 1e-8


def test_whitening_of_little(spark):
    same = [(k, [0.5, 0.25]) for k in range(4)]
    assert whitening.whiten(vectors(spark, same)).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    two = whitening.whiten(vectors(spark, [(1, [1.0, 0.0]), (2, [0.0]), (3, [0.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]


def test_lanczos_restarts_on_breakdown():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    for values in (np.r_[5.0, 4, 3, 3, 3, 3, 3, np.zeros(53)], np.r_[np.full(20, 2.0), np.ones(40)], np.zeros(60), np.r_[1.0, np.full(59, 1e-9)]):
        a = q * values @ q.T
        got, vec = whitening.leading(lambda v, a=a: a @ v, 60, 4, block=2)
        assert np.allclose(got, values[:4], atol=1e-12) and np.allclose(a @ vec, vec * got, atol=1e-11)
    passes = []
    a = q * np.r_[np.linspace(9, 5, 4), np.linspace(1, 0, 56)] @ q.T
    whitening.leading(lambda v: passes.append(1) or a @ v, 60, 4, block=4)
    assert len(passes) < 15  # ends by residuals, before the basis is whole


def brute(rows):
    groups: dict = {}
    key = lambda i: float("inf") if i is None else i
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    return sorted(repr((i, min(groups[t], key=key), len(groups[t]), sha(t))) for (i, _), t in zip(rows, norm, strict=True))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("dedup") / "documents.parquet")
    docs = helpers.awkward(spark)
    more = [(k, f"copy  of {k % 3}\t") for k in range(30, 800)] + [(900, "copy of 0 "), (901, " "), (902, "\n"), (903, "a b"), (904, "a b"), (29, "copy of 1 ")]
    docs.unionByName(spark.createDataFrame([(i, t, "en", "key", 7, "n") for i, t in more], docs.schema)).repartition(5).write.parquet(at)
    return at


def test_stream_dedup(spark, stored):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(stored).collect()]
    got = stream_dedup.deduplicate(spark, stored).withColumn("sha", F.lower(F.hex("digest"))).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.sha)) for r in got) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.sha for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_bytes_decide_where_digests_are_weak(spark, stored, tmp_path):
    """With 16 digests for all texts results are the same: rows that only share a digest are told apart."""
    weak = lambda t: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(t, 256), 1, 1)))
    state = f"file://{tmp_path}/state"
    stream_dedup.observe(spark, stored, state, weak)
    got = stream_dedup.decide(spark, stored, state, weak).drop("digest").collect()
    exact = stream_dedup.deduplicate(spark, stored).drop("digest").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, exact))


def test_state_goes_on_over_batches_and_runs(spark, stored, tmp_path):
    at, state = f"{tmp_path}/documents.parquet", f"file://{tmp_path}/state"
    docs = spark.read.parquet(stored)
    docs.where("doc_id % 2 = 0").repartition(3).write.parquet(at)
    stream_dedup.observe(spark, at, state, maxFilesPerTrigger=1)
    first = stream_dedup.remembered(spark, state).agg(F.sum("rows")).first()[0]
    docs.where("doc_id % 2 = 1 or doc_id is null").repartition(2).write.mode("append").parquet(at)
    stream_dedup.observe(spark, at, state, maxFilesPerTrigger=1)
    assert first < stream_dedup.remembered(spark, state).agg(F.sum("rows")).first()[0] == docs.count()
    got = stream_dedup.decide(spark, at, state).withColumn("sha", F.lower(F.hex("digest"))).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.sha)) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    stream_dedup.observe(spark, at, state)  # nothing new
    assert stream_dedup.decide(spark, at, state).count() == docs.count()
    helpers.empty(spark).write.parquet(f"{tmp_path}/none.parquet")
    assert stream_dedup.deduplicate(spark, f"{tmp_path}/none.parquet").count() == 0


def test_queries_name_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["op11_fill_in_middle"](spark, sf).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert queries.QUERIES["op13_stream_dedup"](spark, sf).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_stream_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    theirs = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    ours = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(ours.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, ours.select(*names).collect()))) == sorted(map(repr, theirs.fetchall()))
