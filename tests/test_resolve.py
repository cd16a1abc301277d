"""Headers to fields: every tier and scope, and similarity against scoring all pairs."""

import random

import pytest

from tallyforge.operators import resolve


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def score(a, b):
    words = lambda t: " ".join(sorted(t.split(" ")))
    total = len(a) + len(b)
    return max(200 * common(a, b) / total, 0.95 * 200 * common(words(a), words(b)) / total)


def headers(rng, n):
    base = ["prime nette", "prime totale", "num contrat", "date d effet", "capital assure", "frais", "code agence", "nom du client", "montant de la prime totale toutes taxes comprises pour le mois en cours", "quittance"]
    out = set()
    while len(out) < n:
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "e", "x", " ", "s", "prime ", "9"])
        words = " ".join("".join(t).split()).split(" ")
        if rng.random() < 0.3:
            rng.shuffle(words)
        out.add(" ".join(words))
    return sorted(out - {""})


@pytest.mark.parametrize("floor", [70.0, 92.0])
def test_near_pairs_are_all_pairs_of_that_score(spark, floor):
    rng = random.Random(6)
    names, aliases = headers(rng, 400), [*headers(rng, 60), "é", "𝄞 a", "a" * 130, "ab " * 45 + "c", "x" * 62, "x" * 63]
    names += ["a" * 100, "ab " * 44 + "c", "x" * 61, "x" * 64, "e", "é", "a 𝄞"]
    got = {(r.normalized, r.alias): r.score for r in resolve.near_pairs(spark.createDataFrame([(n,) for n in names * 2] + [("",), (None,)], "normalized string"), spark.createDataFrame([(a,) for a in aliases], "alias string"), floor).collect()}
    due = {(n, a): s for n in names for a in aliases if (s := score(n, a)) >= floor}
    assert got.keys() == due.keys() and all(abs(got[k] - due[k]) < 1e-9 for k in due) and len(due) > 50


def test_no_python_rows_and_no_cross_join(spark):
    plan = resolve.fuzzy(spark.createDataFrame([(1, 1, "x")], "file_id int, col int, normalized string"), spark.createDataFrame([("x", "f")], "alias string, canonical string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


ALIASES = [
    ("product", "P1", "prime", "of product"), ("product", "B1", "prime", "wrong scope"), ("bank", "B1", "prime", "of bank"), ("bank", "P1", "frais", "wrong scope"), ("global", None, "prime", "of all"), ("seed", None, "prime", "of seed"),
    ("product", "P1", "primetotale", "squeezed product"), ("seed", None, "prime totale", "total"), ("seed", None, "taux", "rate"), ("global", "P1", "agence", "scoped global"),
]


@pytest.mark.parametrize(
    "header,leaf,produit,bank,canonical,method",
    [
        ("prime", "", "P1", "B1", "of product", "product"), ("prime", "", "P2", "B1", "of bank", "bank"), ("prime", "", "P2", "B2", "of all", "global"), ("prime", "", None, None, "of all", "global"),
        ("taux", "", "P1", "B1", "rate", "seed"), ("prime totale", "", "P1", "B1", "total", "seed"), ("pri me totale", "", "P2", "B2", "total", "seed_loose"), ("primetotale", "", "P1", "B1", "squeezed product", "product"),
        ("groupe taux", "taux", "P1", "B1", "rate", "seed"), ("groupe prime", "prime", "P2", "B1", "of bank", "bank"), ("prime totale", "prime", "P1", "B1", "total", "seed"), ("frais", "", "P1", "P1x", None, None), ("agence", "", "P1", "B1", None, None), ("", "", "P1", "B1", None, None),
    ],
)
def test_tiers_and_scopes(spark, header, leaf, produit, bank, canonical, method):
    h = spark.createDataFrame([(1, 1, header, leaf, produit, bank)], "file_id int, col int, normalized string, leaf string, produit string, bank string")
    r = resolve.exact(h, spark.createDataFrame(ALIASES, "tier string, scope string, alias string, canonical string")).first()
    assert (r.canonical, r.method, r.confidence) == (canonical, method, 1.0 if canonical else None)


EXPECTED = "canonical string, mostly string, min_value_due double, max_value_due double, min_unique double, max_unique double"
PROFILE = "file_id string, col int, total long, non_blank long, numeric_ratio double, date_ratio double, unique_ratio double, min_value double, max_value double, mean_length double"


def test_shifted_headers(spark):
    from tallyforge.operators import shift

    kinds = {"id": (0.0, 0.0), "date": (0.0, 1.0), "money": (1.0, 0.0)}
    tables = {"fine": ["id", "date", "money"], "right": [None, "id", "date", "money"], "left": ["date", "money", "id"], "lone": ["money"]}
    profile = [(f, k, 9, 9, *kinds[x], 1.0, None, None, 5.0) for f, cols in tables.items() for k, x in enumerate(cols, 1) if x]
    fields = {"fine": ["id", "date", "money"], "right": ["id", "date", "money"], "left": ["id", "date", "money"], "lone": ["money"]}
    mappings = spark.createDataFrame([(f, k, x, "seed", 1.0) for f, names in fields.items() for k, x in enumerate(names, 1)] + [("right", 4, None, None, None)], "file_id string, col int, canonical string, method string, confidence double")
    profiles = spark.createDataFrame(profile, PROFILE)
    expected = spark.createDataFrame([("id", "identifier", None, None, None, None), ("date", "date", None, None, None, None), ("money", "numeric", None, None, None, None)], EXPECTED)
    plan = shift.proposals(mappings, profiles, expected)
    assert sorted((r.file_id, r.col, r.field, r.confidence) for r in plan.where("field is not null").collect()) == [("right", 2, "id", 1.0), ("right", 3, "date", 1.0), ("right", 4, "money", 1.0)]
    told = resolve.content_warnings(profiles.join(mappings, ["file_id", "col"]), expected).select("file_id", "col", "warnings")
    done = shift.accept(mappings.join(told, ["file_id", "col"], "left"), plan).collect()
    assert sorted((r.col, r.canonical, r.method) for r in done if r.file_id == "right" and r.canonical) == [(2, "id", "model-table"), (3, "date", "model-table"), (4, "money", "model-table")]
    assert all(not r.planned for r in done if r.file_id != "right") and {r.canonical for r in done if r.file_id == "left"} == {"id", "date", "money"}


@pytest.mark.parametrize(
    "offers,accepted",
    [
        ([(1, "b", 0.8, []), (2, "a", 0.8, [])], True), ([(1, "b", 0.8, [])], False), ([(1, "b", 0.6, []), (2, "a", 0.8, [])], False), ([(1, "c", 0.8, ["x"])], False), ([(1, "c", 0.8, [])], True),
        ([(1, "zz", 0.9, [])], False), ([(1, None, 0.9, [])], True), ([(9, "c", 0.9, [])], False), ([(1, "a", 0.9, [])], False), ([], False), ([(1, "c", 0.8, []), (1, "b", 0.7, [])], True),
    ],
)
def test_plans_that_hold(spark, offers, accepted):
    from tallyforge.operators import shift

    m = spark.createDataFrame([("f", 1, "a", "seed", 1.0, ["x"]), ("f", 2, "b", "seed", 1.0, [])], "file_id string, col int, canonical string, method string, confidence double, warnings array<string>")
    p = spark.createDataFrame([("f", *o) for o in offers], "file_id string, col int, field string, confidence double, warnings array<string>")
    assert any(r.planned for r in shift.accept(m, p, ["a", "b", "c"]).collect()) == accepted
    sure = m.withColumn("warnings", resolve.F.array().cast("array<string>"))
    both = spark.createDataFrame([("f", 1, "b", 0.95, []), ("f", 2, "a", 0.95 if accepted else 0.85, [])], p.schema)
    assert any(r.planned for r in shift.accept(sure, both).collect()) == accepted  # nothing was wrong: only a plan that is sure of all
