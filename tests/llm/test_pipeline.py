"""The pipeline's stages against brute force, with repeated rows and null ids."""

import re

import pytest

import corpus_pipeline
from tallyforge.llm import bpe_codec
from tests.llm import helpers

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    d = helpers.awkward(spark)
    base = d.where("doc_id = 1")
    lone = spark.createDataFrame([(None, "some words that only rows without an id have " * 3, "en", "k", 7, "n")] * 3, d.schema)
    repeated = base.union(base).union(base.selectExpr("doc_id", "text", "'fr' lang", "key", "id", "n_words"))
    return d.union(repeated).union(lone).selectExpr("*", "length(text) n_chars")


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_near_copies_leave_one_row_of_each_class(spark, docs):
    every = docs.collect()
    linked = helpers.linked([(r.doc_id, r.text) for r in every])
    sets = [frozenset(helpers.windows(w, 5) or [tuple(w)]) if (w := re.findall(helpers.SPACE_WORD, helpers.lower(r.text or ""))) else None for r in every]
    classes: dict = {}
    for r, (_, _, low), s in zip(every, linked, sets, strict=True):
        if s is not None:  # no class of these tables has both null ids only and another's texts
            classes.setdefault(low if low is not None else s, []).append(r)
    kept = STAGES["near duplicates"](spark, docs, "")
    got = kept.collect()
    assert kept.columns == docs.columns
    assert sum(not helpers.lower(r.text or "").split() for r in got) == sum(s is None for s in sets)
    for members in classes.values():
        least = min(float("inf") if r.doc_id is None else r.doc_id for r in members)
        here = [r for r in got if r in members]
        assert len(here) == 1 and (here[0].doc_id if here[0].doc_id is not None else float("inf")) == least
    assert len(got) == len(classes) + sum(s is None for s in sets)
    assert STAGES["near duplicates"](spark, docs.limit(0), "").count() == 0


def test_other_stages(spark, docs, tmp_path):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    brute = helpers.without_repeats(pairs)
    due = sorted(repr((i, " ".join(kept) if k else t)) for (i, t), (_, _, k, kept) in zip(pairs, brute, strict=True))
    again = STAGES["substring dedup"](spark, docs, "")
    assert rows(again.select("doc_id", "text")) == due and again.where("n_chars <> length(text)").count() == 0
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = STAGES["decontamination"](spark, docs, str(tmp_path))
    assert rows(clean) == sorted(repr(tuple(r)) for r in docs.collect() if not re.search(r"\bone +two\b", helpers.lower(r.text or "")))
    codes = STAGES["encoding"](spark, docs, "").collect()
    assert sorted(repr((r.doc_id, len(r.ids))) for r in codes) == sorted(repr((r.doc_id, r.n_tokens)) for r in codes) and len(codes) == len(pairs)
    assert rows(bpe_codec.decode(STAGES["encoding"](spark, docs, ""))) == sorted(repr((i, t or "")) for i, t in pairs)
    ids = sorted({i for i, _ in pairs if i is not None})
    spark.createDataFrame([(i, int(i == 12)) for i in ids], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = STAGES["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.where("text is null").count() == docs.where("text is null").count()
