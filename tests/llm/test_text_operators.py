"""Token counts, BPE, near copies, repeats and decontamination against brute force on awkward tables."""

import hashlib
import random
import re

import pytest

from tallyforge.llm import bpe_codec, decontaminate, license_scan, ngram_join, queries, substring_dedup, token_counts
from tests.llm import helpers


def same(got, expected):
    order = lambda rows: sorted(map(repr, rows))
    assert order(map(tuple, got)) == order(expected)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module", autouse=True)
def small_steps():
    from tallyforge.llm import _buffers

    held, _buffers.STEP_BYTES = _buffers.STEP_BYTES, 1 << 12
    yield
    _buffers.STEP_BYTES = held


def test_token_counts(spark):
    import sentencepiece

    docs = helpers.awkward(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.public_path("piece_bpe_32k.model"))
    expected = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in pairs(docs)]
    same(token_counts.count_tokens(docs).collect(), expected)
    assert token_counts.count_tokens(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", "a  ", " a", "  a  b ", "a▁ b", "\n a", "a\n  b\n"])
def test_token_pieces(text):
    count = token_counts.counter(token_counts.public_path("piece_bpe_32k.model"))
    assert count.safe
    assert count([text]) == [len(count.model.encode(text))]


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    docs = helpers.awkward(spark)
    tk = Tokenizer.from_file(bpe_codec.public_path("byte_bpe_50k.json"))
    expected = []
    for i, t in pairs(docs):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe_codec.encode(docs, digests=True).collect(), expected)
    back = bpe_codec.decode(bpe_codec.encode(docs))
    same(back.collect(), [(i, t or "") for i, t in pairs(docs)])
    assert bpe_codec.encode(helpers.empty(spark)).count() == 0


def test_lexicon_is_minimal_and_exact():
    vocab = bpe_codec.vocabulary(bpe_codec.public_path("byte_bpe_50k.json"))
    words = [b" walking", b" talking", b" walked", b" talked", b"walk", b" w"]
    lexicon = bpe_codec.Lexicon.mapped(bpe_codec.Lexicon.compile({w: vocab.merge(w) for w in words}).dump())
    assert len(lexicon.final) < sum(map(len, words)) / 2  # suffixes are shared
    import numpy as np

    asked = [*words, b" walks", b"", b" walkin"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    sizes = np.array([len(w) for w in asked])
    ranks = lexicon.ranks(data, np.cumsum(sizes) - sizes, sizes)
    assert sorted(ranks[: len(words)]) == list(range(len(words))) and (ranks[len(words) :] == -1).all()
    many, counts = vocab.merge_many(data, np.cumsum(sizes) - sizes, sizes)
    assert many.tolist() == [k for w in asked for k in vocab.merge(w)] and counts.tolist() == [len(vocab.merge(w)) for w in asked]


def test_near_copies(spark):
    docs = helpers.awkward(spark)
    same(ngram_join.classes(docs).collect(), helpers.linked(pairs(docs)))
    assert ngram_join.classes(helpers.empty(spark)).count() == 0


def test_near_copies_with_crowded_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 2)
    docs = helpers.awkward(spark)
    same(ngram_join.classes(docs).collect(), helpers.linked(pairs(docs)))


def test_near_copies_of_regular_words_and_string_ids(spark):
    bits = [bin(k).count("1") % 2 for k in range(1 << 12)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)  # Thue-Morse words cancel in sums modulo 2**64
    tail = helpers.sentence(random.Random(3), 120)
    rows = [("a", one), ("b", two), ("c", one), ("d", f"{one} {tail}"), ("é", f"{tail} x"), (None, f"{tail} y"), ("z", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.classes(docs).collect()}
    assert got == {"a": "a", "b": "b", "c": "a", "d": "d", "é": "d", None: "d", "z": "z"}
    numbered = spark.createDataFrame([(k, t + " " + tail) for k, (_, t) in enumerate(rows[:3])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(numbered).collect()} == {0: 0, 1: 120, 2: 121}


def test_repeats(spark):
    docs = helpers.awkward(spark)
    brute = helpers.without_repeats(pairs(docs))
    got = substring_dedup.remove_repeats(docs, digests=True).collect()
    same(got, [(i, n, k, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, n, k, kept in brute])
    texts = {r.doc_id: r.text for r in substring_dedup.rewrite(docs).collect()}
    for (i, t), (_, _, k, kept) in zip(pairs(docs), brute, strict=True):
        if i is not None:
            assert texts[i] == (" ".join(kept) if k else t)
    assert substring_dedup.rewrite(docs).columns == docs.columns and substring_dedup.rewrite(docs).count() == docs.count()
    assert substring_dedup.remove_repeats(helpers.empty(spark)).count() == 0


def test_cover_meets_every_difference():
    p, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))


def test_decontamination(spark):
    docs = helpers.awkward(spark)
    text = dict(pairs(docs))
    bench = spark.createDataFrame([(1, text[9][300:420]), (2, "One two!"), (3, None), (4, ""), (None, "alpha"), (1, text[9][300:420]), (11, text[10][:150])], "item_id long, text string")
    items = {}
    for r in bench.collect():
        w = re.findall(helpers.PLAIN_WORD, helpers.lower(r.text or ""))
        if w and r.item_id is not None:
            items.setdefault(str(r.item_id), set()).update(helpers.windows(w, min(10, len(w))))
    expected = []
    for i, t in pairs(docs):
        w = re.findall(helpers.PLAIN_WORD, helpers.lower(t or ""))
        hit, found = set(), set()
        for item, wins in items.items():
            for k in range(len(w)):
                for g in wins:
                    if tuple(w[k : k + len(g)]) == g:
                        hit.update(range(k, k + len(g)))
                        found.add(item)
        expected.append((i, len(w), len(hit), sorted(found), bool(hit)))
    got = decontaminate.find_hits(docs, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    same(got, expected)
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not e[4] for e in expected)
    assert decontaminate.find_hits(helpers.empty(spark), bench).count() == 0
    none = decontaminate.find_hits(docs, bench.limit(0))
    assert none.count() == docs.count() and none.where("contaminated").count() == 0


def test_licenses(spark):
    docs = helpers.awkward(spark)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert got[18].labels == ["cc-by", "cc-by-nc-4.0", "reserved"] and got[18].base_labels == ["cc-by", "reserved"] and [p["at"] for p in got[18].places] == [2, 7]
    assert got[19].labels == ["mit"] and got[19].base_labels == [] and got[19].score == 1.0
    assert got[1].labels == [] and got[1].score == 0.0 and got[4].n_words == 0
    assert license_scan.scan_licenses(docs).count() == docs.count()
    assert license_scan.scan_licenses(helpers.empty(spark)).count() == 0


def test_license_containment_against_brute_force(spark):
    words = "this work is licensed under the gnu general public license version 3".split()
    texts = [(k, " ".join(words[:k] + ["zzz"] * (12 - k)) + ".") for k in range(13)]
    got = {r.doc_id: "gpl-3.0" in r.labels for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {k: k >= 0.8 * 12 for k, _ in texts}


def test_every_template_matches_its_own_text(spark):
    rows, rng = [], random.Random(4)
    for label, text in license_scan.TEMPLATES.items():
        w = text.split(" ")
        lines = [" ".join(w[k : k + 4]) for k in range(0, len(w), 4)]
        for form in (text, "\n".join(lines), "".join(f"# {x}\r\n" for x in lines), "\n".join(f" * {x}" for x in lines)):
            rows.append((len(rows), label, form))
            rows.append((len(rows), label, f"{helpers.sentence(rng, 70 + len(rows))}\n{form}\n{helpers.sentence(rng, 90)}"))
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, label string, text string")).collect()}
    assert [(k, label) for k, label, _ in rows if label not in got[k].labels or got[k].score < 1] == []


def test_license_windows_against_brute_force(spark):
    rng = random.Random(8)
    own = {k: re.findall(helpers.PLAIN_WORD, helpers.lower(t)) for k, t in license_scan.TEMPLATES.items()}
    rows = []
    for k in range(120):
        w = list(rng.choice(list(own.values())))
        for _ in range(rng.randint(0, 8)):
            w.insert(rng.randrange(len(w)), "zzz")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "yyy"
        around = [["xxx"] * rng.randint(0, 130) for _ in range(2)]
        rows.append((k, "".join(x + rng.choice([" ", " ", "\n", ". "]) for x in around[0] + w + around[1])))
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        plain = re.findall(helpers.PLAIN_WORD, helpers.lower(text))
        pieces = [re.findall(helpers.PLAIN_WORD, helpers.lower(x)) for x in re.split(license_scan.BLOCK_END, text)]
        expected = {p for p, q in license_scan.PHRASES.items() if q in " ".join(plain)}
        for label, t in own.items():
            views = [*pieces, *(plain[a : a + license_scan.WINDOW * len(t)] for a in range(len(plain)))]
            if max(len(set(t) & set(v)) for v in views) >= license_scan.CONTAINMENT * len(set(t)) - 1e-9:
                expected.add(label)
        assert set(got[k].labels) == expected, (k, text)


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("most", [64, 256, 1 << 16])
def test_pieces_of_a_bucket(monkeypatch, most):
    """Every posting comes in one piece, all of a hash in the same one; a very common hash stays whole."""
    import numpy as np

    monkeypatch.setattr(substring_dedup, "PIECE", most)
    rng, held, expected = np.random.default_rng(5), [], []
    for k in range(40):
        n = int(rng.integers(1, 300))
        ids = np.arange(1000 * k, 1000 * k + 9)
        hashes = np.where(rng.random(n) < 0.3, 77, rng.integers(0, 500, n)).astype(np.uint64)
        out = substring_dedup.Postings(ids, -ids, 1)
        which, at = rng.integers(0, 9, n), rng.integers(0, 50, n)
        out.send(which, hashes, at)
        ((_, *cells),) = out.rows
        held.append(substring_dedup.unpacked(*cells))
        expected += zip(ids[which].tolist(), (-ids[which]).tolist(), hashes.tolist(), at.tolist(), strict=True)
    got, seen = [], set()
    for ids, keys, hashes, at in substring_dedup.pieces(held):
        assert not seen & set(hashes.tolist())
        seen |= set(hashes.tolist())
        got += zip(ids.tolist(), keys.tolist(), hashes.tolist(), at.tolist(), strict=True)
    assert sorted(got) == sorted(expected)
