"""URL filters, toxicity, WARC and image copies."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.llm import media, queries, toxicity, url_filters, warc
from tests.llm import helpers

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_urls_and_rules(spark):
    urls = ["https://A.Example.ORG/es/1?x", "http://example.org/en/12", "http://notexample.org/es/1", "http://x.com/de/7#a", "no scheme", None, "http://x.com", "ftp://h/a/b?c", "http://x.net/en/5", ""]
    pages = spark.createDataFrame([(k, u, "page_id") for k, u in enumerate(urls)] + [(None, "http://x.com/fr/1", "z")], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filters.judge(pages, RULES).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(10)] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("notexample.org", "/es/1", "org/"), ("x.com", "/de/7", "com/de/"), ("", "", None), ("", "", None),
        ("x.com", "", None), ("h", "/a/b", None), ("x.net", "/en/5", None), ("", "", None),
    ]
    assert got[1].verdict == got[0].verdict == got[3].verdict == "block" and got[2].verdict == "allow" and got[None].verdict == "allow"
    assert url_filters.judge(pages.limit(0), RULES).count() == 0


def test_urls_against_brute_force(spark):
    rng = random.Random(9)
    hosts = ["Example.org", "www.example.ORG", "x.com", "a.b.com", "plain.net", "example.com.net", "ORG", "com"]
    words = ["en", "es", "fr", "de", "1", "12", "a-b", "20240101", "deadbeef0123", "P9"]
    rows = []
    for k in range(400):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 14))]
        url = f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}" + "".join(f"/{p}" for p in parts) + rng.choice(["", "/", "?q=/de/", "#://x"])
        rows.append((k, url))
    rows += rows[:5] + [(500, None), (501, "no/scheme"), (None, "http://x.com/de/1"), (502, "")]
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' host", "'y' template", "1 n"), RULES).collect()
    assert len(got) == len(rows)
    counts: dict = {}
    for r in got:
        label = RULES.get(r.rule)
        old = counts.get((r.host, r.template), (0, 0))
        counts[r.host, r.template] = (old[0] + (label == "allow"), old[1] + (label == "block"))
    due = []
    for k, url in rows:
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = helpers.lower(re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        due.append((k, host, path, max(fits, key=len, default=None)))
    assert sorted(map(repr, due)) == sorted(repr(tuple(r)[:4]) for r in got)
    assert all((r.n_allow, r.n_block) == counts[r.host, r.template] and r.verdict == (RULES.get(r.rule) or ("block" if r.blocked_share >= 0.5 else "allow")) for r in got)


def test_templates_generalise_and_reject(spark):
    rows = [("h.com", ["shop", f"item-{k}"], "block" if k % 10 else "allow") for k in range(40)] + [("h.com", ["news", "<number>"], "allow")] * 12 + [("h.com", ["blog", "<number>"], None)] * 3
    rows += [("wide.com", [f"section{k}", "<number>", *["deep"] * 9, f"x{k % 2}"], "block" if k == 5 else "allow") for k in range(21) for _ in range(30)]
    rows += [("new.net", ["shop", f"item-{k}"], None) for k in range(30)] + [("new.net", ["news", "<number>"], None)] * 4
    found = url_filters.templates(spark.createDataFrame(rows, "host string, shape array<string>, label string")).collect()
    by = {(r["host"], *r["shape"]): r for r in found}
    item = by["h.com", "shop", "item-3"]
    assert item.template == by["h.com", "shop", "item-9"].template and item.template.endswith("/*") and (item.n_allow, item.n_block) == (4, 36)
    assert item.share > 0.8 and by["h.com", "news", "<number>"].share < 0.2
    assert by["h.com", "news", "<number>"].template == by["h.com", "blog", "<number>"].template  # children alike, labels don't differ
    wide = {k: by["wide.com", f"section{k}", "<number>", *["deep"] * 9, f"x{k % 2}"] for k in range(21)}
    assert wide[5].share > 0.8 and all(r.share < 0.2 for k, r in wide.items() if k != 5)  # well-supported sections stay
    assert wide[3].template == wide[7].template != wide[4].template  # merged where children are alike
    assert by["new.net", "shop", "item-2"].share > 0.5 > by["new.net", "news", "<number>"].share  # no labels of its own


def test_toxicity(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(1500):
        bad = rng.random() < 0.3
        words = helpers.sentence(rng, rng.randint(5, 60)).split()
        for _ in range(rng.randint(1, 3) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron,", "scum", "grumblefoo", "You", "pathetic!"]))
        if bad:
            words.insert(0, rng.choice(["worthless", "grumblebar"]))
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(bad) if rng.random() > 0.02 else int(not bad)))
    d = spark.createDataFrame([*docs, (None, None, "x"), (9001, "", "x"), (9001, "", "x")], "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(d, lab)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 1503 and all(0 <= r.score <= 1 for r in rows.values())
    held = [(rows[k].predicted, y) for k, y in labels if rows[k].held_out]
    assert np.mean([p == y for p, y in held]) > 0.93
    names = {c: "x" for c in (*toxicity.NAMES, "features", "prediction", "probability", "rawPrediction", "score", "id")}
    clashing = d.select("doc_id", "text", *(F.lit(v).alias(c) for c, v in names.items()))
    kept = toxicity.remove_toxic(clashing, lab)
    assert kept.columns == clashing.columns and kept.count() == sum(r.predicted == 0 for r in got.collect())
    assert toxicity.score(d.limit(0), lab).count() == 0
    assert toxicity.score(d, lab.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_with_few_labels(spark):
    rng = random.Random(6)
    texts = [(k, ("You idiot, you worthless scum " if k % 4 == 0 else "") + helpers.sentence(rng, 40)) for k in range(120)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    bad = [k for k, _ in texts if k % 4 == 0]

    def predicted(labels):
        got = toxicity.score(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        return sorted(r.doc_id for r in got if r.predicted)

    learned = lambda ks: [k for k in ks if zlib.crc32(str(k).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    some = learned(bad)
    one_fold = [k for k in some if zlib.crc32(str(k).encode()) % toxicity.FOLDS == 2]  # none in the next folds
    assert len(one_fold) >= 4
    assert predicted([(k, int(k in one_fold)) for k in range(120) if k not in bad or k in one_fold]) == bad
    assert predicted([(some[0], 1)] + [(k, 0) for k in range(120) if k not in bad]) == bad
    assert predicted([(k, 1) for k in bad]) == bad


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "u\r\nWARC-Type: x", ""), (5, "http://a/5", "x" * 200000), (5, "http://a/5", "x" * 200000), (None, "http://n", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "digest") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    index = warc.write(pages, f"file://{tmp_path}/w")
    got = warc.read(index, f"file://{tmp_path}/w").collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last: dict = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    expected = [(i, u, len((h or "").encode()), sha(h), "response" if i == last[h or ""] else "revisit", None if i == last[h or ""] else last[h or ""]) for i, u, h in rows]
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, expected))
    assert all((r.payload.decode() if r.payload is not None else None) == (dict((i, h or "") for i, _, h in rows)[r.id] if r.record_type == "response" else None) for r in got)
    assert warc.read(index.where("id = 5"), f"file://{tmp_path}/w").count() == 2
    assert warc.read(warc.write(pages.limit(0), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


def test_coalesced_reads():
    assert warc.coalesced([(0, 10), (10, 5), (15 + warc.GAP + 1, 4)]) == [(0, 2, 0, 15), (2, 3, 16 + warc.GAP, 20 + warc.GAP)]


def test_image_copies(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(k, rng.normal(size=64).tolist()) for k in range(60)] + [(60, None), (61, [None] * 64), (62, [1.0])], "vec_id long, embedding array<double>")
    vectors = vectors.union(vectors.where("vec_id = 7").selectExpr("vec_id + 100", "embedding"))
    found = media.find_copies(media.render(vectors.where("vec_id % 5 = 0"), edited=True), media.render(vectors)).collect()
    own = {r["query"] for r in found if r["query"] == r["image"]}
    assert len(own) >= 0.9 * 12 and len(found) <= len(own) + 1
    turned = media.render(vectors.where("vec_id = 7")).collect()[0]
    image = np.rot90(np.frombuffer(turned.pixels, np.uint8).reshape(64, 64))
    asked = spark.createDataFrame([(1, 64, 64, bytearray(image.tobytes())), (2, 3, 3, bytearray(9)), (3, 64, 64, None)], "image long, width int, height int, pixels binary")
    turned = media.find_copies(asked, media.render(vectors)).collect()
    assert [(r["query"], r["image"]) for r in turned] == [(1, 7)]
    assert media.find_copies(asked.limit(0), media.render(vectors)).count() == 0


def test_popular_keys_keep_every_pair(spark):
    """Features that share a popular quarter only, and no other, meet all the same: as a plain join by key gives them."""
    rng = random.Random(8)
    rows = [(k, 1.0, 2.0, 0, 3, (7 << 32) | rng.getrandbits(32), rng.getrandbits(63)) for k in range(150)]
    near = [(1000 + k, x, y, s, t, d0 ^ 1, d1 ^ (1 << 40) ^ 1) for k, x, y, s, t, d0, d1 in rows]
    index, asked = (media.tables(spark.createDataFrame(r, media.FEATURE)) for r in (rows, near))
    pairs = lambda i, q, by: sorted(map(tuple, q.alias("q").join(i.alias("i"), by).where(media.apart("i", "q") <= media.DISTANCE).select("q.image", "i.image", "i.key").collect()))
    plain = pairs(index, asked, ["key"])
    assert len(plain) >= 150 and {(a - 1000, b) for a, b, _ in plain} >= {(k, k) for k in range(150)}
    assert pairs(*media.spread(index, asked), ["key", "part"]) == plain


def popular_images(n: int) -> tuple[list[tuple], list[tuple]]:
    """FEATURE rows of n images and of n / 4 queries, moved by four pixels: eight features of their own and two of
    eight patterns that all share, at random places. Image n has nothing but patterns, and a query has them alike."""
    rng = random.Random(n)
    words = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(8)]
    like = lambda w: (words[w][0] ^ (1 << rng.randrange(32)), words[w][1])
    place = lambda: (12.0 * rng.randrange(4, 40), 12.0 * rng.randrange(4, 40))
    rows = [(k, *place(), 0, 3, rng.getrandbits(63), rng.getrandbits(63)) for k in range(n) for _ in range(8)]
    rows += [(k, *place(), 0, 3, *like(w)) for k in range(n) for w in rng.sample(range(8), 2)]
    rows += [(n, *place(), 0, 3, *like(w)) for w in range(8)]
    asked = [(k, x + 4, y + 4, *rest) for k, x, y, *rest in rows if k % 4 == 0]
    return rows, asked


def votes_of_all_pairs(rows: list[tuple], asked: list[tuple]) -> set[tuple]:
    """(query, image, votes) by every pair of features (unturned, of one scale) that agree in a quarter."""
    quarters = lambda r: [(r[5] >> 32, 0), (r[5] & 0xFFFFFFFF, 1), (r[6] >> 32, 2), (r[6] & 0xFFFFFFFF, 3)]
    held, cast = {}, {}
    for r in rows:
        for key in quarters(r):
            held.setdefault(key, []).append(r)
    for q in asked:
        for key in quarters(q):
            for r in held.get(key, []):
                if (r[5] ^ q[5]).bit_count() + (r[6] ^ q[6]).bit_count() <= media.DISTANCE:
                    cast.setdefault((q[0], r[0], round((r[1] - q[1]) / media.SHIFT), round((r[2] - q[2]) / media.SHIFT)), set()).add(q[1:3])
    best = {}
    for (query, image, *_), of in cast.items():
        best[query, image] = max(len(of), best.get((query, image), 0))
    return {(*k, v) for k, v in best.items() if v >= media.VOTES}


def most_joined(spark, run) -> int:
    """The most rows that an inner join gave in the executions of run()."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, every = 0, store.executionsList(before, 1000)
    for execution in (every.apply(k).executionId() for k in range(every.size())):
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Inner" in node.desc() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_popular_patterns_grow_with_the_images(spark, monkeypatch):
    """Four times the images and queries give about four times the pairs of features, not sixteen times, and the
    copies are those of all pairs, also one that only patterns which every eighth image has can show."""
    monkeypatch.setattr(media, "features", lambda images: images)
    made = {}
    for n in (80, 320):
        rows, asked = popular_images(n)
        held, queries_ = (spark.createDataFrame(r, media.FEATURE) for r in (rows, asked))
        found = []
        made[n] = most_joined(spark, lambda h=held, q=queries_, f=found: f.extend(media.matches(h, q).collect()))
        assert {(r["query"], r["image"], r["votes"]) for r in found} == votes_of_all_pairs(rows, asked) >= {(n, n, 8)}
        assert len(found) == n // 4 + 1
    assert 0 < made[320] <= 6 * made[80]


def test_pairs_of_keys(spark):
    """Every pair whose keys and whose pair are in the bitmaps passes, in the order asked, beyond a block of keys too."""
    rng = np.random.default_rng(2)
    found = spark.createDataFrame([(5, k, *rng.integers(-(2**62), 2**62, 2).tolist()) for k in range(75)], "image long, at long, d0 long, d1 long")
    keys = np.array([[r["at"], r["key"]] for r in media.keyed(found).collect()])
    mixes = [media.mixed(keys[:, 1].copy(), side) for side in range(3)]
    chosen = ((0, 299), (299, 0), (150, 150), (200, 10))
    due = {(5, int(mixes[1][a] ^ mixes[2][b]), int(keys[a, 0]), int(keys[b, 0])) for a, b in chosen}
    maps = [media.bitmap(spark.createDataFrame([(int(h),) for h in x], "key long")) for x in ([mixes[0][k] for k in {k for p in chosen for k in p}], [d[1] for d in due])]
    rows = found.collect()
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), *(pa.array([[r[c] for r in rows], [rows[0][c]]]) for c in ("at", "d0", "d1"))], names=["image", "at", "d0", "d1"])
    got = lambda *maps: [tuple(r.values()) for b in media.paired(*maps)(iter([batch])) for r in b.to_pylist()]
    assert due <= set(got(*maps)) and len(got(*maps)) < 5 * len(due)
    assert len(got(*(m | -1 for m in maps))) == 300 * 300 + 4 * 4


def test_image_members(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=64).tolist() for _ in range(4)]
    rows = [(k, vectors[0 if k % 2 else k % 4]) for k in range(1, 41)] + [(None, vectors[0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op10_image_copies(spark, str(tmp_path)).collect()
    due = {k: min(j for j, v in rows if j and v == w) for k, w in rows if k}
    listed = [(r["image"], r["representative"]) for r in got if r["query"] is None]
    assert sorted(listed) == sorted(due.items())
    assert {r["image"] for r in got if r["query"] is not None} <= set(due.values())
    images = spark.createDataFrame([(1, 2, 2, bytearray(4)), (2, 4, 1, bytearray(4)), (3, 2, 2, bytearray(4)), (4, 2, 2, None), (5, 2, 2, None)], "image long, width int, height int, pixels binary")
    assert sorted(map(tuple, media.members(images).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]
