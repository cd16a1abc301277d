"""Templates of urls against a plain version of the tree."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tallyforge.llm import url_filters as uf


def gap(a, b, all_a, all_b):
    own, rest, rest_b = a + b, all_a + all_b - a - b, all_b - b
    if not own or not rest:
        return 0.0
    pool = all_b / (own + rest)
    error = math.sqrt(pool * (1 - pool) * (1 / own + 1 / rest))
    return abs(b / own - rest_b / rest) / error if error else 0.0


def plain(rows):
    """{(host, shape): (template, n_allow, n_block, told, sure)} by nested loops, every level of every path."""
    paths = {}
    for host, shape, label in rows:
        n, a, b = paths.get((host, tuple(shape)), (0, 0, 0))
        paths[host, tuple(shape)] = (n + 1, a + (label == "allow"), b + (label == "block"))
    t = {p: list(p[1]) for p in paths}
    add = lambda table, key, c: table.__setitem__(key, tuple(map(sum, zip(table.get(key, (0, 0, 0)), c, strict=True))))
    depth = max((len(x) for x in t.values()), default=0)
    for k in range(depth):
        own, node = {}, {}
        for p, c in paths.items():
            if len(t[p]) > k:
                add(own, (p[0], *t[p][: k + 1]), c)
                add(node, (p[0], *t[p][:k]), c)
        for p in paths:
            if len(t[p]) > k:
                (n, a, b), (all_n, all_a, all_b) = own[p[0], *t[p][: k + 1]], node[p[0], *t[p][:k]]
                if n < uf.SUPPORT or (n < uf.SHARE * all_n and gap(a, b, all_a, all_b) < uf.APART):
                    paths_k = t[p]
                    t[p] = [*paths_k[:k], "*", *paths_k[k + 1 :]]
    path = {p: "/" + "/".join(x) for p, x in t.items()}
    for k in range(depth - 1, -1, -1):
        children, branches = defaultdict(Counter), {}
        for p, c in paths.items():
            if len(t[p]) > k:
                at = (p[0], *t[p][: k + 1])
                children[at][t[p][k + 1] if len(t[p]) > k + 1 else "."] += c[0]
                add(branches, at, c)
        families = defaultdict(list)
        for at, below in children.items():
            families[at[:-1], min(below, key=lambda x: (-below[x], x))].append(at)
        name = {}
        for (_, family), members in families.items():
            pooled, everything = sum((children[m] for m in members), Counter()), tuple(map(sum, zip(*(branches[m] for m in members), strict=True)))
            for m in members if len(members) > 1 else []:
                n, a, b = branches[m]
                chi = sum((children[m][x] - n * pooled[x] / everything[0]) ** 2 / (n * pooled[x] / everything[0]) for x in pooled)
                free = len(pooled) - 1
                if chi <= free + uf.DIFFERENT * math.sqrt(2 * free) + 1e-9 and gap(a, b, *everything[1:]) < uf.DIFFERENT:
                    name[m] = "{" + family + "}"
        for p in paths:
            if len(t[p]) > k:
                t[p] = [*t[p][:k], name.get((p[0], *t[p][: k + 1]), t[p][k]), *t[p][k + 1 :]]
    template = {p: "/" + "/".join(x) for p, x in t.items()}
    all_a, all_b = sum(c[1] for c in paths.values()), sum(c[2] for c in paths.values())
    smooth = lambda b, n, prior: (b + uf.WEIGHT * prior) / (n + uf.WEIGHT)

    def tied(parts):
        held = [(a, b) for _, a, b in parts.values() if a + b]
        a, b = sum(x for x, _ in held), sum(x for _, x in held)
        if len(held) < 2:
            return None if not held else (a, b, False)
        p = b / (a + b)
        chi = sum((y - (x + y) * p) ** 2 / ((x + y) * p * (1 - p)) for x, y in held) if 0 < p < 1 else 0
        return a, b, chi <= len(held) - 1 + uf.DIFFERENT * math.sqrt(2 * (len(held) - 1)) + 1e-9

    by_path, by_host, own, its_paths = defaultdict(dict), defaultdict(dict), {}, defaultdict(set)
    for p, c in paths.items():
        add(by_path[path[p]], p[0], c)
        add(by_host[p[0]], template[p], c)
        add(own, (p[0], template[p]), c)
        its_paths[p[0], template[p]].add(path[p])
    out = {}
    for p in paths:
        key = p[0], template[p]
        _, a, b = own[key]
        found = [x for x in (tied(by_path[q]) for q in its_paths[key]) if x]
        pa, pb = (sum(x[0] for x in found), sum(x[1] for x in found)) if found and all(x[2] for x in found) else (0, 0)
        host = tied(by_host[p[0]])
        ha, hb = host[:2] if host and host[2] else (0, 0)
        prior = smooth(hb, ha + hb, smooth(pb, pa + pb, smooth(all_b, all_a + all_b, 0.5)))
        told = a + b or ha + hb + pa + pb
        sure = smooth(b, a + b, prior) if a + b else max(0.0, prior - uf.DIFFERENT * math.sqrt(prior * (1 - prior) / (told + uf.WEIGHT))) if told else 0.0
        out[p] = (template[p], a, b, told, round(sure, 9))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_templates_are_those_of_the_plain_tree(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(900):
        host, kind = rng.choice(["a.com", "b.com", "c.net", "d.org"]), rng.choice(["shop", "news", "blog", "wiki", "help"])
        shape = [kind, rng.choice(["<number>", "<date>", f"item-{rng.randint(0, 60)}"]), *(rng.choice("xyz") for _ in range(rng.randint(0, 2)))]
        rate = {"shop": 0.9, "news": 0.02}.get(kind, 0.5 if host == "a.com" else 0.1)
        label = None if host == "d.org" or rng.random() < 0.4 else "block" if rng.random() < rate else "allow"
        rows.append((host, shape, label))
    if seed == 0:
        rows += [("deep.net", ["p"] * 13 + [f"q{k % 4}"] * (k % 3), "block" if k % 4 else None) for k in range(24)]
    rows += [("deep.net", [f"s{k}" for k in range(30)], None), ("deep.net", [], "allow"), ("deep.net", [], None)]
    got = uf.templates(spark.createDataFrame(rows, "host string, shape array<string>, label string")).collect()
    due = plain(rows)
    assert len(got) == len(due)
    assert {(r.host, tuple(r["shape"])): (r.template, r.n_allow, r.n_block, r.told, round(r.sure, 9)) for r in got} == due


def test_no_rejection_without_evidence(spark):
    both = [("a.com", ["shop", "<number>"], "block")] * 60 + [("b.com", ["shop", "<number>"], "block")] * 60
    split = [("a.com", ["blog", "<number>"], "block")] * 60 + [("b.com", ["blog", "<number>"], "allow")] * 40
    lone = [("a.com", ["only", "<number>"], "block")] * 60
    new = [(f"{x}.net", [x, "<number>"], None) for x in ("shop", "blog", "only") for _ in range(4)]
    found = uf.templates(spark.createDataFrame(both + split + lone + new, "host string, shape array<string>, label string")).collect()
    by = {(r.host, r["shape"][0]): r for r in found}
    assert by["a.com", "shop"].sure >= uf.REJECT and by["a.com", "shop"].told >= 60
    assert by["shop.net", "shop"].sure >= uf.REJECT and by["shop.net", "shop"].told == 120  # two hosts agree
    assert by["blog.net", "blog"].sure == 0 == by["blog.net", "blog"].told  # hosts differ
    assert by["only.net", "only"].sure == 0 == by["only.net", "only"].told  # one host shows nothing of others
