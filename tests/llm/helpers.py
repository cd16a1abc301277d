"""Small awkward tables and brute-force versions of the operators' contracts."""

import random
import re

SPACE_WORD, PLAIN_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(rng.randint(0, 40)) for _ in range(n))


def awkward(spark, parts: int = 3):
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and extra columns."""
    rng = random.Random(5)
    base, passage = sentence(rng, 200), sentence(rng, 80)
    near = base.split(" ")
    near[77] = "changed"
    rows = [
        (1, base), (2, " ".join(near)), (3, base), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "One  TWO"), (9, f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}"),
        (10, f"{passage}\n{sentence(rng, 90)}"), (11, sentence(rng, 30000)), (12, "x" * 20000), (13, passage), (13, passage), (14, passage + " " + passage), (None, base), (None, None), (15, sentence(rng, 49)), (16, sentence(rng, 50)),
        (17, "É ünïcode ñ 日本語 <|endoftext|> it's   end "), (18, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (19, "Released under the MIT License"),
    ]
    table = [(i, t, "en", "key", 7, "n_words") for i, t in rows]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, key string, id int, n_words string").repartition(parts)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, key string, id int, n_words string")


def windows(words: list[str], k: int) -> list[tuple]:
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def without_repeats(rows: list[tuple]) -> list[tuple]:
    """(id, words, removed, kept words) of rows by the contract on repeated windows."""
    key = lambda i: float("inf") if i is None else i
    split = [(i, re.findall(SPACE_WORD, t or "")) for i, t in rows]
    first: dict[tuple, float] = {}
    for i, w in split:
        for g in windows(w, 50):
            first[g] = min(key(i), first.get(g, key(i)))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k, g in enumerate(windows(w, 50)):
            if first[g] < key(i):
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), [x for x, y in zip(w, gone, strict=True) if not y]))
    return out


def linked(rows: list[tuple]) -> list[tuple]:
    """(id, set size, component) of rows by the contract on shingle sets."""
    key = lambda i: float("inf") if i is None else i
    sets = []
    for _, t in rows:
        w = re.findall(SPACE_WORD, lower(t or ""))
        sets.append(frozenset(windows(w, 5) or ([tuple(w)] if w else [])))
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low: dict[int, float] = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(key(i), low.get(root(k), key(i)))
    back = lambda x: None if x == float("inf") else x
    return [(i, len(sets[k]), back(low[root(k)]) if sets[k] else i) for k, (i, _) in enumerate(rows)]
