"""Byte-level BPE: encoding and decoding of whole texts through a word lexicon.

The frequent words of the corpus are compiled into a minimal acyclic transducer: states that
accept the same suffixes are one, and each arc carries a number; the sum along a word is its
rank, which finds its ids. The tables are one file that each worker maps into memory. All
distinct words of a batch walk the automaton at once; those it lacks are merged exactly.
"""

import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _buffers

#: A word is frequent if it makes up this share of the corpus' bytes as a count: at most
#: 2**20 words can reach it, whatever the corpus' size.
FREQUENT = 2.0**-20
#: Longer words are merged one by one.
WORD_BYTES = 48
#: The rank of a pair that doesn't merge.
NEVER = 1 << 40

LETTER, NUMBER, BLANK = 1, 2, 3


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Merges, bytes of each id and the special token strings of a byte-level BPE file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # Printable bytes stand for themselves, the others for the characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        hidden = {c: b for b, c in shown.items()}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        of = [b""] * size
        for token, k in ids.items():
            of[k] = token.encode() if token in self.special else bytes(hidden[c] for c in token)
        for token, k in self.special.items():
            of[k] = token.encode()
        self.byte_id = [ids[shown[b]] for b in range(256)]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[a], ids[b]] = (rank, ids[a + b])
        keys = np.array([a << 20 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks, self.pair_ids = np.array(list(self.pairs.values()), np.int64)[order].T.copy()
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.lengths = np.array([len(x) for x in of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(of), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the lowest-ranked adjacent pair first, the leftmost of equals."""
        ids, pairs = [self.byte_id[b] for b in word], self.pairs
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(pairs[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, (a, b) = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[k], ids[j] = pairs[a, b][1], -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (p := (ids[left], ids[right])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], left, p))
        return [x for x in ids if x >= 0]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, new id) of pairs of ids; NEVER where they don't merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.pair_ranks[at], NEVER), self.pair_ids[at]

    def merge_many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has); each round makes one merge in every word that has one left."""
        counts, out = np.zeros(len(starts), np.int64), {}
        order = np.argsort(lengths, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 4096)):
            if not len(part):
                continue
            width = int(lengths[part].max())
            at = np.arange(width)
            held = at < lengths[part][:, None]
            ids = np.where(held, self.byte_ids[data[np.where(held, starts[part][:, None] + at, 0)]], -1)
            ids = np.hstack([ids, np.full((len(part), 1), -1, ids.dtype)])
            ranks, _ = self.ranks_of(ids[:, :-1], ids[:, 1:])
            rows = np.arange(len(part))
            done = np.empty((len(part), width), np.int64)
            while len(rows):
                k = ranks.argmin(1)
                each = np.arange(len(rows))
                live = ranks[each, k] < NEVER
                done[rows[~live]] = ids[~live, :-1]
                rows, ids, ranks, k = rows[live], ids[live], ranks[live], k[live]
                if not len(rows):
                    break
                each = np.arange(len(rows))
                _, new = self.ranks_of(ids[each, k], ids[each, k + 1])
                shift = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > k[:, None]), width)
                ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, np.minimum(shift[:, :-1], width - 1), 1)
                ids[each, k] = new
                ranks[each, k], _ = self.ranks_of(new, ids[each, k + 1])
                left = np.flatnonzero(k > 0)
                ranks[left, k[left] - 1], _ = self.ranks_of(ids[left, k[left] - 1], new[left])
            counts[part] = (done >= 0).sum(1)
            out.update(zip(part.tolist(), done, strict=True))
        flat = [out[k][: counts[k]] for k in range(len(starts))]
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), counts


@lru_cache(maxsize=4)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, white space or other, of each code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for mark, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = mark
    return out


def word_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Byte positions at which the words of the byte-level split start.

    data: valid UTF-8. first: byte positions at which texts start; no word goes across.
    The split takes contractions, then runs of letters, numbers or others with one space
    before them, and leaves the last blank of a run to what follows.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point
    n = len(points)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, first)] = True
    head[n] = True
    change = head.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    start = change.copy()
    after_blank = 1 + np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~head[1:n])
    start[after_blank - 1] = True
    start[after_blank[points[after_blank - 1] == 32]] = False
    quote = np.flatnonzero((points == 39) & start[:n] & change[:n] & change[1:] & ~head[1:])
    if len(quote):
        pad = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = pad[quote + 1], pad[quote + 2]
        two = np.where(head[np.minimum(quote + 2, n)], 0, two)
        is_one = np.isin(one, [ord(c) for c in "stmd"])
        is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        hit = quote[is_one | is_two]
        start[hit + 1] = False
        start[hit + 2 + is_two[is_one | is_two]] = True
    return at[start[:n]]


class Lexicon:
    """A minimal acyclic transducer over words, as arrays that can be mapped into memory."""

    FIELDS = (("keys", np.int64), ("target", np.int32), ("add", np.int32), ("final", np.uint8), ("id_starts", np.int32), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name, _ in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> "Lexicon":
        """words: distinct, with their ids. Sorted words are added one after another; the
        states behind the last common prefix are then settled, each with an equal one if there is."""
        settled: dict[tuple, int] = {}
        arcs_of: list[tuple] = []  # settled states: (final, ((label, target), ...))
        path: list[tuple[list, bool]] = [([], False)]  # open states along the last word

        def settle(to: int) -> None:
            while len(path) > to + 1:
                arcs, final = path.pop()
                key = (final, tuple(arcs))
                state = settled.setdefault(key, len(arcs_of))
                if state == len(arcs_of):
                    arcs_of.append(key)
                path[-1][0][-1] = (path[-1][0][-1][0], state)

        last = b""
        ordered = sorted(words)
        for word in ordered:
            common = len(os.path.commonprefix([last, word]))
            settle(common)
            for label in word[common:]:
                path[-1][0].append((label, -1))
                path.append(([], False))
            path[-1] = (path[-1][0], True)
            last = word
        settle(0)
        root = len(arcs_of)
        arcs_of.append((path[0][1], tuple(path[0][0])))
        below: list[int] = []  # words accepted from a state; targets come first
        for final, arcs in arcs_of:
            below.append(final + sum(below[t] for _, t in arcs))
        keys, target, add = [], [], []
        number = lambda s: root - s  # the root is state 0
        for s in range(root, -1, -1):
            final, arcs = arcs_of[s]
            skipped = int(final)
            for label, t in arcs:
                keys.append(number(s) * 256 + label)
                target.append(number(t))
                add.append(skipped)
                skipped += below[t]
        ids = [words[w] for w in ordered]
        return cls({
            "keys": np.array(keys or [-1], np.int64), "target": np.array(target or [0], np.int32), "add": np.array(add or [0], np.int32),
            "final": np.array([f for f, _ in reversed(arcs_of)], np.uint8),
            "id_starts": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array([x for y in ids for x in y], np.int32),
        })

    def dump(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n), k) for n, k in self.FIELDS]
        return b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)])

    @classmethod
    def mapped(cls, dumped: bytes) -> "Lexicon":
        """Through a file in this worker's temporary folder, which all workers beside it map."""
        file = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha1(dumped).hexdigest()}")
        if not os.path.exists(file):
            fd, own = tempfile.mkstemp(dir=tempfile.gettempdir())
            with os.fdopen(fd, "wb") as f:
                f.write(dumped)
            os.replace(own, file)
        body = np.memmap(file, np.uint8, "r")
        sizes = body[: 8 * len(cls.FIELDS)].view(np.int64)
        at, arrays = 8 * len(cls.FIELDS), {}
        for (name, kind), n in zip(cls.FIELDS, sizes, strict=True):
            arrays[name] = body[at : at + n * np.dtype(kind).itemsize].view(kind)
            at += -(-arrays[name].nbytes // 8) * 8
        return cls(arrays)

    def ranks(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rank of each word data[starts:starts + lengths], -1 where it isn't in the lexicon."""
        out = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero((lengths <= WORD_BYTES) & (lengths > 0))
        state, rank = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state * 256 + data[starts[live] + step]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[pos] == key
            live, pos = live[ok], pos[ok]
            state, rank = self.target[pos].astype(np.int64), rank[ok] + self.add[pos]
            step += 1
            over = lengths[live] == step
            done = over & (self.final[state] == 1)
            out[live[done]] = rank[done]
            live, state, rank = live[~over], state[~over], rank[~over]
        return out


def cut(data: np.ndarray, offsets: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, dict[int, int]]:
    """Word starts of some texts, and the special ids by the position at which they stand."""
    body, first, at_special = data.tobytes(), [offsets[:-1][offsets[:-1] < len(data)]], {}
    for text, k in special.items():
        mark, at = text.encode(), body.find(text.encode())
        while at >= 0:
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(mark) - 1, "right"):
                at_special[at] = k
                first.append(np.array([p for p in (at, at + len(mark)) if p < len(data)], np.int64))
            at = body.find(mark, at + len(mark))
    starts = word_starts(data, np.concatenate(first))
    if at_special:  # the mark itself is one word
        inside = np.zeros(len(data) + 1, np.int32)
        for at, k in at_special.items():
            size = next(len(t.encode()) for t, x in special.items() if x == k)
            inside[at + 1] += 1
            inside[min(at + size, len(data))] -= 1
        starts = starts[np.cumsum(inside)[starts] == 0]
    return starts, at_special


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of its word at each start, the distinct words)."""
    ends = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


class Coder:
    """Encodes and decodes batches of texts."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and the total)."""
        starts, at_special = cut(data, offsets, self.vocab.special)
        which, words = distinct(data, starts)
        body, at = _buffers.raw(words)
        ranks = self.lexicon.ranks(body, at[:-1], np.diff(at))
        known = ranks >= 0
        count, pos = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pos[known] = self.lexicon.id_starts[ranks[known]]
        count[known] = self.lexicon.id_starts[ranks[known] + 1] - pos[known]
        size = np.diff(at)
        short = np.flatnonzero(~known & (size <= WORD_BYTES))
        merged, count[short] = self.vocab.merge_many(body, at[short], size[short])
        pos[short] = len(self.lexicon.ids) + np.cumsum(count[short]) - count[short]
        pool = [self.lexicon.ids, merged.astype(np.int32)]
        for k in np.flatnonzero(~known & (size > WORD_BYTES)):
            ids = self.vocab.merge(words[int(k)].as_py())
            pos[k], count[k] = sum(map(len, pool)), len(ids)
            pool.append(np.array(ids, np.int32))
        pool = np.concatenate(pool)
        n, p = count[which], pos[which]
        if at_special:
            where = np.flatnonzero(np.isin(starts, list(at_special)))
            n[where], p[where] = 1, len(pool) + np.arange(len(where))
            pool = np.concatenate([pool, np.array([at_special[int(starts[w])] for w in where], np.int32)])
        total = np.concatenate([[0], np.cumsum(n)])
        return pool[_buffers.spans(p, n)], total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, where each text's bytes start and the total)."""
        n = self.vocab.lengths[ids]
        return self.vocab.bytes[_buffers.spans(self.vocab.starts[ids], n)], np.concatenate([[0], np.cumsum(n)])[offsets]


def word_counts(docs: DataFrame, text_col: str = "text", vocab_file: str | None = None) -> DataFrame:
    """word (binary), n: over all texts, words of up to WORD_BYTES bytes."""
    vocab_file = vocab_file or public_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, held, size = vocabulary(vocab_file).special, [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
                yield from pa.table({"word": t["word"], "n": t["n_sum"]}).to_batches(max_chunksize=20_000)

        for batch in batches:
            data, offsets = _buffers.raw(batch.column(0))
            for a, b in _buffers.steps(offsets):
                at = offsets[a : b + 1]
                body = data[at[0] : at[-1]]
                if not len(body):
                    continue
                which, words = distinct(body, cut(body, at - at[0], special)[0])
                n = np.bincount(which, minlength=len(words))
                keep = np.diff(_buffers.raw(words)[1]) <= WORD_BYTES
                held.append(pa.table({"word": words.filter(pa.array(keep)), "n": pa.array(n[keep], pa.int64())}))
                size += len(held[-1])
                if size > 1_500_000:
                    yield from merged()
                    held, size = [], 0
        yield from merged()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_buffers.tidy(run), "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str = "text", vocab_file: str | None = None) -> Lexicon:
    """The lexicon of the corpus' frequent words, counted over all texts; an empty corpus gives an empty one."""
    vocab_file = vocab_file or public_path("byte_bpe_50k.json")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    frequent = word_counts(docs, text_col, vocab_file).where(F.col("n") >= max(2.0, size * FREQUENT)).collect()
    vocab = vocabulary(vocab_file)
    return Lexicon.compile({bytes(r.word): vocab.merge(bytes(r.word)) for r in frequent})


def encode(docs: DataFrame, vocab_file: str | None = None, lexicon: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of every row; with digests instead of ids:
    ids_sha256, decoded_sha256 (of the text that decoding the ids gives).

    Null text is empty (no ids); a special token's string inside a text is that token, as the
    library does by default; repeated rows each give a row; a null id stays null; other columns
    are ignored; an empty table gives an empty result. Texts are never truncated.
    """
    vocab_file = vocab_file or public_path("byte_bpe_50k.json")
    lexicon = lexicon or build_lexicon(docs, text_col, vocab_file)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary(vocab_file), Lexicon.mapped(shared.value))
        for batch in batches:
            data, offsets = _buffers.raw(batch.column(1))
            for a, b in _buffers.steps(offsets):
                at = offsets[a : b + 1]
                ids, starts = coder.encode(data[at[0] : at[-1]], at - at[0])
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(starts), pa.int64())]
                if digests:
                    body, ends = coder.decode(ids, starts)
                    little, body = ids.astype("<u4").tobytes(), body.tobytes()
                    out.append(pa.array([hashlib.sha256(little[4 * x : 4 * y]).hexdigest() for x, y in zip(starts, starts[1:], strict=False)], pa.string()))
                    out.append(pa.array([hashlib.sha256(body[x:y].decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(ends, ends[1:], strict=False)], pa.string()))
                else:
                    out.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = [id_col, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(_buffers.tidy(run), f"`{id_col}` {kind}, n_tokens long, {rest}")


def decode(encoded: DataFrame, vocab_file: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows of ids; null ids give an empty text, bytes that aren't UTF-8 the replacement character."""
    vocab_file = vocab_file or public_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_file)
        coder = Coder(vocab, None)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            body, at = coder.decode(np.array([k for x in lists for k in x], np.int64), ends)
            body = body.tobytes()
            texts = [body[x:y].decode("utf-8", "replace") for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(_buffers.tidy(run), f"`{id_col}` {kind}, text string")
