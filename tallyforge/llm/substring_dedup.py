"""Removal of long word runs that a document with a smaller id also holds.

Difference-cover anchors: COVER holds a residue pair for every difference modulo PERIOD, so two
equal runs of WINDOW words, wherever they start, share a shift at which both positions lie in
the cover. Runs of WINDOW - PERIOD + 1 words are hashed at cover positions only (6 of 31). An
anchor that two ids share then extends to the windows around it, whose own hashes decide.

Hashes travel as arrays, one row for a step's documents and a bucket of hashes. What a step
can decide by itself (an anchor with two ids in it, all but the smallest id of a window) stays
out of the shuffle, so a passage that a third of all documents hold sends one posting a step.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import _buffers, _scratch

WINDOW, PERIOD = 50, 31
#: A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
#: Buckets of hashes at least. A document gets a row of findings from each bucket that has some,
#: so with few, the rows of a document would grow with the buckets rather than with its findings.
BUCKETS = 64
#: Postings of a bucket that are compared at once; those of one hash stay together.
PIECE, SAMPLED = 1 << 16, 64
#: Stands for a null id: larger than any other.
NO_ID = (1 << 63) - 1

POSTINGS = "bucket int, ids binary, keys binary, which binary, hashes binary, at binary"
FOUND = "id long, key long, at binary"


class Postings:
    """Rows of arrays: documents (ids, keys) and hashes with their document and word position."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, buckets: int):
        self.ids, self.keys, self.buckets, self.rows = ids, keys, buckets, []

    def add(self, bucket: int, which: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> None:
        docs, own = np.unique(which, return_inverse=True)
        self.rows.append((bucket, self.ids[docs].tobytes(), self.keys[docs].tobytes(), own.astype(np.uint32).tobytes(), hashes.tobytes(), at.astype(np.uint32).tobytes()))

    def send(self, which: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> None:
        """Buckets are ranges of hashes, and each row is sorted by hash, as pieces() wants it."""
        order = np.argsort(hashes)
        bucket = ((hashes[order] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(ends)):
            part = order[ends[b] : ends[b + 1]]
            self.add(int(b), which[part], hashes[part], at[part])

    def known(self, which: np.ndarray, at: np.ndarray) -> None:
        """Findings that need no comparison with other steps: no hashes."""
        if len(which):
            self.add(int(self.keys[which[0]]) % self.buckets, which, np.zeros(0, np.uint64), at)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), *[pa.binary()] * 5]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in POSTINGS.split(", ")])


def unpacked(*cells: bytes) -> tuple[np.ndarray, ...]:
    """ids, keys, which, hashes, at of a row of POSTINGS."""
    return tuple(np.frombuffer(x, k) for x, k in zip(cells, (np.int64, np.int64, np.uint32, np.uint64, np.uint32), strict=True))


def pieces(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, keys, hashes, at) of the unpacked rows of a bucket, by ranges of hashes with about PIECE
    postings: beside the rows themselves, only one range at a time takes memory."""
    some = np.sort(np.concatenate([h[k % SAMPLED :: SAMPLED] for k, (_, _, _, h, _) in enumerate(held)]))
    bounds = np.unique(some[max(1, PIECE // SAMPLED) :: max(1, PIECE // SAMPLED)])
    cuts = [np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]]) for _, _, _, h, _ in held]
    for k in range(len(bounds) + 1):
        part = [(ids[which[c[k] : c[k + 1]]], keys[which[c[k] : c[k + 1]]], h[c[k] : c[k + 1]], at[c[k] : c[k + 1]]) for (ids, keys, which, h, at), c in zip(held, cuts, strict=True) if c[k] < c[k + 1]]
        if part:
            yield tuple(np.concatenate(x) for x in zip(*part, strict=True))


def groups(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hash, id); of each place in that order the smallest and the largest id of its hash."""
    order = np.lexsort((ids, hashes))
    h, i = hashes[order], ids[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(h)))
    return order, np.repeat(i[head], size), np.repeat(i[head + size - 1], size)


def columns(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """id, key, at: positions of anchors whose hash occurs under two ids."""
    size = WINDOW - PERIOD + 1
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _buffers.each_step(batch, 2, lower=False):
                ids, keys = columns(batch, a, b)
                hashes, row = words.windows(size)
                runs = np.maximum(words.counts - size + 1, 0)
                at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
                take = in_cover[at % PERIOD] & (words.counts[row] >= WINDOW)
                hashes, row, at = hashes[take], row[take], at[take]
                out = Postings(ids, keys, buckets)
                order, low, high = groups(hashes, ids[row])
                shared = low != high
                out.known(row[order[shared]], at[order[shared]])
                # A hash with two ids here sends its first posting only: the others are found already.
                first = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]) if len(order) else shared
                part = order[~shared | first]
                out.send(row[part], hashes[part], at[part])
                yield out.batch()

    return reduced(docs.mapInArrow(_buffers.tidy(send), POSTINGS), lambda low, high, ids: low != high)


def reduced(postings: DataFrame, keep) -> DataFrame:
    """Compares the postings of all steps, one bucket of hashes at a time.

    keep(low, high, ids): which postings are findings, by the smallest and largest id of
    their hash and their own.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and held:
                    yield from found(held)
                    held = []
                bucket = b
                row = unpacked(*parts)
                ids, keys, which, hashes, at = row
                if len(hashes):
                    held.append(row)
                else:
                    yield by_document(ids[which], keys[which], at)
        if held:
            yield from found(held)

    def found(held: list) -> Iterator[pa.RecordBatch]:
        kept = []
        for ids, keys, hashes, at in pieces(held):
            order, low, high = groups(hashes, ids)
            order = order[keep(low, high, ids[order])]
            kept.append((ids[order], keys[order], at[order]))
        ids, keys, at = (np.concatenate(x) for x in zip(*kept, strict=True))
        if len(ids):
            yield by_document(ids, keys, at)

    def by_document(ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((at, keys))
        ids, keys, at = ids[order], keys[order], at[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        offsets = (4 * np.append(head, len(keys))).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(at.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(keys[head]), blobs], names=["id", "key", "at"])

    spread = postings.repartition(partitions(postings), "bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(_buffers.tidy(compare), FOUND)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_ids(df: DataFrame, column: str) -> None:
    """These operators order ids in arrays of 64-bit numbers."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{column} holds {kind.simpleString()}; whole numbers only (join on a number for each id instead)")


def positions(cell: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint32) for x in cell]).astype(np.int64) if cell else np.zeros(0, np.int64)


def covered(words: _buffers.Words, cells: list, before: int, after: int) -> np.ndarray:
    """Of each word of the step: whether it is at most `before` before or `after` after a position of its text."""
    change = np.zeros(len(words.starts) + 1, np.int32)
    for k, cell in enumerate(cells):
        if cell:
            at = positions(cell)
            np.add.at(change, words.first[k] + np.maximum(at - before, 0), 1)
            np.add.at(change, np.minimum(words.first[k] + at + after + 1, words.first[k + 1]), -1)
    return np.cumsum(change[:-1]) > 0


def windows(docs: DataFrame, buckets: int) -> DataFrame:
    """id, key, at: starts of windows that a smaller id has too. docs: id, key, text, cells with the
    positions of shared anchors."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(3)
            for a, b, words in _buffers.each_step(batch, 2, lower=False):
                ids, keys = columns(batch, a, b)
                hashes, row = words.windows(WINDOW)
                runs = np.maximum(words.counts - WINDOW + 1, 0)
                at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
                near = covered(words, cells.slice(a, b - a).to_pylist(), PERIOD - 1, 0)[words.first[row] + at]
                hashes, row, at = hashes[near], row[near], at[near]
                out = Postings(ids, keys, buckets)
                order, low, _ = groups(hashes, ids[row])
                larger = ids[row[order]] > low
                out.known(row[order[larger]], at[order[larger]])
                part = order[~larger]
                out.send(row[part], hashes[part], at[part])
                yield out.batch()

    return reduced(docs.mapInArrow(_buffers.tidy(send), POSTINGS), lambda low, high, ids: ids > low)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, key, text of every row, dealt by key; key, cells: starts of the windows to remove)."""
    _scratch.small_batches(docs)
    whole_ids(docs, id_col)
    n, dealt = partitions(docs), max(BUCKETS, partitions(docs))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).alias("text"),
    )
    by_key = rows.repartition(n, "key")  # one shuffle of the texts, which both joins below read
    near = anchors(rows, dealt).groupBy("key").agg(F.collect_list("at").alias("cells"))
    hit = windows(by_key.join(near.hint("shuffle_hash"), "key").select("id", "key", "text", "cells"), dealt)
    return by_key, hit.groupBy("key").agg(F.collect_list("at").alias("cells"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, text of every row: each word goes that lies in a window of 50
    consecutive words which also starts in a row with a smaller id.

    Windows are judged on the input. A text that loses no word stays as it is; the kept words of
    others are joined by one space. digests: instead of text, kept_sha256 of the kept words
    joined by one space. Null text has no words and stays null; rows with a null id count as
    larger than all others; other ids are whole numbers (else TypeError); rows that share an id are
    never compared with each other, and repeated rows each give a row. Other columns are ignored. Two windows are equal if their
    64-bit hashes are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, texts = batch.column(3), batch.column(2)
            for a, b, words in _buffers.each_step(batch, 2, lower=False):
                own = cells.slice(a, b - a).to_pylist()
                gone = covered(words, own, 0, WINDOW - 1)
                last, data = [], words.data.tobytes()
                for k in range(b - a):
                    lo, hi = int(words.first[k]), int(words.first[k + 1])
                    if digests or own[k]:
                        kept = np.flatnonzero(~gone[lo:hi]) + lo if own[k] else range(lo, hi)
                        text = b" ".join([data[words.starts[w] : words.ends[w]] for w in kept]) if own[k] else b" ".join(data[words.starts[lo] : words.ends[hi - 1]].split()) if hi > lo else b""
                        last.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
                    else:
                        last.append(texts[a + k].as_py())
                total = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words.counts.astype(np.int64)), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), pa.array(last, pa.string())],
                    names=["id", "n_words", "n_removed", name],
                )

    name = "kept_sha256" if digests else "text"
    rows, cells = repeats(docs, id_col, text_col)
    joined = rows.join(cells.hint("shuffle_hash"), "key", "left").select("id", "key", "text", "cells")
    out = joined.mapInArrow(_buffers.tidy(run), f"id long, n_words long, n_removed long, {name} string")
    kind = docs.schema[id_col].dataType
    return out.select(F.nullif("id", F.lit(NO_ID)).cast(kind).alias(id_col), "n_words", "n_removed", name)


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their columns and texts as remove_repeats gives them; repeated rows stay repeated."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows, cells = repeats(docs, id_col, text_col)
    changed = rows.join(cells.hint("shuffle_hash"), "key").dropDuplicates(["key"]).select("id", "key", "text", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _buffers.each_step(batch, 2, lower=False):
                gone = covered(words, batch.column(3).slice(a, b - a).to_pylist(), 0, WINDOW - 1)
                data, texts = words.data.tobytes(), []
                for lo, hi in zip(words.first, words.first[1:], strict=False):
                    texts.append(b" ".join([data[words.starts[w] : words.ends[w]] for w in np.flatnonzero(~gone[lo:hi]) + lo]).decode())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(texts, pa.string())], names=["_tf_key", "_tf_text"])

    new = changed.mapInArrow(_buffers.tidy(run), "_tf_key long, _tf_text string")
    joined = docs.join(new, key == F.col("_tf_key"), "left")
    return joined.select(*(F.coalesce("_tf_text", F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns))
