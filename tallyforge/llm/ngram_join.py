"""Exact Jaccard join of word-shingle sets, returned as classes of linked documents.

In any common order, sets that link share at least k of their first floor(n / 5) + k shingles,
here with k about a tenth of n: a document takes part only if enough of its first shingles occur
elsewhere, and a pair counts only if it shares enough of them. The order is by hash, with shingles
that crowd a tile put last. A tile is one such shingle and a band of set sizes, within which sizes
differ by 1.25 times at most; the next lower band looks in too.

First each document is checked against one candidate, the one that leads most of its tiles; that
links most members of a group of copies without forming their pairs. Then each is checked against
the nearest smaller and the nearest larger set by hashed bitmap, which leaves few components apart.
All pairs are then formed, but only between documents that are not yet in one component: the
bitmaps bound the overlap from above, and pairs that pass get an exact intersection of their
sorted arrays. Equal sets are one node throughout.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _buffers, _components, _scratch
from tallyforge.llm.substring_dedup import BUCKETS, POSTINGS, Postings, partitions, pieces, unpacked

SHINGLE = 5
#: Similarity at which two sets link, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Members from which on a tile's shingle goes to the end of the order, and how many do at most
#: (they are broadcast: 2 MB). The order decides the cost, never the result.
CROWD, CROWDS = 1024, 1 << 18
#: Bits of a signature, and members of a tile that are compared in one piece.
BITS, BLOCK = 1024, 4096
TILE = ["tile", "d", "n", "leader", "size", "band", "blocks", "above"]
#: Pairs that are compared at once.
PAIRS = 1 << 18
#: Keys up to which a broadcast replaces a shuffle of the texts (about 24 bytes each).
BROADCAST_KEYS = 500_000


def sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct shingle hashes, signed digest of the set) of each row with words."""
    for a, b, words in _buffers.each_step(batch, column, lower=True):
        hashes, _ = words.windows(SHINGLE)
        runs = np.maximum(words.counts - SHINGLE + 1, 0)
        ends = np.cumsum(runs)
        few = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
        whole = _buffers.run_hashes(words.hashes, words.first[few], words.first[few + 1])
        alone = dict(zip(few.tolist(), whole, strict=True))
        marks = _buffers.mix(hashes)
        for k in np.flatnonzero(words.counts > 0):
            if runs[k]:
                lo, hi = ends[k] - runs[k], ends[k]
                h = np.unique(hashes[lo:hi])
                m = marks[lo:hi] if len(h) == hi - lo else _buffers.mix(h)
            else:
                h = np.array([alone[int(k)]], np.uint64)
                m = _buffers.mix(h)
            digest = _buffers.mix(np.array([m.sum(dtype=np.uint64) ^ np.uint64(len(h))], np.uint64))
            yield a + int(k), h, int(digest.view(np.int64)[0])


def measured(rows: DataFrame) -> DataFrame:
    """id, key, n, d (digest) of every row of id, key, text; 0 and null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for k, h, digest in sets(batch, 2):
                n[k], d[k] = len(h), digest
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(d, pa.int64())], names=["id", "key", "n", "d"])

    return rows.mapInArrow(_buffers.tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, key long, n long, d long")


def least_of(n):
    """Of two sets that link, the smaller with n shingles: how many of their first shingles they share."""
    return n // 10 + 1


def first_of(n: int) -> int:
    """How many are a set's first shingles."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + least_of(n)


def tiles(rows: DataFrame, crowded: np.ndarray | None) -> DataFrame:
    """tile, d, n, leader, size, band, blocks, above: first shingles that sets of fitting sizes share.

    size: members of the tile. A tile of more than BLOCK is compared by bands, each with the next
    lower one, in as many blocks as its band (blocks) and the next higher one (above) make.
    """
    buckets = partitions(rows)
    shared = rows.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if crowded is None else crowded)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        rank = np.argsort(last)
        ordered = last[rank]
        for batch in batches:
            seen, digests, sizes, firsts = set(), [], [], []
            for _, h, d in sets(batch, 2):
                if d in seen:
                    continue
                seen.add(d)
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                    late = np.where(ordered[at] == h, rank[at] + 1, 0)
                    h = h[np.argsort(late, kind="stable")] if late.any() else h
                digests.append(d)
                sizes.append(len(h))
                firsts.append(h[: first_of(len(h))])
            out = Postings(np.array(digests, np.int64), np.array(sizes, np.int64), buckets)
            if firsts:
                which = np.repeat(np.arange(len(firsts)), list(map(len, firsts)))
                out.send(which, np.concatenate(firsts), np.zeros(len(which), np.uint32))
            yield out.batch()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and held:
                    for d, n, h, _ in pieces(held):
                        yield from found(h, d, n)
                    held = []
                bucket = b
                held.append(unpacked(*parts))
        if held:
            for d, n, h, _ in pieces(held):
                yield from found(h, d, n)

    def found(h: np.ndarray, d: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((d, n, h))
        h, d, n = h[order], d[order], n[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])  # equal sets of several steps
        h, d, n = h[fresh], d[fresh], n[fresh]
        fits = (h[1:] == h[:-1]) & (n[1:] * NUMERATOR <= n[:-1] * DENOMINATOR)
        keep = np.concatenate([fits, [False]]) | np.concatenate([[False], fits])
        h, d, n = h[keep], d[keep], n[keep]
        if not len(h):
            return
        band = bands(n)
        order = np.lexsort((d, band, h))
        h, d, n, band = h[order], d[order], n[order], band[order]
        tile = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        size = np.bincount(tile)[tile]
        head = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (band[1:] != band[:-1])]))
        own = np.diff(np.append(head, len(h)))
        next_to = np.concatenate([[False], (tile[head][1:] == tile[head][:-1]) & (band[head][1:] == band[head][:-1] + 1)])
        with_lower = -(-(own + np.where(next_to, np.roll(own, 1), 0)) // BLOCK)
        higher = np.where(np.roll(next_to, -1), np.roll(with_lower, -1), 0)
        columns = [h.view(np.int64), d, n, np.repeat(d[head], own), size, band, np.repeat(with_lower, own), np.repeat(higher, own)]
        for a in range(0, len(h), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000]) for c in columns], names=TILE)

    spread = rows.mapInArrow(_buffers.tidy(send), POSTINGS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(_buffers.tidy(meet), ", ".join(f"{c} long" for c in TILE))


def enough(found: DataFrame) -> DataFrame:
    """The tile rows of documents with as many as any link would take."""
    smallest = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
    many = found.groupBy("d", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.floor(smallest / 10) + 1)
    return found.join(many.select("d"), "d", "left_semi")


def bands(n: np.ndarray) -> np.ndarray:
    """Numbers of size bands: sets that link are in the same or in adjacent ones."""
    edges = [1]
    while edges[-1] <= (int(n.max()) if len(n) else 1):
        edges.append(edges[-1] * DENOMINATOR // NUMERATOR + 1)  # the first size beyond the band's
    return np.searchsorted(np.array(edges), n, "right").astype(np.int64)


def signature(h: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    np.bitwise_xor.at(bits, (h >> np.uint64(40)).astype(np.int64) % BITS, 1)
    return np.packbits(bits).tobytes()


def content(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """d, n, bits, hashes of the sets of the wanted keys. Bits hold the parity of the shingles that
    fall on each, so two signatures differ in no more bits than their sets differ in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, len(h), signature(h), h.tobytes()) for _, h, d in sets(batch, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["d", "n", "bits", "hashes"])

    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "key", "left_semi").select("id", "key", "text").mapInArrow(_buffers.tidy(run), "d long, n long, bits binary, hashes binary")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs a, b whose sets link, by intersection of their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                if len(p) * DENOMINATOR < len(q) * NUMERATOR:
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(both * DENOMINATOR >= (len(p) + len(q) - both) * NUMERATOR)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = held.select(F.col("d").alias("a"), F.col("hashes").alias("x"))
    two = held.select(F.col("d").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(_buffers.tidy(run), "a long, b long")


def compared(found: DataFrame, roots: DataFrame, held: DataFrame, mixed_only: bool) -> DataFrame:
    """The tile rows in groups (tile, band, i, j) whose members are compared, with root, bits and block.

    A group of a large tile has the members of one block, or those of two blocks, which are compared
    across; probe marks members of the next lower band. mixed_only: without tiles in one component.
    """
    labelled = found.join(roots, "d", "left").withColumn("root", F.coalesce("root", "d"))
    if mixed_only:
        mixed = labelled.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("tile")
        labelled = labelled.join(mixed, "tile", "left_semi")
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("band"), F.lit(False).alias("probe"), F.lit(1).cast("long").alias("of")))
    by_band = F.array(F.struct("band", F.lit(False).alias("probe"), F.col("blocks").alias("of")), F.struct((F.col("band") + 1).alias("band"), F.lit(True).alias("probe"), F.col("above").alias("of")))
    part = F.explode(F.when(F.col("size") <= BLOCK, whole).otherwise(F.filter(by_band, lambda x: x["of"] > 0))).alias("part")
    dealt = labelled.join(held.select("d", "bits"), "d").select("tile", "d", "n", "root", "bits", part).select("*", "part.*").drop("part")
    dealt = dealt.withColumn("block", F.pmod(F.hash("d"), F.col("of").cast("int"))).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("of") - 1).cast("int"))))
    return dealt.select("tile", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "d", "n", "root", "probe", "block", "bits")


def bounded_pairs(found: DataFrame, roots: DataFrame, held: DataFrame, nearest: bool = False) -> DataFrame:
    """a, b: members of a tile in different components whose signatures allow a link.

    nearest: for each member only the smaller and the larger one whose signature differs least.
    """
    keys = ["tile", "band", "i", "j"]
    spread = compared(found, roots, held, mixed_only=not nearest).repartition(max(BUCKETS, partitions(found)), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                t = pa.Table.from_batches(held)
                group, last = numbered(t), t.num_rows
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield from passed(t.slice(0, cut), group[:cut])
                held, rows = t.slice(cut).to_batches(), last - cut
        if held:
            t = pa.Table.from_batches(held)
            yield from passed(t, numbered(t))

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    def passed(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of all groups: each row with those of its group that come after its component's."""
        i, j, d, n, root, block = (t.column(k).to_numpy() for k in ("i", "j", "d", "n", "root", "block"))
        probe = t.column("probe").to_numpy(zero_copy_only=False)
        body, at = _buffers.raw(t.column("bits").combine_chunks())
        marks = body.view(np.uint64).reshape(len(at) - 1, -1)
        order = np.lexsort((root, group))
        new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (root[order][1:] != root[order][:-1])])
        size = np.zeros(len(d), np.int64)
        size[order] = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        order = np.lexsort((root, size, group))  # the largest component of a group comes last
        g, r = group[order], root[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
        start = np.append(np.flatnonzero(new), len(d))[np.cumsum(new)]
        todo = np.searchsorted(g, g, "right") - start
        total = np.concatenate([[0], np.cumsum(todo)])
        low, high = (np.full(len(d), BITS + 1), np.zeros(len(d), np.int64)), (np.full(len(d), BITS + 1), np.zeros(len(d), np.int64))
        for x, y in _buffers.steps(total, PAIRS):
            a, b = order[np.repeat(np.arange(x, y), todo[x:y])], order[_buffers.spans(start[x:y], todo[x:y])]
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            fit = (large * NUMERATOR <= small * DENOMINATOR) & ~(probe[a] & probe[b]) & ((i[a] == j[a]) | (block[a] != block[b]))
            a, b = a[fit], b[fit]
            # |A| + |B| - 2 |A and B| is at least the differing bits.
            apart = np.zeros(len(a), np.int64)
            for k in range(marks.shape[1] if len(a) else 0):
                apart += np.bitwise_count(marks[a, k] ^ marks[b, k])
            both = (n[a] + n[b] - apart) // 2
            fit = both * DENOMINATOR >= (n[a] + n[b] - both) * NUMERATOR
            a, b, apart = a[fit], b[fit], apart[fit]
            if not len(a):
                continue
            if nearest:
                a, b = np.where(d[a] < d[b], a, b), np.where(d[a] < d[b], b, a)
                for mine, other, (least, partner) in ((a, b, high), (b, a, low)):
                    rank = np.lexsort((d[other], apart, mine))
                    first = rank[np.concatenate([[True], mine[rank][1:] != mine[rank][:-1]])]
                    first = first[apart[first] < least[mine[first]]]
                    least[mine[first]], partner[mine[first]] = apart[first], d[other[first]]
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(d[a], d[b])), pa.array(np.maximum(d[a], d[b])), pa.array(np.minimum(n[a], n[b]))], names=["a", "b", "n"])
        for least, partner in (low, high) if nearest else ():
            some = np.flatnonzero(least <= BITS)
            some = some[np.lexsort((partner[some], least[some], d[some]))]
            some = some[np.concatenate([[True], d[some][1:] != d[some][:-1]])[: len(some)]]
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (d, partner, least)], names=["a", "b", "n"])

    pairs = spread.mapInArrow(_buffers.tidy(compare), "a long, b long, n long")
    if nearest:  # n: bits that differ
        best = pairs.groupBy("a", F.col("b").__lt__(F.col("a")).alias("lower")).agg(F.min_by("b", F.struct("n", "b")).alias("b"))
        return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.groupBy("a", "b", "n").agg(F.count("*").alias("times")).where(F.col("times") >= F.floor(F.col("n") / 10) + 1).select("a", "b")


def crowds(found: DataFrame) -> np.ndarray:
    """The tiles with CROWD members or more, at most CROWDS of them, the largest last."""
    crowded = found.where(F.col("size") >= CROWD).groupBy("tile").agg(F.first("size").alias("size")).orderBy(F.desc("size"), "tile").limit(CROWDS)
    return np.array([r.tile for r in reversed(crowded.collect())], np.int64).view(np.uint64)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and word-less texts have no shingles and link with nothing; ids may have any type that has
    an order; a null id counts as larger than all others and is a component's id only where no other
    is (then null); repeated rows each give a row, in one component; other columns are ignored; an
    empty table gives an empty result. Shingles are equal if their 64-bit hashes are.
    """
    _scratch.small_batches(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    all_sets = _scratch.written(measured(rows), "sets")
    found = _scratch.written(tiles(rows, None), "all-tiles")
    crowded = crowds(found)
    if len(crowded):
        _scratch.free(found)
        found = _scratch.written(tiles(rows, crowded), "all-tiles")
    every, found = found, _scratch.written(enough(found), "tiles")
    _scratch.free(every)
    votes = found.where("leader <> d").groupBy("d", "leader").count()
    best = votes.groupBy("d").agg(F.max_by("leader", F.struct("count", (-F.col("leader")).alias("low"))).alias("a")).select("a", F.col("d").alias("b"))
    keys = all_sets.where("d is not null").groupBy("d").agg(F.min("key").alias("key"))
    wanted = _scratch.written(keys.join(found.select("d").distinct(), "d", "left_semi").select("key").distinct(), "wanted")
    held = _scratch.written(content(rows, wanted).dropDuplicates(["d"]), "content")
    led = _scratch.written(verified(best, held), "links")
    near = _scratch.written(bounded_pairs(found, led.select(F.col("b").alias("d"), F.col("a").alias("root")), held, nearest=True), "pairs")
    links = _scratch.written(verified(near, held), "links")
    roots = _components.components(led.union(links))
    rest = _scratch.written(bounded_pairs(found, roots, held), "pairs")
    late = _scratch.written(verified(rest, held), "links")
    if not late.isEmpty():
        roots = _components.components(roots.select(F.col("d").alias("a"), F.col("root").alias("b")).union(late))
    _scratch.free(found, held, near, rest)
    nodes = keys.join(roots, "d", "left").select("d", F.coalesce("root", "d").alias("class"))
    own = all_sets.where("d is not null").groupBy("d").agg(F.min("id").alias("low")).join(nodes, "d")
    own = _scratch.written(own, "nodes")
    least = own.groupBy("class").agg(F.min("low").alias("component"))
    out = all_sets.join(own.join(least, "class").select("d", "component"), "d", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("d").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))
