"""Benchmark decontamination by exact word windows, in DataFrame functions only.

The windows of all benchmark texts go into a hashed bitmap of bounded size, which the scan of
each document's windows consults in place; the few that pass are compared as text with the
windows themselves, so a hash never decides a hit.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _buffers, _scratch

#: Words of a window.
WINDOW = 10
#: Fixed value: a word is a run of these characters once A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the bitmap for each window, and at most (8 MB; a fuller bitmap only passes more).
BITS_EACH, MOST_BITS = 64, 1 << 26
#: Windows up to which their table is broadcast (about 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once (Spark would compute it anew at each use in a lambda)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_text(w: Column, at: Column, size: int) -> Column:
    return F.array_join(F.slice(w, at + 1, size), " ")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """size, window, items: each distinct window with the sorted ids of the items that have it."""
    w = F.col("w")
    size = F.least(F.size(w), F.lit(WINDOW))
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    cut = items.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size(w) - size)).alias("at"))
    named = cut.select("item", "size", F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("window"))
    return named.groupBy("size", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def window_hash(w: Column, at: Column, size: int, salt: int) -> Column:
    return F.xxhash64(*(F.get(w, at + k) for k in range(size)), F.lit(salt))


def bitmap(windows: DataFrame, size: int, bits: int) -> Column:
    """The bits of two hashes of each window of that size, as an array of longs."""
    w = windows.where(F.col("size") == size).select(F.split("window", " ").alias("w"))
    slots = w.select(F.explode(F.array(*(F.pmod(window_hash(F.col("w"), F.lit(0), size, salt), F.lit(bits)) for salt in (1, 2)))).alias("bit"))
    words_ = slots.groupBy((F.col("bit") / 64).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set"))
    full = [0] * (bits // 64)
    for r in words_.collect():  # at most two slots a window
        full[r.slot] = r["set"]
    return F.from_json(F.lit("[" + ",".join(map(str, full)) + "]"), "array<bigint>")


def scan(docs: DataFrame, windows: DataFrame, text_col: str) -> Column:
    """struct(n_words, hits array<struct(at, size, window)>): the windows that pass the bitmaps."""
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    maps = {}
    for size, n in sizes.items():
        bits = min(MOST_BITS, max(1 << 12, 1 << (n * BITS_EACH - 1).bit_length()))
        maps[size] = (bitmap(windows, size, bits), bits)

    def passing(w: Column, size: int, held: Column, bits: int) -> Column:
        def on(at: Column, salt: int) -> Column:
            bit = F.pmod(window_hash(w, at, size, salt), F.lit(bits))
            return F.bit_get(F.get(held, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1

        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
        passed = F.filter(starts, lambda at: on(at, 1) & on(at, 2))
        return F.transform(passed, lambda at: F.struct(at.alias("at"), F.lit(size).alias("size"), window_text(w, at, size).alias("window")))

    def body(w: Column) -> Column:
        found = [passing(w, size, held, bits) for size, (held, bits) in maps.items()]
        none = F.array().cast("array<struct<at:int,size:int,window:string>>")
        return F.struct(F.size(w).cast("long").alias("n_words"), (F.concat(*found) if found else none).alias("hits"))

    return let(words(F.col(text_col)), body)


def covered(spans: Column) -> Column:
    """Words inside the union of struct(at, size)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(s: Column, x: Column) -> Column:
        end = x["at"] + x["size"]
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["total"] + F.greatest(F.lit(0), end - F.greatest(x["at"], s["end"]))).alias("total"))

    return F.aggregate(F.sort_array(spans), start, add, lambda s: s["total"])


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, key, n_words, n_hit, spans, items, contaminated of every row.

    spans: start and length (in words) of each hit window; items: the ids of the items that have
    one, as sorted strings; key: a hash of id and text. Null texts have no words; null item ids
    are ignored; repeated benchmark rows count once; repeated documents each give a row; a null
    id stays null; other columns are ignored; empty tables give no hits or an empty result.
    """
    windows = _scratch.written(benchmark_windows(benchmark, item_col, item_text_col), "windows")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    scanned = _scratch.written(rows.select("id", "key", scan(rows, windows, "text").alias("found")).select("id", "key", "found.*"), "scanned")
    # Rows without a window that passes stay out of both joins' keys.
    some = scanned.where(F.size("hits") > 0).select("id", "key", "hits").dropDuplicates(["id", "key"])
    each = some.select("id", "key", F.explode("hits").alias("hit")).select("id", "key", "hit.*")
    held = windows.select(F.col("size").alias("s"), F.col("window").alias("wd"), "items")
    if windows.count() <= BROADCAST_WINDOWS:
        held = F.broadcast(held)
    matched = each.join(held, (F.col("s") == F.col("size")) & (F.col("wd") == F.col("window")))
    grouped = matched.groupBy(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).agg(
        F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    out = scanned.join(grouped, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    spans, items = F.coalesce("spans", F.array().cast("array<struct<at:int,size:int>>")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "key", "n_words", covered(spans).alias("n_hit"), spans.alias("spans"), items.alias("items"), F.col("spans").isNotNull().alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without hits, all their columns unchanged."""
    bad = find_hits(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("key").alias("_bad_key")).distinct()
    return docs.join(bad, F.xxhash64(F.col(id_col), F.col(text_col)) == F.col("_bad_key"), "left_anti")
