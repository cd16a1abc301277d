"""Fill-in-the-middle: texts cut between tokens into prefix, middle and suffix, and put in another order.

Token starts of a whole batch of texts are one packed bitvector over its bytes, an eighth of their
size, with the number of ones before each block. Ones between the ends of a text are its tokens;
the starts of two of them, found by rank, are the bytes to cut at. Texts stay in the JVM: the worker
gets a copy and returns three numbers each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import _buffers, _scratch

#: Words of 64 bits in a block of the directory.
BLOCK = 8
#: Bytes whose starts are worked out at a time, before they are packed.
CHUNK = 1 << 20
#: Documents in a hundred that are rearranged, and of those the ones whose suffix comes first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: The marks before prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"

_byte = np.arange(256)
_letter = ((_byte | 32) >= 97) & ((_byte | 32) <= 122) & (_byte < 128)
_continues = (_byte >= 128) & (_byte < 192)


class Starts:
    """Token starts of texts that lie one after the other in UTF-8, with rank and select.

    A token is a run of A-Z and a-z, or any other single character."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        blocks = len(body) // (64 * BLOCK) + 1
        packed = np.zeros(blocks * 8 * BLOCK, np.uint8)
        begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
        before = False
        for a in range(0, len(body), CHUNK):
            part = body[a : a + CHUNK]
            letter = _letter[part]
            inner = np.empty_like(letter)
            inner[0], inner[1:] = before, letter[:-1]
            before = letter[-1]
            inner &= letter
            starts = ~(inner | _continues[part])
            starts[begins[np.searchsorted(begins, a) : np.searchsorted(begins, a + len(part))] - a] = True
            packed[a // 8 : a // 8 + (len(part) + 7) // 8] = np.packbits(starts, bitorder="little")
        self.words = packed.view(np.uint64).reshape(blocks, BLOCK)
        each = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(each)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of starts before each byte."""
        block, word, bit = at // (64 * BLOCK), at // 64 % BLOCK, at % 64
        words = self.words[block]
        whole = np.bitwise_count(words) * (np.arange(BLOCK) < word[:, None])
        part = words[np.arange(len(at)), word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.before[block] + whole.sum(axis=1, dtype=np.int64) + np.bitwise_count(part)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte of the start that has `rank` others before it."""
        block = np.searchsorted(self.before, rank, "right") - 1
        words = self.words[block]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        rest = rank - self.before[block]
        word = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(rank))
        rest = rest - np.where(word > 0, upto[row, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        return (block * BLOCK + word) * 64 + bit


def cuts_of(texts: pa.Array, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, first cut, second cut in bytes) of each text for two draws, each taken modulo tokens + 1."""
    body, offsets = _buffers.raw(texts)
    if not len(texts):
        return (np.zeros(0, np.int64),) * 3
    starts = Starts(body, offsets)
    ranks = starts.rank(offsets)
    n = np.diff(ranks)
    units = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    out = []
    for k in units:
        at = np.diff(offsets)  # after the last token: the end
        inside = np.flatnonzero(k < n)
        at[inside] = starts.select(ranks[inside] + k[inside]) - offsets[inside]
        out.append(at)
    return n, out[0], out[1]


@F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in ("n", "one", "two")]))
def _cut(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    found = cuts_of(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(x) for x in found], names=["n", "one", "two"])


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits that follow from seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rearrange(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output of every row.

    psm is <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle. Plain, unchanged and without
    chars: empty and null texts (output is empty), texts that contain a mark, and those whose draw says
    so. Rows that share an id have the same draws; a null id counts as an empty one. Repeated rows each
    give a row, other columns are ignored, an empty table gives an empty result. A text is never cut
    short; the worker holds a batch of texts (one long text at least) and an eighth of that in bits."""
    _scratch.small_batches(docs)
    one, two, three, four = draws(id_col, seed)
    text = F.coalesce(text_col, F.lit(""))
    plain = (text == "") | text.contains(P) | text.contains(S) | text.contains(M) | (three % 100 >= REARRANGED)
    form = F.when(plain, "plain").when(four % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    held = docs.select(F.col(id_col), text.alias("text"), one.alias("h1"), two.alias("h2"), form.alias("form")).withColumn("cut", _cut("text", "h1", "h2"))
    raw = F.col("text").cast("binary")
    part = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")
    a, b = F.col("cut.one").cast("int"), F.col("cut.two").cast("int")
    parts = held.withColumns({"prefix": part(F.lit(0), a), "middle": part(a, b), "suffix": part(b, F.octet_length("text"))})
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(P), "prefix", F.lit(S), "suffix", F.lit(M), "middle")).otherwise(F.concat(F.lit(S), "suffix", F.lit(P), "prefix", F.lit(M), "middle"))
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    return parts.select(id_col, F.col("cut.n").alias("n"), "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that rearrange() made an output of."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda k: F.element_at(parts, k)
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(at(2), at(4), at(3))).otherwise(F.concat(at(3), at(4), at(2)))
