"""Similarity of short texts by longest common subsequences, as column expressions.

The score of two texts is 100 times twice the length of their longest common subsequence over the sum
of their lengths; words in another order count 0.95 of that. The subsequence is found by adding bit
vectors: one text is a mask for each of its characters, the other is walked through once.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a word: sums of two words and a carry must fit in 64 signed bits.
BITS = 62
FULL = (1 << BITS) - 1
REORDERED = 0.95


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def masks(chars: Column) -> Column:
    """A map from each character to its places: an array of words, BITS places to a word."""
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(chars) / BITS).cast("int") - 1, F.lit(0)))

    def word(c: Column, w: Column) -> Column:
        part = F.slice(chars, w * BITS + 1, F.lit(BITS))
        bits = F.transform(part, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)

    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.transform(words, lambda w: word(c, w)))))


def common_length(mask: Column, size: Column, chars: Column) -> Column:
    """The length of the longest common subsequence of a text, given by masks() and its size, and the characters of another."""
    zero, full = F.lit(0).cast("long"), F.lit(FULL).cast("long")

    def step(v: Column, m: Column, carry: Column) -> Column:
        return v + v.bitwiseAND(m) + carry

    def narrow(v: Column, c: Column) -> Column:
        m = F.coalesce(F.get(F.try_element_at(mask, c), F.lit(0)), zero)
        return step(v, m, zero).bitwiseAND(full).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))

    low = lambda bits: F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1
    one = size - F.bit_count(F.aggregate(chars, full, narrow).bitwiseAND(low(size)))

    words = F.ceil(size / BITS).cast("int")
    start = F.array_repeat(full, words)

    def wide(vs: Column, c: Column) -> Column:
        m = F.coalesce(F.try_element_at(mask, c), F.array_repeat(zero, words))
        first = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def each(acc: Column, vm: Column) -> Column:
            total = step(vm["v"], vm["m"], acc["carry"])
            new = total.bitwiseAND(full).bitwiseOR(vm["v"].bitwiseAND(F.bitwise_not(vm["m"])))
            return F.struct(F.shiftright(total, BITS).alias("carry"), F.concat(acc["out"], F.array(new)).alias("out"))

        return F.aggregate(F.zip_with(vs, m, lambda v, x: F.struct(v.alias("v"), x.alias("m"))), first, each, lambda acc: acc["out"])

    ends = F.transform(F.aggregate(chars, start, wide), lambda v, i: F.bit_count(v.bitwiseAND(low(F.least(F.lit(BITS), size - i * BITS)))))
    many = size - F.aggregate(ends, F.lit(0), lambda s, x: s + x)
    return F.when(size <= BITS, one).otherwise(many)


def score(mask: Column, words_mask: Column, size: Column, chars: Column, words_chars: Column) -> Column:
    """0 to 100 for one text (masks of it and of its sorted words, size) and the characters of another (and of its sorted words)."""
    total = size + F.size(chars)
    plain, words = common_length(mask, size, chars), common_length(words_mask, size, words_chars)
    return F.when(total > 0, F.greatest(200.0 * plain / total, REORDERED * 200.0 * words / total)).otherwise(0.0)


def elements(chars: Column) -> Column:
    """The characters of a text as a sorted set: each with its number among its equals, high numbers,
    which few texts have, first. Texts share as many elements as characters."""
    numbered = F.transform(chars, lambda c, i: F.concat(F.lpad((9999 - F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))).cast("string"), 4, "0"), c))
    return F.array_sort(numbered)


def prefix(parts: Column, floor: float) -> Column:
    """The first elements of a text, of which a text of that score or more must have one: a score of
    `floor` (0 to 1) takes floor / (2 - floor) of either text's characters in common."""
    size = F.size(parts)
    return F.slice(parts, F.lit(1), (size - F.ceil(size * (floor / (2 - floor)) - 1e-9) + 1).cast("int"))
