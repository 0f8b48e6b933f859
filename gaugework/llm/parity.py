"""Cheap tests for pairs of sets: which of 512 places their elements mark, or the parities of their numbers there; and how many bytes of two fingerprints differ."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 places; an element's hash names the word by its lowest bits and the place by those from the ninth on.
WORDS = 8
#: Words of the finer test, for buckets in which many members are compared with many.
FINE_WORDS = 32


def _place(h: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, 8) & 63 as int))")


def _word(n: int, words: int = WORDS, h: str = "h") -> Column:
    return F.when(F.col(h).bitwiseAND(F.lit(words - 1)) == n, _place(h)).otherwise(F.lit(0).cast("bigint"))


def parities(elements: DataFrame) -> DataFrame:
    """(id, size, held, x0 to x7) of ``elements`` (id, size, h), one row for each different element h of a set."""
    return elements.groupBy("id").agg(F.max("size").alias("size"), *_places([F.bit_xor(_word(n)) for n in range(WORDS)]))


def _places(words: list[Column]) -> list[Column]:
    """The words, and ``held``, the number of their places; a test over many words that counts them for each pair is too long to be compiled."""
    return [sum(F.bit_count(word) for word in words).alias("held"), *[word.alias(f"x{n}") for n, word in enumerate(words)]]


def marks(elements: DataFrame, words: int = WORDS, hashes: Sequence[str] = ("h",), size: Column | None = None) -> DataFrame:
    """(id, size, held, x0, x1, ...) of ``elements`` (id, h), in which an element may repeat: the number of rows, that of the places marked,
    and the places.

    Repeats change no place, so nothing has to be made distinct; the number of rows is at least the size of the set. A row may hold
    several elements, as columns ``hashes``; ``size`` is then the aggregate that counts them.
    """
    marked = [F.bit_or(reduce(Column.bitwiseOR, [_word(n, words, h) for h in hashes])) for n in range(words)]
    return elements.groupBy("id").agg((F.count(F.lit(1)) if size is None else size).alias("size"), *_places(marked))


def near(similarity: float, words: int = WORDS) -> Callable[[str, str], Column]:
    """A test over size_a, held_a, x0_a, ..., size_b, ... that holds for every pair of sets of that Jaccard similarity.

    A place that differs stands for an element that only one set holds, of which there can be at most (1 - s) / (1 + s) of both
    sizes. A size may be given too large; a set has at least as many elements as places.
    """

    def test(a: str, b: str) -> Column:
        size_a, size_b = F.col(f"size_{a}"), F.col(f"size_{b}")
        places = [(F.col(f"x{n}_{a}"), F.col(f"x{n}_{b}")) for n in range(words)]
        differ = sum(F.bit_count(x.bitwiseXOR(y)) for x, y in places)
        # The margin is for rounding.
        sizes = (size_a >= F.col(f"held_{b}") * similarity - 1e-6) & (size_b >= F.col(f"held_{a}") * similarity - 1e-6)
        return sizes & (differ <= (size_a + size_b) * ((1 - similarity) / (1 + similarity)) + 1e-6)

    return test


def packed_bytes(values: list[Column]) -> list[Column]:
    """The lowest bytes of the values, eight in a word, as b0, b1, ..."""
    words = [values[n : n + 8] for n in range(0, len(values), 8)]
    packed = [reduce(Column.bitwiseOR, [F.shiftleft(value.bitwiseAND(F.lit(255)), 8 * i) for i, value in enumerate(word)]) for word in words]
    return [word.alias(f"b{n}") for n, word in enumerate(packed)]


def unequal_bytes(pairs: list[tuple[Column, Column]]) -> Column:
    """In how many bytes the two words of the pairs differ, over all pairs."""
    differ = F.lit(0)
    for left, right in pairs:
        bits = left.bitwiseXOR(right)
        # The lowest bit of each byte becomes 1 if any bit of that byte is.
        for by in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, by))
        differ += F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))
    return differ
