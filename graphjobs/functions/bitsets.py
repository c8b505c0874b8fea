"""Sets of small numbers as columns of 64-bit words: one row holds which of any number of groups it belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def words_for(members: int) -> int:
    """Words that sets of numbers below ``members`` take."""
    return max(1, -(-members // WORD))


def bit(number: Column) -> Column:
    """The word with the number's bit, in its place within the word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(WORD)).cast("int"))


def single(number: Column, words: int) -> Column:
    """The set of one number."""
    at = F.floor(number / WORD)
    return F.array(*[F.when(at == w, bit(number)).otherwise(F.lit(0).cast("long")) for w in range(words)])


def union_all(sets: Column, words: int) -> Column:
    """Aggregate: the union of a group's sets, word by word, combined before the shuffle."""
    return F.array(*[F.bit_or(sets[w]) for w in range(words)])


def literal(numbers: int) -> list[int]:
    """Signed words of a set given as a Python integer, lowest word first, without trailing zeros."""
    out = []
    while numbers:
        word = numbers & ((1 << WORD) - 1)
        out.append(word - (1 << WORD) if word >> (WORD - 1) else word)
        numbers >>= WORD
    return out


def minus(a: Column, b: Column) -> Column:
    """Members of a that aren't in b."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def is_empty(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def size(a: Column) -> Column:
    """How many members."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def meets(a: Column, numbers: int) -> Column:
    """Whether a has a member of the set given as a Python integer."""
    hit = F.lit(False)
    for w, word in enumerate(literal(numbers)):
        if word:
            hit = hit | (a[w].bitwiseAND(F.lit(word).cast("long")) != 0)
    return hit


def members(a: Column, words: int) -> Column:
    """The members as an array of int, ascending."""
    within = F.sequence(F.lit(0), F.lit(WORD - 1))

    def of_word(w: int) -> Column:
        held = F.filter(within, lambda i: F.call_function("shiftrightunsigned", a[w], i).bitwiseAND(F.lit(1).cast("long")) == 1)
        return F.transform(held, lambda i: i + w * WORD)

    return F.concat(*[of_word(w) for w in range(words)])
