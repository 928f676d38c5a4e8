"""Check digits as Columns (V1 to V4, and the card numbers of R15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, let


def _numbers(c: Column) -> Column:
    """The digits of a value as an array of numbers."""
    return F.transform(F.filter(F.split(digits(c), ""), lambda x: x != ""), lambda x: x.cast("int"))


def _weighed(d: Column, weights: list[int]) -> Column:
    pairs = F.zip_with(F.slice(d, 1, len(weights)), F.lit(weights), lambda a, w: a * w)
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)).cast("int"))


def _eleven(total: Column) -> Column:
    """The check digit of a mod-11 sum: below 2 it is 0."""
    return let(total % 11, lambda r: F.when(r < 2, 0).otherwise(11 - r))


def _long_enough(c: Column, n: int, test) -> Column:
    """``test`` on the numbers of a value of n digits that are not all equal; anything else is invalid."""
    return F.coalesce(let(_numbers(c), lambda d: (F.size(d) == n) & (F.size(F.array_distinct(d)) > 1) & test(d)), F.lit(False))


def cpf_valid(c: Column) -> Column:
    """V1: 11 digits, not all equal, two check digits by weights 10..2 and 11..2."""
    digit = lambda d, n: (_weighed(d, list(range(n + 1, 1, -1))) * 10) % 11 % 10
    return _long_enough(c, 11, lambda d: (digit(d, 9) == F.get(d, 9)) & (digit(d, 10) == F.get(d, 10)))


def cnpj_valid(c: Column) -> Column:
    """V2: 14 digits, not all equal, two check digits by weights 5..2, 9..2 and 6 before them."""
    weights = [*range(5, 1, -1), *range(9, 1, -1)]
    return _long_enough(c, 14, lambda d: (_eleven(_weighed(d, weights)) == F.get(d, 12)) & (_eleven(_weighed(d, [6, *weights])) == F.get(d, 13)))


def pis_valid(c: Column) -> Column:
    """V3: 11 digits, not all equal, one check digit by weights 3, 2, 9..2."""
    return _long_enough(c, 11, lambda d: _eleven(_weighed(d, [3, 2, *range(9, 1, -1)])) == F.get(d, 10))


def cnj_valid(c: Column) -> Column:
    """V4: 20 digits; 98 minus (the other 18, times 100, modulo 97) is the pair behind the seventh."""

    def test(d: Column) -> Column:
        base = F.concat(F.substring(d, 1, 7), F.substring(d, 10, 11)).cast("long")
        return (F.length(d) == 20) & (98 - ((base % 97) * 100) % 97 == F.substring(d, 8, 2).cast("int"))

    return F.coalesce(let(digits(c), lambda d: F.when(F.length(d) == 20, test(d)).otherwise(F.lit(False))), F.lit(False))


def luhn_valid(c: Column) -> Column:
    """From the right, every second digit counts twice (its own digits added); the sum has to be a multiple of ten."""

    def test(d: Column) -> Column:
        n = F.size(d)
        weighed = F.transform(d, lambda x, i: F.when((n - i) % 2 == 1, x).when(x < 5, 2 * x).otherwise(2 * x - 9))
        return (n > 1) & (F.size(F.array_distinct(d)) > 1) & (F.aggregate(weighed, F.lit(0), lambda acc, x: acc + x) % 10 == 0)

    return F.coalesce(let(_numbers(c), test), F.lit(False))


# The numbers that a card number begins with, by issuer, and its lengths.
CARD_ISSUERS = (("4", (13, 16, 19)), ("5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)), ("3[47]", (15,)), ("30[0-5]|3[689]", (14, 16)), ("6011|64[4-9]|65|62|5067|6362|6363", (16, 17, 18, 19)))


def card_valid(c: Column) -> Column:
    """A card number: a known issuer, a length that it uses, and the check digit."""

    def known(d: Column) -> Column:
        tests = [d.rlike(f"^(?:{begin})") & F.length(d).isin(*sizes) for begin, sizes in CARD_ISSUERS]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return F.coalesce(let(digits(c), known) & luhn_valid(c), F.lit(False))
