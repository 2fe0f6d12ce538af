"""Check-digit algorithms as Column expressions (no Python per row).

Each function expects a string of the right shape (digits, right length)
and returns a boolean Column; callers test the shape first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quasigroup of the Damm algorithm.
DAMM = (
    (0, 3, 1, 7, 5, 9, 8, 6, 4, 2), (7, 0, 9, 2, 1, 5, 4, 8, 6, 3), (4, 2, 0, 6, 8, 7, 1, 3, 5, 9),
    (1, 7, 5, 0, 9, 8, 3, 4, 2, 6), (6, 1, 2, 3, 0, 4, 5, 9, 7, 8), (3, 6, 7, 4, 2, 0, 9, 5, 8, 1),
    (5, 8, 6, 9, 7, 2, 0, 1, 3, 4), (8, 9, 4, 5, 3, 6, 2, 0, 1, 7), (9, 4, 3, 8, 6, 1, 7, 2, 0, 5),
    (2, 5, 8, 1, 4, 3, 6, 7, 9, 0),
)
# Base permutation of the Verhoeff algorithm.
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
KOREAN_BUSINESS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
KOREAN_RRN = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
MY_NUMBER = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
CHINESE_ID = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CHINESE_ID_CHECK = "10X98765432"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = tuple(pow(3, i, 31) for i in range(17))


def dihedral(j: int, k: int) -> int:
    """Product in the symmetry group of the pentagon (Verhoeff's table)."""
    turn = (j + k) % 5 if j < 5 else (j - k) % 5
    return turn + (5 if (j < 5) != (k < 5) else 0)


def verhoeff_permutations() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([VERHOEFF_STEP[d] for d in rows[-1]])
    return rows


def _ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def chars(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(1)))


def digits(c: Column) -> Column:
    return F.transform(chars(c), lambda x: (F.ascii(x) - 48).cast("int"))


def weighted(values: Column, weights: Sequence[int]) -> Column:
    """Sum of the leading values times their weights."""
    return F.aggregate(F.zip_with(F.slice(values, 1, len(weights)), _ints(weights), lambda a, b: a * b),
                       F.lit(0), lambda acc, x: acc + x)


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def mod11(c: Column) -> Column:
    """Weights 2..7 from the right over the payload; 10 is written X."""
    payload = F.reverse(digits(F.substring(c, F.lit(1), F.length(c) - 1)))
    total = F.aggregate(F.transform(payload, lambda x, i: x * (F.lit(2) + i % 6)), F.lit(0).cast("int"),
                        lambda acc, x: (acc + x).cast("int"))
    expected = (F.lit(11) - total % 11) % 11
    return F.right(c, F.lit(1)) == F.when(expected == 10, F.lit("X")).otherwise(expected.cast("string"))


def verhoeff(c: Column) -> Column:
    perm = _ints([v for row in verhoeff_permutations() for v in row])
    table = _ints([dihedral(j, k) for j in range(10) for k in range(10)])
    moved = F.transform(F.reverse(digits(c)), lambda x, i: F.get(perm, (i % 8) * 10 + x))
    return F.aggregate(moved, F.lit(0), lambda acc, x: F.get(table, acc * 10 + x)) == 0


def damm(c: Column) -> Column:
    table = _ints([v for row in DAMM for v in row])
    return F.aggregate(digits(c), F.lit(0), lambda acc, x: F.get(table, acc * 10 + x)) == 0


def gs1(c: Column) -> Column:
    """EAN/UPC: weights 1,3 from the right, multiple of ten."""
    terms = F.transform(F.reverse(digits(c)), lambda x, i: F.when(i % 2 == 1, x * 3).otherwise(x))
    return F.aggregate(terms, F.lit(0).cast("int"), lambda acc, x: (acc + x).cast("int")) % 10 == 0


def upce_to_upca(c: Column) -> Column:
    """Expand an 8-digit UPC-E (system, six digits, check) to UPC-A."""
    d = lambda i, n=1: F.substring(c, i, n)
    last = d(7)
    return F.concat(d(1), F.when(last.isin("0", "1", "2"), F.concat(d(2, 2), last, F.lit("0000"), d(4, 3)))
                    .when(last == "3", F.concat(d(2, 3), F.lit("00000"), d(5, 2)))
                    .when(last == "4", F.concat(d(2, 4), F.lit("00000"), d(6, 1)))
                    .otherwise(F.concat(d(2, 5), F.lit("0000"), last)), d(8))


def isbn10(c: Column) -> Column:
    values = F.transform(chars(c), lambda x: F.when(x == "X", F.lit(10)).otherwise((F.ascii(x) - 48).cast("int")))
    return weighted(values, range(10, 0, -1)) % 11 == 0


def iban(c: Column) -> Column:
    """ISO 13616: move four characters, letters to numbers, mod 97 = 1."""
    moved = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))
    codes = F.transform(chars(moved), lambda x: F.ascii(x))
    rest = F.aggregate(codes, F.lit(0).cast("int"), lambda acc, a: F.when(
        a >= 65, (acc * 100 + a - 55) % 97).otherwise((acc * 10 + a - 48) % 97).cast("int"))
    return rest == 1


def korean_business(c: Column) -> Column:
    d = digits(c)
    total = weighted(d, KOREAN_BUSINESS) + F.floor(F.get(d, F.lit(8)) * 5 / 10).cast("int")
    return F.get(d, F.lit(9)) == (F.lit(10) - total % 10) % 10


def korean_rrn(c: Column) -> Column:
    d = digits(c)
    return F.get(d, F.lit(12)) == (F.lit(11) - weighted(d, KOREAN_RRN) % 11) % 10


def my_number(c: Column) -> Column:
    d = digits(c)
    rest = weighted(d, MY_NUMBER) % 11
    return F.get(d, F.lit(11)) == F.when(rest <= 1, F.lit(0)).otherwise(F.lit(11) - rest)


def chinese_id(c: Column) -> Column:
    rest = weighted(digits(c), CHINESE_ID) % 11
    return F.upper(F.right(c, F.lit(1))) == F.substring(F.lit(CHINESE_ID_CHECK), rest + 1, F.lit(1))


def chinese_uscc(c: Column) -> Column:
    values = F.transform(chars(c), lambda x: F.instr(F.lit(USCC_ALPHABET), x) - 1)
    rest = (F.lit(31) - weighted(values, USCC_WEIGHTS) % 31) % 31
    return F.get(values, F.lit(17)) == rest


def cpf(c: Column) -> Column:
    """Brazilian CPF: two mod-11 digits over eleven digits."""
    d = digits(c)
    def check(n: int) -> Column:
        rest = weighted(d, range(n + 1, 1, -1)) * 10 % 11
        return F.when(rest == 10, F.lit(0)).otherwise(rest) == F.get(d, F.lit(n))
    return check(9) & check(10)
