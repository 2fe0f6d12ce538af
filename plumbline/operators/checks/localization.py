"""Checks of national identifiers and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import checkdigits as K
from plumbline.functions import patterns as P
from plumbline.operators.checks.business_rule import shaped, valid
from plumbline.plans.registry import check


def typed(t, column, patterns, kind):
    c, ok = F.col(column), F.lit(False)
    for name, pattern in patterns.items():
        if kind in ("any", name):
            ok = ok | c.rlike(pattern)
    valid(t, column, ok)


@check("localization", "high")
def KoreanBusinessNumber(t, column, allow_hyphen=True):
    """Ten digits with a valid check digit."""
    c = F.col(column)
    if allow_hyphen:
        c = F.when(c.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{5}$"), F.replace(c, F.lit("-"), F.lit(""))).otherwise(c)
    valid(t, column, shaped(c, r"^[0-9]{10}$", K.korean_business))


@check("localization", "critical")
def KoreanRRN(t, column, masked=True):
    """Thirteen digits: birth date, sex digit, check digit; the masked form
    (six digits, a sex digit, six asterisks) counts when allowed."""
    c = F.col(column)
    bare = F.replace(c, F.lit("-"), F.lit(""))
    shape = r"^[0-9]{6}-?[0-9]{7}$"
    century = F.when(F.substring(bare, 7, 1).isin("1", "2", "5", "6"), "19").when(
        F.substring(bare, 7, 1).isin("3", "4", "7", "8"), "20").otherwise("18")
    born = F.try_to_date(F.concat(century, F.substring(bare, 1, 6)), "yyyyMMdd").isNotNull()
    ok = F.when(c.rlike(shape), born & K.korean_rrn(bare)).otherwise(F.lit(False))
    if masked:
        hidden = c.rlike(r"^[0-9]{6}-?[0-9][*]{6}$")
        ok = ok | F.when(hidden, born).otherwise(F.lit(False))
    valid(t, column, ok)


@check("localization")
def KoreanPhone(t, column, type="any"):
    """Korean phone numbers."""
    typed(t, column, P.KOREAN_PHONE, type)


@check("localization", "high")
def KoreanBankAccount(t, column, bank="any"):
    """Korean account numbers by bank format."""
    typed(t, column, P.KOREAN_BANK, bank)


@check("localization")
def JapanesePostalCode(t, column, allow_symbol=True):
    """Japanese postal codes."""
    valid(t, column, F.col(column).rlike(P.JAPANESE_POSTAL_SYMBOL if allow_symbol else P.JAPANESE_POSTAL))


@check("localization", "critical")
def JapaneseMyNumber(t, column):
    """Twelve digits with a valid check digit."""
    c = F.regexp_replace(F.col(column), r"[\s\-]", "")
    valid(t, column, shaped(c, r"^[0-9]{12}$", K.my_number))


@check("localization")
def JapanesePhone(t, column, type="any"):
    """Japanese phone numbers."""
    typed(t, column, P.JAPANESE_PHONE, type)


@check("localization", "critical")
def ChineseID(t, column, validate_region=True):
    """Eighteen characters: region, birth date, serial, check character."""
    c = F.upper(F.col(column))
    def test(x):
        ok = K.chinese_id(x) & F.try_to_date(F.substring(x, 7, 8), "yyyyMMdd").isNotNull()
        return ok & F.left(x, F.lit(2)).isin(*P.CHINESE_REGIONS) if validate_region else ok
    valid(t, column, shaped(c, r"^[0-9]{17}[0-9X]$", test))


@check("localization", "high")
def ChineseUSCC(t, column):
    """Eighteen characters with a mod-31 check character."""
    c = F.upper(F.col(column))
    valid(t, column, shaped(c, rf"^[{K.USCC_ALPHABET}]{{18}}$", K.chinese_uscc))


@check("localization")
def ChinesePhone(t, column, type="any"):
    """Chinese phone numbers."""
    typed(t, column, P.CHINESE_PHONE, type)
