"""Checks of business identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import checkdigits as K
from plumbline.functions import patterns as P
from plumbline.plans.registry import check


def valid(t, column, ok):
    t.rows(column, ~F.coalesce(ok, F.lit(False)), F.col(column).isNotNull())


def shaped(c, pattern, test):
    """Shape first: the digit arithmetic only sees well-formed text."""
    return F.when(c.rlike(pattern), test(c)).otherwise(F.lit(False))


def bare(column):
    """Text without blanks and hyphens."""
    return F.regexp_replace(F.col(column).cast("string"), r"[\s\-]", "")


@check("business_rule", "high")
def Checksum(t, column, algorithm="luhn"):
    """Values carry a valid check digit."""
    c = bare(column)
    valid(t, column, {
        "luhn": lambda: shaped(c, r"^[0-9]{2,}$", K.luhn), "mod11": lambda: shaped(c, r"^[0-9]+[0-9X]$", K.mod11),
        "verhoeff": lambda: shaped(c, r"^[0-9]{2,}$", K.verhoeff), "damm": lambda: shaped(c, r"^[0-9]{2,}$", K.damm),
    }[algorithm]())


@check("business_rule", "high")
def Luhn(t, column):
    """Values pass the Luhn test."""
    valid(t, column, shaped(bare(column), r"^[0-9]{2,}$", K.luhn))


@check("business_rule")
def ISBN(t, column, format="any"):
    """Values are ISBN-10 or ISBN-13."""
    c = F.upper(bare(column))
    ten = shaped(c, r"^[0-9]{9}[0-9X]$", K.isbn10)
    thirteen = shaped(c, r"^97[89][0-9]{10}$", K.gs1)
    valid(t, column, {"any": ten | thirteen, "isbn10": ten, "isbn13": thirteen}[format])


@check("business_rule", "critical")
def CreditCard(t, column, card_type=None):
    """Values are card numbers of a known brand with a valid Luhn digit."""
    c, brand = bare(column), F.lit(False)
    for name, pattern in P.CARD_BRANDS.items():
        if card_type in (None, name):
            brand = brand | c.rlike(pattern)
    valid(t, column, brand & shaped(c, r"^[0-9]{12,19}$", K.luhn))


@check("business_rule", "high")
def IBAN(t, column, country_codes=None):
    """Values are IBANs with valid check digits (of listed countries)."""
    c = F.upper(bare(column))
    ok = shaped(c, r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", K.iban)
    if country_codes:
        codes = country_codes.split(",") if isinstance(country_codes, str) else country_codes
        ok = ok & F.left(c, F.lit(2)).isin([x.strip().upper() for x in codes])
    valid(t, column, ok)


@check("business_rule", "high")
def VAT(t, column, country="auto"):
    """Values are VAT numbers of a country, or of any known one."""
    c, ok = F.upper(F.regexp_replace(F.col(column), r"[\s.\-]", "")), F.lit(False)
    for code, pattern in P.VAT.items():
        if country in ("auto", code):
            ok = ok | c.rlike(pattern)
    valid(t, column, ok)


@check("business_rule")
def SWIFT(t, column, format="any"):
    """Values are bank identifier codes."""
    valid(t, column, F.col(column).rlike(P.SWIFT[format]))


@check("business_rule")
def EAN(t, column, format="any"):
    """Values are EAN-8, EAN-13, UPC-A or UPC-E barcodes."""
    c = bare(column)
    kinds = {
        "ean8": shaped(c, r"^[0-9]{8}$", K.gs1), "ean13": shaped(c, r"^[0-9]{13}$", K.gs1),
        "upca": shaped(c, r"^[0-9]{12}$", K.gs1),
        "upce": shaped(c, r"^[01][0-9]{7}$", lambda x: K.gs1(K.upce_to_upca(x))),
    }
    valid(t, column, kinds["ean8"] | kinds["ean13"] | kinds["upca"] | kinds["upce"] if format == "any" else kinds[format])
