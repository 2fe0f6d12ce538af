"""Privacy checks. Whole texts of all rows are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import checkdigits as K
from plumbline.functions import patterns as P
from plumbline.operators.checks.datetime import age_days, moment
from plumbline.operators import privacy as scan
from plumbline.operators.privacy import text_columns
from plumbline.plans.registry import check


def any_of(tests):
    return reduce(lambda a, b: a | b, tests, F.lit(False))


@check("privacy", "critical")
def PIIDetection(t, columns=None, pii_types=None, sample_size=None, fail_on_detection=True):
    """Rows with personal data per column and type (``sample_size`` is
    accepted and ignored: every row is read)."""
    for c in text_columns(t.df, columns):
        for k in pii_types or P.PII:
            hit = F.col(c).rlike(P.PII[k])
            bad, total = t.stat(F.count_if(hit)), t.stat(F.count(c))
            t.verdict(f"{c}:{k}", bad, total, bad == 0 if fail_on_detection else F.lit(True), violation=hit)


@check("privacy", "high")
def EmailPII(t, columns=None, allow_hashed=True, allowed_domains=None):
    """Readable e-mail addresses outside allowed domains."""
    for name in text_columns(t.df, columns):
        c = F.col(name)
        hit = c.rlike(P.PII["email"])
        if allowed_domains:
            found = F.regexp_extract_all(c, F.lit(P.PII["email"]), 0)
            good = [d.lower() for d in allowed_domains]
            hit = F.exists(found, lambda e: ~F.lower(F.substring_index(e, "@", -1)).isin(good))
        if not allow_hashed:
            hit = hit | c.rlike(P.HASHED)
        t.rows(name, hit, c.isNotNull())


@check("privacy", "high")
def PhonePII(t, columns=None, country_codes=None, allow_masked=True):
    """Readable phone numbers (of the given countries)."""
    for name in text_columns(t.df, columns):
        c = F.col(name)
        if country_codes:
            hit = any_of([c.rlike(P.PHONE[x.upper()].strip("^$")) for x in country_codes])
        else:
            hit = c.rlike(P.PII["phone"])
        if not allow_masked:
            hit = hit | c.rlike(r"[*Xx]{3,}[\-. ]?[0-9]{4}\b")
        t.rows(name, hit, c.isNotNull())


@check("privacy", "critical")
def SSNDetection(t, columns=None, allow_masked=True):
    """Readable social security numbers."""
    for name in text_columns(t.df, columns):
        c = F.col(name)
        hit = c.rlike(P.PII["ssn"])
        if not allow_masked:
            hit = hit | c.rlike(r"[*Xx]{3}-[*Xx]{2}-[0-9]{4}\b")
        t.rows(name, hit, c.isNotNull())


@check("privacy", "critical")
def CreditCardDetection(t, columns=None, allow_masked=True, validate_luhn=True):
    """Readable card numbers (with a valid Luhn digit)."""
    for name in text_columns(t.df, columns):
        c = F.col(name)
        hit = c.rlike(P.PII["credit_card"])
        if validate_luhn:
            found = F.regexp_extract_all(c, F.lit(P.PII["credit_card"]), 0)
            hit = hit & F.exists(found, lambda x: K.luhn(F.regexp_replace(x, r"[ \-]", "")))
        if not allow_masked:
            hit = hit | c.rlike(r"([*Xx]{4}[ \-]?){3}[0-9]{4}\b")
        t.rows(name, hit, c.isNotNull())


def personal(t, regulation, columns=None):
    """Rows of each text column that hold data the regulation protects."""
    for name in text_columns(t.df, columns):
        c = F.col(name)
        t.rows(f"pii:{name}", any_of([c.rlike(P.PII[k]) for k in P.REGULATIONS[regulation]]), c.isNotNull())


def flag_given(t, label, column):
    """The flag is set: true, or a non-zero number, or a yes-like text."""
    c = F.col(column)
    kind = t.df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        ok = c
    elif isinstance(kind, T.NumericType):
        ok = c != 0
    else:
        ok = F.lower(c.cast("string")).isin("true", "yes", "y", "1", "granted", "given")
    t.rows(f"{label}:{column}", ~F.coalesce(ok, F.lit(False)))


@check("privacy", "critical")
def GDPRCompliance(t, check_pii=True, check_consent=None, check_retention=False, retention_date_column=None,
                   max_retention_days=730, sensitive_columns=None):
    """Personal data, consent, retention age and filled sensitive columns."""
    if check_pii:
        personal(t, "gdpr")
    if check_consent:
        flag_given(t, "consent", check_consent)
    if check_retention:
        if not retention_date_column:
            raise ValueError("check_retention needs retention_date_column")
        d = moment(retention_date_column)
        t.rows(f"retention:{retention_date_column}", age_days(t, d) > float(max_retention_days), d.isNotNull())
    for c in sensitive_columns or ():
        t.rows(f"sensitive:{c}", F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(P.HASHED))


@check("privacy", "critical")
def CCPACompliance(t, check_pii=True, check_opt_out=None, check_sale_flag=None, minor_age_column=None):
    """Personal data, opt-out and sale flags, and sale of minors' data."""
    if check_pii:
        personal(t, "ccpa")
    if check_opt_out:
        t.rows(f"opt_out:{check_opt_out}", F.col(check_opt_out).isNull())
    if check_sale_flag:
        t.rows(f"sale:{check_sale_flag}", F.col(check_sale_flag).isNull())
    if minor_age_column:
        minor = F.col(minor_age_column) < 16
        sold = F.col(check_sale_flag).cast("string").isin("true", "1", "yes") if check_sale_flag else F.lit(True)
        t.rows(f"minor:{minor_age_column}", minor & sold, F.col(minor_age_column).isNotNull())


CPF = r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b"


@check("privacy", "critical")
def LGPDCompliance(t, check_pii=True, check_cpf=True, check_consent=None, purpose_column=None):
    """Personal data, CPF numbers with valid digits, consent and purpose."""
    if check_pii:
        personal(t, "lgpd")
    if check_cpf:
        for name in text_columns(t.df):
            found = F.regexp_extract_all(F.col(name), F.lit(CPF), 0)
            hit = F.exists(found, lambda x: K.cpf(F.regexp_replace(x, r"[.\-]", "")))
            t.rows(f"cpf:{name}", hit, F.col(name).isNotNull())
    if check_consent:
        flag_given(t, "consent", check_consent)
    if purpose_column:
        c = F.col(purpose_column)
        t.rows(f"purpose:{purpose_column}", c.isNull() | (F.trim(c.cast("string")) == ""))


@check("privacy", "high")
def DataRetention(t, date_column, max_age_days, category_column=None, category_retention=None):
    """Records are not older than the limit (of their category)."""
    d, limit = moment(date_column), F.lit(float(max_age_days))
    if category_column and category_retention:
        for value, days in dict(category_retention).items():
            limit = F.when(F.col(category_column) == F.lit(value), F.lit(float(days))).otherwise(limit)
    t.rows(date_column, age_days(t, d) > limit, d.isNotNull())


@check("privacy", "high")
def MaskingVerification(t, column, masking_type, visible_chars=4):
    """Values are masked in the stated way."""
    c = F.col(column)
    pattern = rf"^[*#Xx]+[^*#]{{0,{int(visible_chars)}}}$" if masking_type == "partial" else P.MASKING[masking_type]
    t.rows(column, ~c.rlike(pattern), c.isNotNull())


@check("privacy", "high")
def AnonymizationCheck(t, quasi_identifiers, k_anonymity=5, sensitive_column=None, l_diversity=3):
    """Every quasi-identifier group has k rows and l sensitive values."""
    g = t.frame(f"kanon:{quasi_identifiers}:{sensitive_column}",
                lambda: scan.k_anonymity(t.df, quasi_identifiers, sensitive_column))
    bad = F.col("k") < int(k_anonymity)
    if sensitive_column:
        bad = bad | (F.col("l") < int(l_diversity))
    t.verdict(",".join(quasi_identifiers), t.stat(F.count_if(bad), g), t.stat(F.count(F.lit(1)), g), frame=g,
              observed=t.stat(F.min("k"), g))


RANK = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3, "pii": 3, "phi": 3, "pci": 3}


@check("privacy", "high")
def SensitiveDataClassification(t, columns=None, classification_levels=None, max_allowed_level=None):
    """Types found per column do not exceed the allowed level, and their
    levels are among the expected ones."""
    for name in text_columns(t.df, columns):
        bad = F.lit(0)
        for k, pattern in P.PII.items():
            level = P.PII_LEVEL[k]
            over = max_allowed_level is not None and RANK[level] > RANK[max_allowed_level]
            surprise = bool(classification_levels) and level not in classification_levels
            if over or surprise:
                bad = bad + F.when(t.stat(F.count_if(F.col(name).rlike(pattern))) > 0, 1).otherwise(0)
        t.verdict(name, bad, F.lit(len(P.PII)))


@check("privacy", "critical")
def AgeVerification(t, age_column, min_age=13, consent_column=None, minor_threshold=18):
    """Nobody is below the minimum age; minors have a consent."""
    c = F.col(age_column)
    if not isinstance(t.df.schema[age_column].dataType, T.NumericType):
        c = F.floor(F.months_between(t.as_of, moment(age_column)) / 12)
    bad = c < min_age
    if consent_column:
        given = F.coalesce(F.lower(F.col(consent_column).cast("string")).isin("true", "yes", "y", "1"), F.lit(False))
        bad = bad | ((c < minor_threshold) & ~given)
    t.rows(age_column, bad, c.isNotNull())


@check("privacy", "high")
def CrossBorderDataTransfer(t, country_column=None, allowed_countries=None, restricted_countries=None,
                            adequacy_countries=("CA", "JP", "KR", "GB", "CH", "NZ", "IL", "AR", "UY")):
    """Destinations are allowed or adequate, and not restricted."""
    if not country_column:
        raise ValueError("country_column is needed")
    c = F.col(country_column)
    good = [*(allowed_countries or ()), *(adequacy_countries or ())]
    bad = ~c.isin(good) if good else F.lit(False)
    if restricted_countries:
        bad = bad | c.isin(list(restricted_countries))
    t.rows(country_column, bad, c.isNotNull())
