"""Formats shared by checks, profiling and the personal-data scan.

Fixed values. All patterns avoid look-around, so that every common regex
engine reads them alike.
"""

from __future__ import annotations

EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
URL = r"^(https?|ftp)://[^\s/$.?#][^\s]*$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
IPV6 = (r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:"
        r"|([0-9a-fA-F]{1,4}:){1,6}(:[0-9a-fA-F]{1,4}){1,6}|:(:[0-9a-fA-F]{1,4}){1,7}|::)$")
SSN = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
CARD = r"^[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{1,7}$"
PHONE = {
    "any": r"^\+?[0-9][0-9()\-. ]{6,18}[0-9]$",
    "US": r"^(\+?1[\-. ]?)?\(?[2-9][0-9]{2}\)?[\-. ]?[0-9]{3}[\-. ]?[0-9]{4}$",
    "KR": r"^(\+82[\- ]?|0)(2|[3-6][1-5]|1[016789])[\- ]?[0-9]{3,4}[\- ]?[0-9]{4}$",
    "JP": r"^(\+81[\- ]?|0)[0-9]{1,4}[\- ]?[0-9]{1,4}[\- ]?[0-9]{4}$",
    "CN": r"^(\+86[\- ]?)?1[3-9][0-9]{9}$",
    "GB": r"^(\+44[\- ]?|0)[0-9]{2,4}[\- ]?[0-9]{3,4}[\- ]?[0-9]{3,4}$",
    "DE": r"^(\+49[\- ]?|0)[0-9]{2,5}[\-/ ]?[0-9]{3,9}$",
    "FR": r"^(\+33[\- ]?|0)[1-9]([\-. ]?[0-9]{2}){4}$",
}
FORMATS = {"email": EMAIL, "url": URL, "phone": PHONE["any"], "uuid": UUID,
           "ipv4": IPV4, "ipv6": IPV6, "credit_card": CARD, "ssn": SSN}
ALPHANUMERIC = r"^[A-Za-z0-9]+$"
CASING = {
    "snake": r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$",
    "camel": r"^[a-z][a-z0-9]*([A-Z][a-z0-9]*)*$",
    "pascal": r"^([A-Z][a-z0-9]*)+$",
    "kebab": r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$",
}
OFFSET = r"(Z|[+\-][0-9]{2}:?[0-9]{2})$"

# Date and time formats tried when no format is given (Java letters).
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "yyyy/MM/dd",
    "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy",
)

# strftime directive to Java letter.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
            "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%f": "SSSSSS",
            "%z": "xx", "%%": "%"}

CARD_BRANDS = {
    "visa": r"^4[0-9]{12}([0-9]{3}){0,2}$",
    "mastercard": r"^(5[1-5][0-9]{14}|2(22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12})$",
    "amex": r"^3[47][0-9]{13}$",
    "discover": r"^6(011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}$",
    "jcb": r"^35(2[89]|[3-8][0-9])[0-9]{12}$",
    "diners": r"^3(0[0-5]|[68][0-9])[0-9]{11}$",
}
VAT = {
    "DE": r"^DE[0-9]{9}$", "FR": r"^FR[0-9A-Z]{2}[0-9]{9}$",
    "GB": r"^GB([0-9]{9}|[0-9]{12}|GD[0-9]{3}|HA[0-9]{3})$", "IT": r"^IT[0-9]{11}$",
    "ES": r"^ES[0-9A-Z][0-9]{7}[0-9A-Z]$", "NL": r"^NL[0-9]{9}B[0-9]{2}$", "BE": r"^BE[01][0-9]{9}$",
    "AT": r"^ATU[0-9]{8}$", "PL": r"^PL[0-9]{10}$",
}
SWIFT = {"any": r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?$", "bic8": r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}$",
         "bic11": r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{5}$"}

KOREAN_PHONE = {"mobile": r"^01[016789]-?[0-9]{3,4}-?[0-9]{4}$",
                "landline": r"^0(2|3[1-3]|4[1-4]|5[1-5]|6[1-4])-?[0-9]{3,4}-?[0-9]{4}$"}
KOREAN_BANK = {
    "kb": r"^[0-9]{6}-?[0-9]{2}-?[0-9]{6}$", "shinhan": r"^[0-9]{3}-?[0-9]{3}-?[0-9]{6}$",
    "woori": r"^[0-9]{4}-?[0-9]{3}-?[0-9]{6}$", "hana": r"^[0-9]{3}-?[0-9]{6}-?[0-9]{5}$",
    "nh": r"^[0-9]{3}-?[0-9]{4}-?[0-9]{4}-?[0-9]{2}$", "ibk": r"^[0-9]{3}-?[0-9]{6}-?[0-9]{2}-?[0-9]{3}$",
    "kakao": r"^3333-?[0-9]{2}-?[0-9]{7}$", "toss": r"^1000-?[0-9]{4}-?[0-9]{4}$",
}
JAPANESE_PHONE = {"mobile": r"^0[789]0-?[0-9]{4}-?[0-9]{4}$",
                  "landline": r"^0[1-9][0-9]{0,3}-?[0-9]{1,4}-?[0-9]{4}$",
                  "toll_free": r"^(0120-?[0-9]{3}-?[0-9]{3}|0800-?[0-9]{3}-?[0-9]{4})$"}
JAPANESE_POSTAL = r"^[0-9]{3}-?[0-9]{4}$"
JAPANESE_POSTAL_SYMBOL = r"^〒?[ ]?[0-9]{3}-?[0-9]{4}$"
CHINESE_PHONE = {"mobile": r"^(\+?86[\- ]?)?1[3-9][0-9]{9}$", "landline": r"^0[0-9]{2,3}-?[0-9]{7,8}$"}
# Two-digit province codes of the resident card.
CHINESE_REGIONS = ("11", "12", "13", "14", "15", "21", "22", "23", "31", "32", "33", "34", "35", "36", "37",
                   "41", "42", "43", "44", "45", "46", "50", "51", "52", "53", "54", "61", "62", "63", "64",
                   "65", "71", "81", "82", "91")

# Personal data inside free text (unanchored).
PII = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"(\+[0-9]{1,3}[\-. ]?)?\(?\b[0-9]{3}\)?[\-. ][0-9]{3,4}[\-. ][0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}\b",
    "ip_address": r"\b((25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\b",
    "name": r"\b(Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+\b",
    "address": r"\b[0-9]{1,5} [A-Z][a-z]+( [A-Z][a-z]+)* (Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b",
    "date_of_birth": r"\b(19|20)[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\b",
    "passport": r"\b[A-Z]{1,2}[0-9]{7,8}\b",
    "driver_license": r"\b[A-Z][0-9]{3}-[0-9]{4}-[0-9]{4}\b",
}
# Which types each regulation treats as personal data.
REGULATIONS = {
    "gdpr": ("email", "phone", "ssn", "ip_address", "name", "address", "date_of_birth", "passport",
             "driver_license", "credit_card"),
    "ccpa": ("email", "phone", "ssn", "ip_address", "name", "address", "passport", "driver_license", "credit_card"),
    "lgpd": ("email", "phone", "ip_address", "name", "address", "date_of_birth", "passport"),
}
# Classification level of each type, and the order of levels.
PII_LEVEL = {"email": "confidential", "phone": "confidential", "ip_address": "internal", "name": "confidential",
             "address": "confidential", "date_of_birth": "confidential", "ssn": "restricted",
             "credit_card": "restricted", "passport": "restricted", "driver_license": "restricted"}
LEVELS = ("public", "internal", "confidential", "restricted")
HASHED = r"^[0-9a-fA-F]{32}$|^[0-9a-fA-F]{40}$|^[0-9a-fA-F]{64}$"
MASKED = r"[*#Xx]{2,}"
MASKING = {"full": r"^\*+$", "hash": HASHED, "tokenization": UUID, "redacted": r"^\[?(REDACTED|redacted)\]?$"}
