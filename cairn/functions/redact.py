"""Sensitive values in text replaced by ``[REDACTED:kind]``, as a chain of JVM expressions without lookaround."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind, pattern and replacement, in the order in which they are applied.
RULES = (
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED:private-key]"),
    ("token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "[REDACTED:token]"),
    ("bearer", r"(?i)\b(bearer\s+)([A-Za-z0-9._~+/=-]{20,})", "$1[REDACTED:token]"),
    ("password", r"""(?i)\b(password|passwd|pwd|passphrase)(["']?\s*(?:[:=]|\bis\b)\s*["']?)([^\s"'*<\[$({)]*[0-9!@#%^&+~?][^\s"'*<\[$({)]*)""", "$1$2[REDACTED:password]"),
    ("url-password", r"(?i)\b([a-z][a-z0-9+.-]*://[^\s:/@]+:)([^\s/@]+)(@)", "$1[REDACTED:password]$3"),
    ("secret", r"""(?i)\b([a-z_]*(?:secret|api_?key|access_?key|token))(["']?\s*[:=]\s*["']?)([A-Za-z0-9+/_=-]{20,})""", "$1$2[REDACTED:secret]"),
    ("one-time-code", r"(?i)\b(otp|one[- ]time (?:code|password))([^0-9\n]{0,12})([0-9]{4,8})\b", "$1$2[REDACTED:one-time-code]"),
    ("card-code", r"(?i)\b(cvv|cvc)(\s*:?\s*)([0-9]{3,4})\b", "$1$2[REDACTED:one-time-code]"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[REDACTED:ssn]"),
    ("aadhaar", r"(^|[^0-9\s-]\s?)([2-9][0-9]{3} [0-9]{4} [0-9]{4})($|\s?[^0-9\s-])", "$1[REDACTED:aadhaar]$3"),
    ("aadhaar-named", r"(?i)(aadhaar\W{0,3})([0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4})\b", "$1[REDACTED:aadhaar]"),
    ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[REDACTED:pan]"),
)
#: A user name, taken only beside a password.
LOGIN = r"(?i)\b(login|user(?:name)?)(\s*[:=]\s*)([^\s,;\[]{2,})"
_CARD = r"\b((?:[0-9]{4}[ -]){3}[0-9]{1,7})\b"
_BARE_CARD = r"(?i)card[^0-9\n]{0,20}([0-9]{13,19})\b"
#: Rule names that are reported under another kind.
KIND_OF = {"bearer": "token", "url-password": "password", "card-code": "one-time-code", "aadhaar-named": "aadhaar"}
#: Names of personal papers.
SENSITIVE_NAME = r"(?i)\b(?:aadhaa?r|pan card|passport|voter|driv(?:ing|er'?s?) licen[cs]e|mark ?sheet|bank statement|salary slip|pay ?slip|form 16|personal docs|kyc)\b"


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _cards(c: Column) -> Column:
    """Grouped digits, or bare ones beside the word, that pass the check sum."""
    found = F.concat(F.regexp_extract_all(c, F.lit(_CARD), 1), F.regexp_extract_all(c, F.lit(_BARE_CARD), 1))
    return F.filter(found, lambda m: _luhn(F.regexp_replace(m, "[ -]", "")))


def kinds(c: Column) -> Column:
    """The kinds of sensitive values in a text, sorted."""
    found = [F.when(c.rlike(pattern), F.lit(KIND_OF.get(kind, kind))) for kind, pattern, _ in RULES] + [F.when(F.size(_cards(c)) > 0, F.lit("card"))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def redact(c: Column) -> Column:
    """The text without the values; null stays null. A user name goes only beside a password."""
    beside = c.rlike(RULES[3][1])
    for _, pattern, to in RULES:
        c = F.regexp_replace(c, pattern, to)
    c = F.aggregate(_cards(c), c, lambda t, m: F.replace(t, m, F.lit("[REDACTED:card]")))
    return F.when(beside, F.regexp_replace(c, LOGIN, "$1$2[REDACTED:login]")).otherwise(c)


def contains_secret(c: Column) -> Column:
    """Does a text hold a credential or an identifier, marks of what was taken out not counted? A key's beginning suffices."""
    bare = F.regexp_replace(c, r"\[REDACTED:[a-z-]+\]", "")
    return (F.size(kinds(bare)) > 0) | bare.rlike(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")


def withheld(c: Column) -> Column:
    """Redacted text, or a remark in its place if it still holds something sensitive."""
    return F.coalesce(scrub(c), F.when(c.isNotNull(), F.lit("[withheld: looked like a credential]")))


def is_sensitive_name(name: Column) -> Column:
    """Does a file or folder name say personal papers?"""
    return F.regexp_replace(name, "_", " ").rlike(SENSITIVE_NAME)


def scrub(c: Column) -> Column:
    """Redacted text, or null if it still holds something sensitive."""
    clean = redact(c)
    return F.when(~contains_secret(clean), clean)
