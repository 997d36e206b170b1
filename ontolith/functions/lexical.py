"""Lexical checks of IRIs, language tags and literals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least and greatest value of integer datatypes (None: unbounded).
INTEGER_BOUNDS = {
    "integer": (None, None),
    "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
    "long": (-(2**63), 2**63 - 1),
    "int": (-(2**31), 2**31 - 1),
    "short": (-(2**15), 2**15 - 1),
    "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 2**16 - 1),
    "unsignedByte": (0, 255),
}


def _beyond(text: Column, bound: int, above: bool) -> Column:
    """Whether an integer's text passes a bound; by digits first, so no size overflows."""
    digits = F.regexp_replace(F.regexp_replace(text, "^[+-]", ""), "^0+(?=.)", "")
    negative = text.startswith("-") & (digits != "0")
    limit = str(abs(bound))
    larger = (F.length(digits) > len(limit)) | ((F.length(digits) == len(limit)) & (digits > limit))
    smaller = (F.length(digits) < len(limit)) | ((F.length(digits) == len(limit)) & (digits < limit))
    if above:
        return ~negative & larger if bound >= 0 else ~negative | smaller
    return negative & larger if bound < 0 else negative | smaller if bound else negative


def valid_literal(lexical: Column, datatype: Column) -> Column:
    """Whether a lexical form is in its datatype's space; datatypes other than integers, decimal and boolean pass."""
    name = F.regexp_replace(datatype, "^(xsd:|http://www.w3.org/2001/XMLSchema#)", "")
    whole = lexical.rlike(r"^[+-]?[0-9]+$")
    out = F.when(name == "boolean", lexical.isin("true", "false", "1", "0"))
    out = out.when(name == "decimal", lexical.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"))
    for kind, (low, high) in INTEGER_BOUNDS.items():
        ok = whole
        if low is not None:
            ok = ok & ~_beyond(lexical, low, False)
        if high is not None:
            ok = ok & ~_beyond(lexical, high, True)
        out = out.when(name == kind, ok)
    return out.otherwise(True)


def valid_iri(value: Column) -> Column:
    """Absolute, without white space, controls or the characters that IRIs exclude; percent signs escape two digits."""
    return value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~value.rlike(r"[\x00-\x20<>\"{}|\\^`\x7F-\x9F]") & ~value.rlike(r"%(?![0-9A-Fa-f]{2})")


def valid_language(value: Column) -> Column:
    """Well formed, no extension letter twice, and before any of those no variant (five letters or more, or a digit and three) twice."""
    parts = F.split(F.lower(value), "-")
    singles = F.filter(parts, lambda x: F.length(x) == 1)
    head = F.split(F.regexp_replace(F.lower(value), "-[a-z0-9](-.*)?$", ""), "-")
    variants = F.filter(F.slice(head, 2, 64), lambda x: x.rlike("^([a-z0-9]{5,8}|[0-9][a-z0-9]{3})$"))
    once = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    return value.rlike(r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$") & once(singles) & once(variants)


def language_matches(lang: Column, preference: Column) -> Column:
    """Basic filtering: equal, or a longer tag that starts with the preference."""
    low, want = F.lower(lang), F.lower(preference)
    return (low == want) | low.startswith(F.concat(want, F.lit("-")))


def local_name(value: Column) -> Column:
    return F.regexp_extract(value, r"([^#/:]*)$", 1)


def namespace(value: Column) -> Column:
    return F.regexp_replace(value, r"[^#/:]*$", "")
