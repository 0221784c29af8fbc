"""Masking expressions: each takes and returns a string Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardenlake.functions.text import digits_of, let, replace_matches, strip

# The expressions of the free-text pass, in the order they run.
FREE_TEXT_PATTERNS = {
    "email": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?U)\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "ssn": r"(?U)\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"(?U)\b(?:\d{4}[-\s]?){3}\d{4}\b",
}
STREET_PATTERN = (r"(?iUd)\d+\s+.*?(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)")
ZIP_PATTERN = r"(?U)\b\d{5}(?:-\d{4})?\b"


def stars(length: Column, mask_char: str = "*") -> Column:
    return F.repeat(F.lit(mask_char), F.greatest(length, F.lit(0)))


def mask_email(value: Column, preserve_domain: bool = True, mask_char: str = "*") -> Column:
    at = F.instr(value, "@")
    local = F.substr(value, F.lit(1), at - 1)
    domain = F.substr(value, at + 1)
    size = at - 1
    masked_local = F.when(size <= 2, stars(size, mask_char)).otherwise(
        F.concat(F.substring(local, 1, 1), stars(size - 2, mask_char), F.right(local, F.lit(1))))
    if not preserve_domain:
        dot = F.instr(domain, ".")
        domain = F.when(dot > 0, F.concat(stars(dot - 1, mask_char), F.substr(domain, dot))).otherwise(
            stars(F.length(domain), mask_char))
    return F.when(at == 0, value).otherwise(F.concat(masked_local, F.lit("@"), domain))


def mask_phone(value: Column, preserve_format: bool = True, mask_char: str = "*") -> Column:
    digits = digits_of(value)
    count = F.length(digits)
    if preserve_format:
        kept = F.regexp_replace(value, r"(?U)\d(?=(?:\D*\d){4})", mask_char)
    else:
        kept = F.concat(stars(count - 4, mask_char), F.right(digits, F.lit(4)))
    return F.when(count < 4, stars(F.length(value), mask_char)).otherwise(kept)


def mask_ssn(value: Column, mask_char: str = "*") -> Column:
    digits = digits_of(value)
    hidden = f"{mask_char * 3}-{mask_char * 2}-"
    return F.when(F.length(digits) == 9, F.concat(F.lit(hidden), F.right(digits, F.lit(4)))).otherwise(
        stars(F.length(value), mask_char))


def mask_credit_card(value: Column, mask_char: str = "*") -> Column:
    def grouped(digits: Column) -> Column:
        hidden = F.concat(stars(F.length(digits) - 4, mask_char), F.right(digits, F.lit(4)))
        return F.when(F.length(digits) < 4, stars(F.length(value), mask_char)).otherwise(
            F.regexp_replace(hidden, "(.{4})(?=.)", "$1 "))

    return let(digits_of(value), grouped)


def anonymize_text(value: Column, kinds: tuple[str, ...] = ("email", "phone", "ssn", "credit_card")) -> Column:
    """Mask every match in free text; a later pass sees the output of the earlier ones."""
    masks: dict[str, Callable[[Column], Column]] = {
        "email": mask_email, "phone": mask_phone, "ssn": mask_ssn, "credit_card": mask_credit_card}
    out = value
    for kind, pattern in FREE_TEXT_PATTERNS.items():
        if kind in kinds:
            out = _masked_pass(out, pattern, masks[kind])
    return out


def _masked_pass(value: Column, pattern: str, mask: Callable[[Column], Column]) -> Column:
    return let(value, lambda text: replace_matches(text, pattern, lambda m: mask(m)))


def anonymize_name(value: Column, preserve_initial: bool = True) -> Column:
    first = F.regexp_extract(value, r"(?U)^\s*(\S)", 1)
    shown = F.concat(first, F.lit(". [ANONYMIZED]")) if preserve_initial else F.lit("[ANONYMIZED]")
    return F.when(first == "", value).otherwise(shown)


def anonymize_address(value: Column, preserve_zip: bool = False) -> Column:
    hidden = F.regexp_replace(value, STREET_PATTERN, "[ADDRESS REDACTED]")
    if preserve_zip:
        zip_code = F.regexp_extract(value, ZIP_PATTERN, 0)
        hidden = F.when(zip_code == "", hidden).otherwise(F.concat(hidden, F.lit(", "), zip_code))
    return strip(hidden)


def hash_value(value: Column, salt: str, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat(value, F.lit(salt)), 256), 1, length)


def random_token() -> Column:
    """16 random hex digits; differs from run to run and leaves no mapping."""
    return F.substring(F.sha2(F.uuid(), 256), 1, 16)


def by_format(value: Column, kind: str, salt: str) -> Column:
    dispatch = {
        "email": mask_email, "phone": mask_phone, "ssn": mask_ssn, "credit_card": mask_credit_card,
        "name": anonymize_name, "address": anonymize_address,
    }
    return dispatch[kind](value) if kind in dispatch else hash_value(value, salt)
