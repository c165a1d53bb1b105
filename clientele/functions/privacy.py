"""Masking of personal data and policy phrases, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The masking patterns and their markers, in the order they apply.
# (?U) gives digits, blanks and word boundaries their Unicode meaning.
EMAIL = (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[REDACTED_EMAIL]")
NUMBERS = (
    (r"(?U)\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"(?U)\b(?:\d[ -]?){13,16}\b", "[REDACTED_CARD]"),
    (
        r"(?U)(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b",
        "[REDACTED_PHONE]",
    ),
)
ANY_DIGIT = r"(?U)\d"

# Phrases that ask for unmasked personal data.
POLICY_PHRASES = (
    "raw email",
    "export pii",
    "unmasked phone",
    "dump pii",
    "raw phone",
    "extract emails",
    "extract phone",
)

REDACTED = "[REDACTED]"


def _replace(text: Column, pattern: str, marker: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(marker))


def mask_text(text: Column) -> Column:
    """Replace emails, social security numbers, card numbers and phones in free text.

    Texts without an @ or without a digit cannot match and skip the costly patterns.
    """
    no_email = F.when(F.contains(text, F.lit("@")), _replace(text, *EMAIL)).otherwise(text)
    no_numbers = no_email
    for pattern, marker in NUMBERS:
        no_numbers = _replace(no_numbers, pattern, marker)
    return F.when(F.rlike(text, F.lit(ANY_DIGIT)), no_numbers).otherwise(no_email)


def mask_email(email: Column) -> Column:
    shown = F.concat(F.left(email, F.lit(2)), F.lit("***@"), F.substring_index(email, "@", -1))
    return F.when(F.contains(email, F.lit("@")), shown).otherwise(REDACTED)


def mask_phone(phone: Column) -> Column:
    shown = F.concat(F.lit("***-***-"), F.right(phone.cast("string"), F.lit(4)))
    return F.coalesce(shown, F.lit(REDACTED))


def mask_name(name: Column) -> Column:
    shown = F.concat(F.left(name.cast("string"), F.lit(1)), F.lit("***"))
    return F.coalesce(shown, F.lit(""))


def mask_identifier(kind: Column, value: Column) -> Column:
    """Mask an identity-map value by its type; other identifiers keep their last four characters."""
    return (
        F.when(kind == "email", mask_email(value))
        .when(kind == "phone", mask_phone(value))
        .otherwise(F.concat(F.lit("***"), F.right(value, F.lit(4))))
    )


def mask_profile(df: DataFrame) -> DataFrame:
    """Mask the direct identifiers a profile frame carries."""
    masks = {
        "primary_email": mask_email,
        "primary_phone": mask_phone,
        "first_name": mask_name,
        "last_name": mask_name,
    }
    present = {name: mask(F.col(name)) for name, mask in masks.items() if name in df.columns}
    return df.withColumns(present) if present else df


def policy_phrase(text: Column) -> Column:
    """The first policy phrase the text contains, or null."""
    lowered = F.lower(text)
    return F.coalesce(
        *[F.when(F.contains(lowered, F.lit(phrase)), F.lit(phrase)) for phrase in POLICY_PHRASES]
    )
