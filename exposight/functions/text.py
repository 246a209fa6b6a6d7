"""Text columns: whitespace, zero-width characters, digits, tokens, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv

# Unicode white space plus the four separators Java leaves out of (?U)\s.
_SPACE = r"[\s\x1C-\x1F]"


def strip(text: Column) -> Column:
    """Trim any Unicode white space from both ends (``trim`` only knows U+0020)."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){_SPACE}+", " ")


def drop_zero_width(text: Column) -> Column:
    return F.translate(text, fv.ZERO_WIDTH_CHARS, "")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D+", "")


def phone_token_digits(text: Column) -> Column:
    """Digits per phone-like run, runs kept apart by a space."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)[+(]?\d[\d\s().-]*"), F.lit(0))
    return F.array_join(F.transform(runs, digits_only), " ")


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def emails_in(text: Column) -> Column:
    """All e-mail addresses, in text order. Texts without ``@`` skip the pattern."""
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit("@")), find_all(text, fv.EMAIL_PATTERN)).otherwise(none)


def phones_in(text: Column) -> Column:
    return find_all(text, fv.PHONE_PATTERN)


def words(text: Column) -> Column:
    """Lower-cased words of at least two word characters, in text order."""
    return find_all(F.lower(text), fv.WORD_PATTERN)


def preview(text: Column, n_chars: int = fv.PREVIEW_CHARS) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(n_chars))


def or_unknown(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown"))


def finding_line(entity_type: Column, entity_value: Column, confidence: Column) -> Column:
    """``type`` padded to 15 (never cut), the value, the confidence with two decimals."""
    padded = F.when(F.length(entity_type) < 15, F.rpad(entity_type, 15, " ")).otherwise(entity_type)
    return F.concat(padded, entity_value, F.format_string(" (%.2f)", confidence))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]
