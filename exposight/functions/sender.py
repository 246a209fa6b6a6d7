"""Sender columns: display name, user and domain from a From header (strict reading)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_COMMENT = r"\((?:[^()\\]++|\\.)*+\)"
_WORDS = r'[^"<>,@():;\\\[\]]++'
# With or without a domain; never two "@".
_ADDRESS = r'[^<>@\s,"():;]++(?:@[^<>@\s,"():;]++)?'
# Words, quoted words and comments before <address>; or a bare address with an optional (comment).
_NAMED = rf"(?s)^((?:{_QUOTED}|{_COMMENT}|{_WORDS})*+)<\s*({_ADDRESS})\s*>\s*$"
_BARE = rf"^\s*({_ADDRESS})\s*(?:\(([^()]*)\))?\s*$"


def _display_name(phrase: Column) -> Column:
    """Words and quoted words in order, comments behind them in brackets."""
    parts = F.regexp_extract_all(phrase, F.lit(rf'(?s){_QUOTED}|{_COMMENT}|[^\s"(]++'), F.lit(0))

    def inside(part: Column) -> Column:
        return F.regexp_replace(F.substring(part, F.lit(2), F.length(part) - 2), r"(?s)\\(.)", "$1")

    words = F.filter(parts, lambda p: ~p.startswith("("))
    name = F.array_join(F.transform(words, lambda p: F.when(p.startswith('"'), inside(p)).otherwise(p)), " ")
    comments = F.array_join(F.transform(F.filter(parts, lambda p: p.startswith("(")), inside), " ")
    return F.when(comments == "", name).otherwise(F.concat(name, F.lit(" ("), comments, F.lit(")")))


def sender_name(sender: Column) -> Column:
    named = _display_name(F.regexp_extract(sender, _NAMED, 1))
    return F.when(sender.rlike(_NAMED), named).otherwise(F.regexp_extract(sender, _BARE, 2))


def sender_address(sender: Column) -> Column:
    named = F.regexp_extract(sender, _NAMED, 2)
    return F.when(named != "", named).otherwise(F.regexp_extract(sender, _BARE, 1))


def address_user(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def address_domain(address: Column) -> Column:
    at = F.instr(address, "@")
    rest = F.substring(address, at + 1, F.length(address))
    return F.when(at > 0, rest).otherwise(F.lit(""))
