"""HTML columns: text, title, meta tags, images and classified links.

Pages are read as regular text with patterns, so everything stays inside the
JVM. A quoted attribute value may hold ``>``; a dropped element that is never
closed ends with the page.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions import text as tx
from exposight.functions import urls

_CUT = "\u0001"
# Possessive runs of "anything but <" keep every pattern linear and free of deep recursion.
_COMMENT = r"<!--[^-]*+(?:-(?!->)[^-]*+)*+-->"
# What stands in a tag: anything but its end, with quoted values, which start behind "=", taken whole.
_QUOTED = r"""=\s*+(?:"[^"]*+"|'[^']*+')?+"""
_INSIDE = rf"(?:[^>=]++|{_QUOTED})*+"
_TAG = rf"{_COMMENT}|<[/!A-Za-z]{_INSIDE}>"
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Attributes before a certain one; a quoted value is never entered.
_BEFORE = rf"(?:[^>=]|{_QUOTED})*?"


def _named_characters() -> dict[str, str]:
    table = {name: chr(code) for name, code in name2codepoint.items()}
    table["apos"] = "'"
    return table


def _windows_characters() -> dict[str, str]:
    """Numeric references 128-159 mean the Windows-1252 characters."""
    table = {}
    for code in range(128, 160):
        try:
            table[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return table


def _lookup(table: dict[str, str], key: Column) -> Column:
    # A folded literal map: the JSON text is parsed once, while planning.
    literal = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    return F.try_element_at(literal, key)


def _character(code: Column) -> Column:
    """Character of a code point; U+FFFD where there is none."""
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    plain = F.when(valid, F.decode(utf32, "UTF-32")).otherwise(F.lit(chr(0xFFFD)))
    return F.coalesce(_lookup(_windows_characters(), code.cast("string")), plain)


def _decode_reference(piece: Column) -> Column:
    """``piece`` follows an ampersand; replace the reference at its start."""

    def rest(length: Column) -> Column:
        left = F.substring(piece, length + 1, F.length(piece))
        return F.regexp_replace(left, "^;", "")

    def numeric(reference: Column) -> Column:
        hexadecimal = F.substring(reference, F.lit(3), F.length(reference))
        code = F.coalesce(
            F.substring(reference, F.lit(2), F.length(reference)).try_cast("bigint"),
            F.conv(F.when(F.length(hexadecimal) <= 8, hexadecimal), 16, 10).try_cast("bigint"),
            F.lit(-1).cast("bigint"),
        )
        return F.when(reference == "", F.concat(F.lit("&"), piece)).otherwise(
            F.concat(_character(code), rest(F.length(reference)))
        )

    def named(name: Column) -> Column:
        known = F.coalesce(_lookup(_named_characters(), name), F.concat(F.lit("&"), name))
        return F.when(name == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(known, rest(F.length(name))))

    number = F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9A-Fa-f]+)", 0)
    word = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*", 0)
    return (
        F.when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substring(piece, F.lit(5), F.length(piece))))
        .when(piece.startswith("#"), tx.bind(number, numeric))
        .otherwise(tx.bind(word, named))
    )


def decode_entities(text: Column) -> Column:
    """Named and numeric character references to characters."""
    pieces = F.split(text, "&")
    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _decode_reference)
    decoded = F.concat(pieces[0], F.array_join(tail, ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def drop_elements(html: Column, tags: list[str] = fv.NON_TEXT_TAGS) -> Column:
    """Html without comments and without the given elements and their content."""
    content = r"[^<]*+(?:<(?!/\1\s*+>)[^<]*+)*+(?:</\1\s*+>|\z)"
    pattern = rf"(?i){_COMMENT}|<({'|'.join(tags)})(?=[\s/>]){_INSIDE}(?:(?<=/)>|>{content})"
    return F.regexp_replace(html, pattern, _CUT)


def drop_hidden_text(markup: Column) -> Column:
    """Without elements whose text is not page text, though links and images in them count."""
    tags = "|".join(fv.HIDDEN_TEXT_TAGS)
    end = r"(?:</\1\s*+>|(?=</ruby)|\z)"
    content = r"[^<]*+(?:<(?!/\1\s*+>|/ruby)[^<]*+)*+"
    return F.regexp_replace(markup, rf"(?i)<({tags})(?=[\s/>]){_INSIDE}>{content}{end}", _CUT)


def text_nodes(html: Column) -> Column:
    """Text between tags, comments and dropped elements; entities still encoded."""
    return F.split(F.regexp_replace(html, _TAG, _CUT), _CUT)


def visible_text(markup: Column) -> Column:
    """Every text node stripped, empty ones left out, joined by one space.

    ``markup`` is html after ``drop_elements``, as for all functions below.
    """
    return _joined_nodes(drop_hidden_text(markup), " ")


def _joined_nodes(html: Column, separator: str) -> Column:
    nodes = F.transform(text_nodes(html), lambda t: tx.strip(decode_entities(t)))
    return F.array_join(F.filter(nodes, lambda t: t != ""), separator)


def strip_mail_markup(text: Column) -> Column:
    """Mail text without tags: ``<a@b.c>`` is kept as ``a@b.c``, nodes are joined by
    one space and not stripped, and code elements do not count as text."""
    unwrapped = F.regexp_replace(text, fv.ANGLE_ADDRESS_PATTERN, "$1")
    nodes = text_nodes(drop_elements(unwrapped, ["script", "style", "template"]))
    kept = F.transform(F.filter(nodes, lambda t: t != ""), decode_entities)
    has_markup = F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))
    return F.when(has_markup, F.array_join(kept, " ")).otherwise(text)


def _value_text(raw: Column) -> Column:
    """Attribute value as written to its text: quotes off, references decoded."""

    def unquoted(value: Column) -> Column:
        quoted = value.startswith('"') | value.startswith("'")
        return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    return tx.bind(tx.bind(raw, unquoted), decode_entities)


def _attribute(tag: Column, name: str) -> Column:
    return _value_text(F.regexp_extract(tag, rf"(?is)^<{_BEFORE}\s{name}\s*=\s*{_VALUE}", 1))


def title(markup: Column) -> Column:
    return _joined_nodes(F.regexp_extract(markup, rf"(?is)<title\b{_INSIDE}>(.*?)</title\s*>", 1), "")


def meta_content(markup: Column, name: str) -> Column:
    """``content`` of the first ``<meta name=...>``, ``""`` when there is none."""
    tags = F.regexp_extract_all(markup, F.lit(rf"(?is)<meta\b{_INSIDE}>"), F.lit(0))
    named = F.filter(tags, lambda t: _attribute(t, "name") == name)
    return F.coalesce(_attribute(F.get(named, F.lit(0)), "content"), F.lit(""))


def image_sources(markup: Column) -> Column:
    pattern = rf"(?is)<img\b{_BEFORE}\ssrc\s*=\s*{_VALUE}"
    raw = F.regexp_extract_all(markup, F.lit(pattern), F.lit(1))
    return F.transform(raw, _value_text)


# An opening tag with what follows up to the next opening or closing one.
_ANCHOR = rf"(?i)<a\s{_INSIDE}>[^<]*+(?:<(?!/?a[\s>])[^<]*+)*+"
_HREF = rf"(?is)^<a{_BEFORE}\shref\s*=\s*{_VALUE}"


def anchors(markup: Column) -> Column:
    """``array<struct<href,label>>``; the label is stripped and lower-cased."""
    found = F.regexp_extract_all(markup, F.lit(_ANCHOR), F.lit(0))
    with_href = F.filter(found, lambda a: a.rlike(_HREF))
    return F.transform(
        with_href,
        lambda a: F.struct(
            _value_text(F.regexp_extract(a, _HREF, 1)).alias("href"),
            F.lower(_joined_nodes(a, "")).alias("label"),
        ),
    )


def _is_social(url: Column, domains: list[str], mode: str) -> Column:
    if mode == "substring":
        hit = [F.contains(url, F.lit(d)) for d in domains]
    elif mode == "host_suffix":
        host = F.lower(F.regexp_extract(url, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        hit = [(host == d) | host.endswith("." + d) for d in domains]
    else:
        raise ValueError(f"unknown social link mode: {mode}")
    found = hit[0]
    for h in hit[1:]:
        found = found | h
    return found


def classified_links(
    markup: Column,
    base: Column,
    social_domains: list[str] = fv.SOCIAL_LINK_DOMAINS,
    social_mode: str = "substring",
) -> Column:
    """One struct per anchor: resolved ``url`` and the classes it falls into.

    ``base`` holds the parts of the page's address (``urls.base_parts``). A
    ``mailto:`` link is an e-mail and nothing else; any other link may be a
    contact, privacy and social link at once.
    """

    def classify(a: Column) -> Column:
        def flags(url: Column) -> Column:
            mail = url.startswith("mailto:")
            return F.struct(
                url.alias("url"),
                mail.alias("is_mail"),
                (~mail & F.contains(a["label"], F.lit("contact"))).alias("is_contact"),
                (~mail & F.contains(a["label"], F.lit("privacy"))).alias("is_privacy"),
                (~mail & _is_social(url, social_domains, social_mode)).alias("is_social"),
            )

        return tx.bind(urls.resolve_from(base, a["href"]), flags)

    return F.transform(anchors(markup), classify)
