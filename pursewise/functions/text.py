"""Text expressions (E-9, E-10, E-11, E-12, E-13), JVM-side Column builders."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*(?=;));?"
# The most frequent names first: the list is searched in order.
_COMMON = ("amp", "lt", "gt", "quot", "nbsp", "apos")
_NAMED = {n: html5[n + ";"] for n in (*_COMMON, *sorted(k[:-1] for k in html5 if k.endswith(";")))}
# Numbers 128 to 159 stand for the Windows-1252 character, as in browsers.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if bytes([n]).decode("cp1252", "ignore")}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blank(c) -> Column:
    """Trim every kind of blank (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def clean_text(c) -> Column:
    """E-9: runs of two or more blanks become one space, then trim all blank kinds.

    A single tab or newline inside the text stays as it is.
    """
    return strip_blank(F.regexp_replace(_c(c), r"\s{2,}", " "))


def _literal_map(pairs: dict) -> Column:
    """A constant map, folded to one literal; a ``map`` of its 4,000 parts would be copied and
    walked with every expression that holds it."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _referenced(ref: Column) -> Column:
    """The character of one reference; an unknown name stays as it is."""
    body = F.regexp_replace(ref, "^&#?|;$", "")
    hexa = F.lower(F.substring(body, 1, 1)) == "x"
    digits = F.when(hexa, F.substring(body, 2, 1_000_000)).otherwise(body)
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.length(digits) > 8, F.lit(-1)).otherwise(
        F.when(hexa, F.conv(digits, 16, 10)).otherwise(F.try_to_number(digits, F.lit("99999999")).cast("string")).cast("int"))
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    char = F.coalesce(F.try_element_at(_literal_map(_WINDOWS), number.cast("string")), F.when(valid, plain).otherwise(F.lit("\ufffd")))
    return F.when(F.substring(ref, 2, 1) == "#", char).otherwise(
        F.coalesce(F.try_element_at(_literal_map(_NAMED), body), ref))


def decode_entities(c) -> Column:
    """Decode character references once, left to right: every HTML name that ends in ``;``
    and every number (``&amp;lt;`` stays ``&lt;``)."""
    text = _c(c)
    parts = F.split(text, _REFERENCE)
    refs = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), 0), _referenced)
    full = F.array_join(F.flatten(F.zip_with(parts, refs, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    common = text  # most texts hold the common names only; ``&amp;`` goes last
    for name in (*_COMMON[1:], _COMMON[0]):
        common = F.replace(common, F.lit(f"&{name};"), F.lit(_NAMED[name]))
    other = text.rlike("&(?!(?:" + "|".join(_COMMON) + ");)")
    return F.when(~text.contains("&"), text).when(~other, common).otherwise(full)


def file_part(c) -> Column:
    """E-10: commas removed, blanks and slashes to ``_``."""
    return F.translate(F.regexp_replace(_c(c), ",+", ""), " /", "__")


def digit_runs(c) -> Column:
    """E-11: every run of digits."""
    return F.regexp_extract_all(_c(c), F.lit("([0-9]+)"), 1)


def url_encode(c) -> Column:
    """E-12: form-encode like Python's ``quote_plus`` (blank -> ``+``, ``/`` -> ``%2F``).

    Java's encoder keeps ``*`` and escapes ``~``; Python does the opposite.
    """
    enc = F.url_encode(_c(c))
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


# Fixed value: dd/mm/yyyy.
DAY_PATTERN = "[0-9]{2}/[0-9]{2}/[0-9]{4}"


def matches_day_pattern(c) -> Column:
    """E-13: ``dd/mm/yyyy`` at the start of the text (a prefix match, like ``re.match``)."""
    return _c(c).rlike("^" + DAY_PATTERN)


def json_value(c) -> Column:
    """A value as JSON text (string quoted and escaped, number, date as text, null):
    ``to_json`` of a one-element array, brackets dropped."""
    j = F.to_json(F.array(_c(c)))
    return j.substr(F.lit(2), F.length(j) - F.lit(2))
