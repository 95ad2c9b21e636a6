"""Names, counts and slugs as columns."""

from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words written in capitals in category names, and slugs too general to name a product's category.
ACRONYMS = ("diy", "ean", "sku", "usb", "dac", "dsp", "rms")
GENERAL_SLUGS = ("speakers", "home-audio", "car-audio", "components", "accessories", "audio-components", "crossover-components", "diy-kits")
# White space of all scripts, no-break spaces included
BLANKS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


# Character references as HTML 5 reads them: names by first letter, those that count without a semicolon (longest first),
# and numbers that don't stand for their own character
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_NAMES: dict[str, dict[str, str]] = {}
for _name, _value in html.entities.html5.items():
    _NAMES.setdefault(_name[0], {})[_name] = _value
_BARE = {n: v for n, v in html.entities.html5.items() if not n.endswith(";")}
_LONGEST = "^(?:" + "|".join(sorted(_BARE, key=len, reverse=True)) + ")"
_NUMBERS = {str(n): v for n in range(0x110000) if not 0xD800 <= n < 0xE000 and (n < 0xA0 or 0xFDD0 <= n < 0xFDF0 or n & 0xFFFE == 0xFFFE) and (v := html.unescape(f"&#{n};")) != chr(n)}


def _table(values: dict, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)  # of a literal, so it is made once


def _character(number: Column) -> Column:
    """A code point as text. Spark's chr knows 256 of them."""
    known = F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.try_element_at(_table(_NUMBERS, "map<string,string>"), number.cast("string")))
    return F.coalesce(known, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(number), 8, "0"))), "UTF-32"))


def _decoded(ref: Column) -> Column:
    """What a reference (`REFERENCE`, without its &) stands for."""
    digits = F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    base = F.when(F.substring(ref, 2, 1).isin("x", "X"), 16).otherwise(10)
    number = F.when(F.length(digits) > 8, 0x110000).when(digits == "", 0).otherwise(F.when(base == 16, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint"))
    bare = F.regexp_extract(ref, _LONGEST, 0)
    begun = F.when(bare != "", F.concat(F.try_element_at(_table(_BARE, "map<string,string>"), bare), F.substring(ref, F.length(bare) + 1, F.length(ref))))
    named = F.try_element_at(F.try_element_at(_table(_NAMES, "map<string,map<string,string>>"), F.left(ref, F.lit(1))), ref)
    return F.when(ref.startswith("#"), _character(number)).otherwise(F.coalesce(named, begun, F.concat(F.lit("&"), ref)))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where f names c more than once and c is long to work out: it is worked out once for a row."""
    return F.element_at(F.transform(F.array(c), f), 1)


def unescape(c: Column) -> Column:
    """Named and numeric character references become characters, as HTML 5 has them. Built-in functions, since workers of
    Python hold whole batches of texts; a text without & stays as it is."""

    def decoded(s: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(s, F.lit(REFERENCE), F.lit(0)), lambda r: _decoded(F.substring(r, F.lit(2), F.length(r))))
        parts = F.zip_with(F.split(s, REFERENCE, -1), refs, lambda text, ref: F.concat(text, F.coalesce(ref, F.lit(""))))
        return F.when(F.contains(s, F.lit("&")), F.array_join(parts, "")).otherwise(s)

    return once(c, decoded)


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether c holds one of the words. A pattern, so c is worked out once and not once for each word."""
    return F.rlike(c, F.lit("|".join(re.escape(w) for w in words)))


def squeeze(c: Column) -> Column:
    """Runs of white space become single blanks; ends are trimmed."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def normalize_text(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(unescape(c), "<[^>]+>", "")))


def normalize_paragraph(c: Column) -> Column:
    return squeeze(unescape(F.coalesce(c, F.lit(""))))


def normalize_spec_name(c: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(F.rtrim(squeeze(unescape(c))), r":\s*$", "")))


def clean_category_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\(\d+\)\s*$", ""))


def extract_count(span: Column, text: Column) -> Column:
    """(N) of up to 8 digits in the span, else at the end of the text, else 0."""
    at = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int")
    return F.coalesce(at(F.coalesce(span, F.lit("")), r"\((\d{1,8})\)"), at(F.coalesce(text, F.lit("")), r"\((\d{1,8})\)\s*$"), F.lit(0))


def slugify(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\s_-]+", "-"), "^-+|-+$", "")


def format_category_name(slug: Column) -> Column:
    words = F.filter(F.split(F.replace(slug, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.initcap(w))), " ")


def first_present(*values: Column) -> Column:
    """The first value that is neither NULL nor ''."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def file_key(sku: Column) -> Column:
    return F.translate(sku, "/\\", "__")


def failure_message(sku: Column, kind: Column, text: Column) -> Column:
    return F.concat_ws(": ", sku, kind, text)


def legacy_slugs(csv: Column) -> Column:
    """The non-blank parts of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")


def legacy_primary(csv: Column) -> Column:
    """Name of the last slug that isn't too general, else of the last, else 'Uncategorized'."""
    slugs = legacy_slugs(csv)
    best = F.coalesce(F.try_element_at(F.filter(slugs, lambda s: ~F.lower(s).isin(*GENERAL_SLUGS)), F.lit(-1)), F.try_element_at(slugs, F.lit(-1)))
    return F.coalesce(format_category_name(best), F.lit("Uncategorized"))
