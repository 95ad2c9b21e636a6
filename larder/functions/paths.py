"""Category paths as columns: canonical form, slug, parent, level, segments."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What NFKD leaves of each character of the basic plane in ASCII, by rule: first those with one character, then those with more
_PLAIN = {chr(c): base for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and (base := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode())}
_ONE = {k: v for k, v in _PLAIN.items() if len(v) == 1}
_MORE = "[" + "".join(k for k, v in _PLAIN.items() if len(v) > 1) + "]"
BLANKS = " \t\n\r\x0b\x0c"


def _spelled(c: Column) -> Column:
    """Characters that stand for several (ligatures, fractions, squared units) spelled out."""
    table = F.create_map(*(F.lit(x) for k, v in _PLAIN.items() if len(v) > 1 for x in (k, v)))
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")


def ascii_lower(c: Column) -> Column:
    """Letters without accents, other non-ASCII characters dropped, lower case. Text in ASCII is spared the tables."""
    one = F.translate(c, "".join(_ONE), "".join(_ONE.values()))
    plain = F.regexp_replace(F.when(one.rlike(_MORE), _spelled(one)).otherwise(one), r"[^\x00-\x7F]", "")
    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c))


def resolve(c: Column, base: str) -> Column:
    """A link as an absolute URL; relative links hang below base."""
    root = base.rstrip("/")
    host = F.lit("/".join(root.split("/")[:3]))
    return F.when(c.rlike("^https?://"), c).when(c.startswith("//"), F.concat(F.lit(root.split("//")[0]), c)).when(c.startswith("/"), F.concat(host, c)).otherwise(F.concat(F.lit(root + "/"), c))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _clean_segment(s: Column) -> Column:
    plain = ascii_lower(F.coalesce(F.try_url_decode(s), s))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9_~.-]", "-"), "-{2,}", "-"), "^-+|-+$", "")


def normalize_path(c: Column, base: str | None = None) -> Column:
    """`/a/b/`; NULL and blank give '', a link without segments gives '/'."""
    raw = F.btrim(c, F.lit(BLANKS))
    path = F.replace(F.regexp_replace(url_path(resolve(raw, base) if base else raw), ";[^/]+", ""), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.transform(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".", "..")), _clean_segment), lambda s: s != "")
    return F.when(raw.isNull() | (raw == ""), F.lit("")).when(F.size(parts) == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/")))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def level(path: Column) -> Column:
    return F.size(segments(path))


def slug(path: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(""))


def parent(path: Column) -> Column:
    """NULL for a path of one segment or none."""
    s = segments(path)
    return F.when(F.size(s) > 1, F.concat(F.lit("/"), F.array_join(F.slice(s, 1, F.size(s) - 1), "/"), F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path itself and every path above it."""
    s = segments(path)
    return F.transform(F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(s, 1, n), "/"), F.lit("/")))


def strip_language(s: Column, languages: tuple[str, ...] = ("en", "nl", "de")) -> Column:
    """Segments without a leading language."""
    return F.when(F.lower(F.get(s, F.lit(0))).isin(*languages), F.slice(s, 2, F.size(s))).otherwise(s)
