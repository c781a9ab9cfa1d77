"""Text functions: Column -> Column, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and what they fold to.
_ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÑÇÝ"
_PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuncyyAAAAAAAEEEEEIIIIIOOOOOOUUUUUNCY"


def clean(c: Column, most: int = 300) -> Column:
    """Trimmed and cut; null counts as empty."""
    return F.substring(F.trim(F.coalesce(c.cast("string"), F.lit(""))), 1, most)


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def fold_accents(c: Column) -> Column:
    """Accented Latin letters without their marks; combining marks are dropped."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def word(pattern: str) -> str:
    """A pattern bounded by characters that are not ASCII letters, digits or underscores, whatever the case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def ascii_edges(pattern: str) -> str:
    r"""A pattern whose \b is an edge of ASCII words; Java's own counts accented letters, too."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def any_of(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def title_case(c: Column) -> Column:
    """First letter of each word upper-cased; an apostrophe separates only after O, D or L.

    Words are split at anything but letters, digits and apostrophes, so letters after accented ones stay.
    """
    low = F.lower(F.trim(c))
    parts = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}'’]+|[^\p{L}\p{N}'’]+)"), F.lit(1))

    def one(w: Column) -> Column:
        prefix = w.rlike(r"^[odl]['’]\p{L}")
        named = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1), F.upper(F.substring(w, 3, 1)), F.expr("''"))
        rest = F.when(prefix, F.concat(named, F.substr(w, F.lit(4)))).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
        return rest

    return F.array_join(F.transform(parts, one), "")


def html_to_text(c: Column) -> Column:
    """Styles removed, block ends as line breaks, tags stripped, four entities decoded, line breaks squeezed."""
    t = F.regexp_replace(c, r"(?is)<style.*?</style>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|tr|h1|h2|li)>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, text in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(text))
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def redact(c: Column) -> Column:
    """Bearer and Basic credentials and key assignments without their secrets."""
    t = F.regexp_replace(c, r"(?i)(?<![A-Za-z0-9_])(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 [REDACTED]")
    return F.regexp_replace(t, r"""(?i)("?(?:authorization|x-api-key|api[_-]?key|token)"?\s*[:=]\s*"?)[^"'\s,}]{8,}""", "$1[REDACTED]")


def masked_id(c: Column) -> Column:
    """An ellipsis and the last eight characters."""
    return F.concat(F.lit("…"), F.right(c.cast("string"), F.lit(8)))
