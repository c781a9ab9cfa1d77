"""Keys that tell whether two records are one entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import catalog
from .text import fold_accents


def _name(c: Column, stop: list[str]) -> Column:
    t = F.lower(fold_accents(F.trim(F.coalesce(c, F.lit("")))))
    return F.regexp_replace(F.regexp_replace(t, rf"\b(?:l\.l\.c|{'|'.join(stop)})\b", ""), r"[^a-z0-9]", "")


def name_key_a(c: Column) -> Column:
    """For dedupe keys of prospects."""
    return _name(c, catalog.STOP_WORDS_A)


def name_key_b(c: Column) -> Column:
    """For matches between sources; more words are left out."""
    return _name(c, catalog.STOP_WORDS_B)


def cross_key(name: Column, street: Column) -> Column:
    """Name and street; null without a name."""
    n = name_key_b(name)
    return F.when(n != "", F.concat(n, F.lit("|"), name_key_b(street)))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def dedupe_key(given: Column, name: Column, address: Column, postal: Column, website: Column, phone: Column) -> Column:
    """The given key, else the site's host, else ten phone digits, else a hash of name, address and postal code."""
    digits = F.right(F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", ""), F.lit(10))
    basis = F.concat_ws("|", name_key_a(name), name_key_a(address), F.substring(F.coalesce(postal.cast("string"), F.lit("")), 1, 5))
    return F.coalesce(
        F.nullif(given, F.lit("")),
        F.concat(F.lit("web:"), host(website)),
        F.when(F.length(digits) == 10, F.concat(F.lit("tel:"), digits)),
        F.concat(F.lit("name:"), F.substring(F.sha1(basis), 1, 20)),
    )


def same_words(a: Column, b: Column) -> Column:
    """Whether two names have the same words of two letters or more, in any order."""

    def words(c: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(F.lower(fold_accents(F.trim(c))), r"[^a-z]+"), lambda w: F.length(w) > 1)), " ")

    return (words(a) == words(b)) & (words(a) != "")


def is_owner_name(trade: Column, owner: Column) -> Column:
    """Whether a trade name is its owner's own."""
    t, o = name_key_b(trade), name_key_b(owner)
    return (t != "") & (o != "") & ((t == o) | same_words(trade, owner))


def row_hash(*cols: Column) -> Column:
    """SHA-256 of a row's fields, sorted by the caller; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of all its objects sorted at every level and no blanks; null where it can't be read.

    A variant's objects are kept in the order of their keys, so writing one out sorts them; equal
    numbers are written alike. Of a key that an object repeats the last value stands.
    """
    return F.to_json(F.try_parse_json(text))


def document_hash(text: Column, own: str = "sha256") -> Column:
    """sha256: and the digest of a JSON text's canonical form, fields named `own` with a plain value left out at every level.

    In canonical text `"name":` stands only where a key does: inside a string its quotes are escaped.
    """
    value = r'("(?:[^"\\]|\\.)*"|[^,\[\]{}"]+)'
    bare = canonical_json(text)
    for pattern, rest in ((rf',"{own}":{value}', ""), (rf'\{{"{own}":{value},', "{"), (rf'\{{"{own}":{value}\}}', "{}")):
        bare = F.regexp_replace(bare, pattern, rest)
    return F.concat(F.lit("sha256:"), F.sha2(bare, 256))
