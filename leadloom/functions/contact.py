"""Mail addresses, phones, domains and postal codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import catalog
from .text import ascii_edges, clean, fold_accents

# The shapes of mail addresses and phones.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# Mailboxes and hosts of templates, file endings, and mailboxes that rank higher or lower.
_JUNK = r"(?i)^(?:example|test|your|email|name|user|sentry|wixpress|sample|no-?reply|donotreply)@|@(?:example|sentry|wix|squarespace|godaddy|shopify|wordpress|gmail\.example)\."
_ASSET = r"(?i)\.(?:png|jpe?g|gif|webp|svg|css|js)$"
_GENERIC = r"^(?:info|hello|contact|admin|office|hola|contacto|ventas|sales)@"
_OTHER = r"^(?:support|help|jobs|careers|privacy|legal|press|media)@"
_PHONE = r"(?:\+?1[-.\s]?)?\(?([2-9]\d{2})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})"


def email_status(c: Column) -> Column:
    """valid, disposable or invalid."""
    e = F.lower(clean(c, 190))
    return F.when(~e.rlike(r"^[^\s@]+@[^\s@]+\.[a-z]{2,}$"), "invalid").when(email_domain(e).isin(catalog.DISPOSABLE), "disposable").otherwise("valid")


def email_domain(c: Column) -> Column:
    return F.when(F.instr(c, "@") > 0, F.split_part(F.lower(c), F.lit("@"), F.lit(2))).otherwise("")


def free_mail(c: Column) -> Column:
    return email_domain(c).isin(catalog.FREE_MAIL)


def free_mail_name(c: Column) -> Column:
    """Whether the host's first label is that of a free mail service, whatever follows it."""
    return F.coalesce(F.lower(c).rlike(f"@(?:{'|'.join(catalog.FREE_MAIL_NAMES)})\\."), F.lit(False))


def phone(c: Column) -> Column:
    """+1 and ten digits where it can be, else + and the digits; none: empty."""
    d = F.regexp_replace(clean(c, 30), r"[^0-9]", "")
    return F.when(d == "", "").when(F.length(d) == 10, F.concat(F.lit("+1"), d)).otherwise(F.concat(F.lit("+"), d))


def valid_date(c: Column) -> Column:
    """The ISO date if it is one of the calendar, else null."""
    v = clean(c, 20)
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v))


def zip_in_ranges(c: Column, ranges: list[tuple[int, int]]) -> Column:
    n = F.substring(c.cast("string"), 1, 5).try_cast("int")
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | n.between(low, high)
    return F.coalesce(hit, F.lit(False))


def in_service_area(c: Column, zips: list[str]) -> Column:
    """An empty list, or no code, counts as inside."""
    if not zips:
        return F.lit(True)
    z = clean(c, 10)
    return (z == "") | z.isin(zips)


def emails(html: Column) -> Column:
    """Distinct addresses of a page: those behind mailto: first, then those in the text."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)mailto:([^"'?>\s]+)"""), F.lit(1))
    text = F.regexp_extract_all(html, F.lit(f"({EMAIL})"), F.lit(1))
    found = F.transform(F.concat(links, text), lambda e: F.regexp_replace(F.lower(e), r"[.,;:]+$", ""))
    return F.filter(F.array_distinct(found), lambda e: (F.length(e) < 80) & ~e.rlike(_JUNK) & ~e.rlike(_ASSET))


def ranked_emails(html: Column, domain: Column) -> Column:
    """emails() by rank: the site's own domain, then general mailboxes; ties stay in their order."""

    def rank(e: Column, i: Column) -> Column:
        own = (domain != "") & (F.regexp_replace(email_domain(e), r"^www\.", "") == F.regexp_replace(domain, r"^www\.", ""))
        score = F.when(own, 10).otherwise(0) + F.when(e.rlike(_GENERIC), 4).otherwise(0) - F.when(e.rlike(_OTHER), 3).otherwise(0)
        return F.struct((-score).alias("s"), i.alias("i"), e.alias("e"))

    return F.transform(F.array_sort(F.transform(emails(html), rank)), lambda x: x["e"])


def page_phone(html: Column) -> Column:
    t = F.regexp_replace(html, r"<[^>]+>", " ")
    return F.when(t.rlike(_PHONE), F.concat(F.lit("+1"), *[F.regexp_extract(t, _PHONE, k) for k in (1, 2, 3)])).otherwise("")


def domain_candidates(name: Column) -> Column:
    """Up to six domains that a business of this name may have."""
    base = F.regexp_replace(F.lower(fold_accents(name)), ascii_edges(r"\b(?:inc|llc|l\.l\.c|corp|corporation|co|company|ltd|the|and|&)\b"), " ")
    words = F.filter(F.split(F.regexp_replace(base, r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    names = F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(F.slice(words, 1, 2), "")))
    names = F.filter(names, lambda n: F.length(n).between(4, 40))
    return F.slice(F.flatten(F.transform(names, lambda n: F.array(F.concat(n, F.lit(".com")), F.concat(n, F.lit(".net"))))), 1, 6)


def page_evidence(html: Column, name: Column, number: Column, postal: Column, address: Column) -> Column:
    """Which of name, phone, zip and address a page shows; two are a match.

    A postal code counts by its first five characters, as ZIP+4 does with and without a dash; one of six to eight digits is no such code and counts whole.
    """
    shown = F.lower(fold_accents(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")))
    words = F.filter(F.split(F.lower(fold_accents(name)), r"\s+"), lambda w: F.length(w) > 3)
    digits = F.right(F.regexp_replace(F.coalesce(number, F.lit("")), r"\D", ""), F.lit(10))
    street = F.regexp_extract(F.coalesce(address, F.lit("")), r"^\d+", 0)
    code = F.when(postal.rlike(r"^\d{6,8}$"), postal).otherwise(F.substring(postal, 1, 5))

    def found(text: Column) -> Column:
        hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
        return F.array_compact(
            F.array(
                F.when((F.size(words) > 0) & (hits >= 0.6 * F.size(words)), "name"),
                F.when((F.length(digits) == 10) & F.contains(F.regexp_replace(text, r"\D", ""), digits), "phone"),
                F.when((F.coalesce(postal, F.lit("")) != "") & F.contains(text, code), "zip"),
                F.when((F.length(street) >= 3) & F.contains(text, street), "address"),
            )
        )

    # The text as the only entry of an array, so that it is made once and not for every test.
    return F.element_at(F.transform(F.array(shown), found), 1)
