"""Rule sets of six public registers: which rows are businesses that can be shown to be so, and why others aren't.

Each takes a DataFrame of string columns and gives it with kind and reason (null for accepted rows).
Missing columns' values are nulls and count as blank. Lists and limits are parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import zip_in_ranges
from ..functions.keys import is_owner_name
from ..plans import catalog
from ..plans.chain import verdict
from .segments import sector, sector_segment

# Patterns that decide, a table for each rule, whatever the case unless said otherwise.
HOME_WORDINGS = [r"microenterprise\s+home\s+kitchen", r"\bmhko\b", r"home\s+kitchen", r"cottage\s+food", r"\bresidential\b", r"\bresidence\b", r"private\s+home"]
ONE_DWELLING = [r"\bp\.?\s?o\.?\s*box\b", r"\bpmb\b", r"\bapt\b|\bapartment\s+\d", r"\bunit\s*[0-9a-z]*\b", r"\b#\s*\d+\b", r"\bspc\b|\bspace\b"]
NOT_COMMERCIAL_ADDRESS = [
    r"\bp\.?\s?o\.?\s*box\b", r"\bpmb\b", r"\bprivate\s+mail\b", r"\bapt\b|\bapartment\b", r"\bunit\s*[0-9a-z]*\b", r"\b#\s*\d+\b", r"\bspc\b|\bspace\b", r"\bmobile\s+home\b", r"\btrailer\b",
    r"\bresidence\b|\bresidential\b",
]
NOT_INSTITUTIONAL = [r"single\s*family|vacant|land|mobile\s*home|duplex|triplex"]
NO_SCHOOL = [r"^no\s*data$", r"^no\s*school$", r"^n/?a$", r"^none$", r"^\s*$"]
HOME_BASED = [r"family\s+child\s+care\s+home", r"\bfcch\b", r"child\s+care\s+home", r"home[-\s]?based", r"in[-\s]?home", r"\bresiden(ce|tial)\b"]
PERMIT_HOME = [
    r"\bresidential?\b", r"\bsingle[-\s]?family\b", r"\bmulti[-\s]?family\b", r"\bduplex\b|\btriplex\b", r"\bapartments?\b", r"\bcondo(minium)?s?\b", r"\btownhomes?\b|\btownhouses?\b", r"\bdwelling\b",
    r"\bsdu\b", r"\badu\b", r"\bjadu\b", r"\bcompanion\s+unit\b", r"\baccessory\s+(dwelling|apt)\b",
]
SIGNS = [r"\bsigns?\s*-\s*(permanent|temporary)\b", r"\bsign\s+p(er)?mt\b"]
NOT_A_PREMISE = [r"\bp\.?\s?o\.?\s*box\b", r"\bpost\s+office\s+box\b", r"\bpmb\b", r"^\s*(?:none|n/?a|unknown|same)\s*$"]
LICENSE_HOME = [r"\bapt\b|\bapartment\s+\d", r"\bresiden(ce|tial)\b", r"\bmobile\s*home\b", r"\btrailer\b"]
SURNAME_FIRST = r"^[\p{Lu}][\p{L}'’-]+\s*,\s*[\p{Lu}][\p{L}'’-]+(\s+[\p{Lu}][\p{L}'’-]+)?$"  # as written
INITIAL_BETWEEN = r"^[\p{Lu}][\p{L}'’-]+\s+[\p{Lu}]\.?\s+[\p{Lu}][\p{L}'’-]+$"  # as written
TWO_NAMES = r"^[\p{Lu}][\p{L}'’-]+\s+[\p{Lu}][\p{L}'’-]+$"  # as written
PERSON_SUFFIX = r"\b(jr|sr|iii|iv|md|dds|dmd|do|esq)\.?$"
PERMIT_PERSON = [r"\b(jr|sr|iii|iv)\.?$", r"\bdba\s*:?\s*$"]
BUSINESS_WORDS = (
    r"\b(inc|llc|l\.l\.c|corp|co|company|ltd|group|holdings|enterprises|partners|restaurant|taqueria|taquería|cafe|café|coffee|market|deli|bakery|panaderia|panadería|pizza|grill|bar|kitchen|catering|"
    r"caterer|foods?|services?|school|hospital|center|centre|store|shop|mart|liquor|hotel|motel|club|association|church|university|college|district|county|city)\b"
)
ENTITY_WORDS = (
    r"\b(inc|incorporated|llc|l\.l\.c|llp|lp|plc|pc|corp|corporation|co|company|ltd|limited|group|holdings?|enterprises?|partners?|associates?|services?|systems?|solutions?|properties|apartments?|villas?|"
    r"manor|plaza|center|centre|centro|hospital|clinic|medical|health|care|hospice|surgery|laboratory|pharmacy|school|university|college|church|foundation|trust\s+co|authority|district|village|terrace|"
    r"gardens?|towers?|commons|residences|housing|senior|living|construction|builders?|contracting|contractors?|electric|plumbing|roofing|mechanical|industries)\b"
)
LEGAL_SUFFIX = r"[\s,.](l\.?l\.?c|l\.?l\.?p|l\.?p|p\.?c|p\.?l\.?l\.?c|inc|incorporated|corp|corporation|co|company|ltd|limited|partnership)\.?$"
ACTIVITY_WORDS = (
    r"\b(construction|contracting|contractors?|builders?|building|development|developers?|properties|realty|group|enterprises?|industries|services|systems|solutions|electric(?:al)?|plumbing|roofing|mechanical|"
    r"hvac|engineering|architects|interiors|restaurant|hospitality|brewing|coffee|market|retail|hotel|motel|clinic|dental|medical|laboratories|logistics|storage|automotive|manufacturing)\b"
)
SCHOOL_WORDS = r"school|academy|elementary|middle|high|college|institute|center|centre|preschool|kinder|campus|charter|education"
NAME_SEPARATOR = r"\s*[/|]\s*|\s+-\s+|\s*\b(?:and|&)\b\s*"

_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(*patterns: str, case: bool = False) -> str:
    r"""All patterns as one, so that a text is read once; \b is an edge of ASCII words, as Java's own counts accented letters, too."""
    # Before a letter an edge is a place that no word character precedes: one look and not four.
    begun = [re.sub(r"(?<!\\)\\b(?=\(?[A-Za-z])", "(?<![A-Za-z0-9_])", p) for p in patterns]
    return ("" if case else "(?i)") + "|".join(f"(?:{p})" for p in begun).replace(r"\b", _EDGE)


def says(c: Column, *patterns: str, case: bool = False) -> Column:
    return c.rlike(java(*patterns, case=case))


def _v(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))


def _with(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the named columns that it lacks as nulls."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[.,\s]+$", "")


def _shaped(n: Column) -> Column:
    return says(n, SURNAME_FIRST, INITIAL_BETWEEN, case=True) | says(n, PERSON_SUFFIX)


def is_person(name: Column, exceptions: list[str]) -> Column:
    """Whether a name has a person's shape, or is two names without a word of business."""
    n = _bare(name)
    return _shaped(n) | (n.rlike(TWO_NAMES) & ~says(n, *exceptions))


def is_organization(name: Column) -> Column:
    return says(F.trim(name), ENTITY_WORDS)


def _mixed(name: Column, exceptions: list[str]) -> Column:
    """Whether one of several parts of a name is a person."""
    # Most names have one part: they aren't split at all.
    parts = F.filter(F.split(F.trim(name), java(NAME_SEPARATOR)), lambda p: p != "")
    return says(name, NAME_SEPARATOR) & (F.size(parts) > 1) & F.exists(parts, lambda p: is_person(p, exceptions))


def holder_tier(name: Column) -> Column:
    """1 for a legal suffix, 2 for a word of business, null for persons, mixtures and anything else."""
    n = _bare(F.coalesce(name, F.lit("")))
    person = _mixed(n, [ACTIVITY_WORDS]) | is_person(n, [ACTIVITY_WORDS])
    return F.when((n == "") | person, None).when(says(n, LEGAL_SUFFIX), 1).when(says(n, ACTIVITY_WORDS), 2)


def trade_name(trade: Column, holder: Column) -> Column:
    """The trade name unless it is a person's; else the holder if it is marked as an entity; else null."""
    words = [ACTIVITY_WORDS, ENTITY_WORDS]
    t, h = _bare(F.coalesce(trade, F.lit(""))), _bare(F.coalesce(holder, F.lit("")))
    own = (h != "") & ~_mixed(h, words) & ~is_person(h, words) & says(h, ENTITY_WORDS)
    return F.when((t != "") & ~is_person(t, words), t).when(own, h)


def is_active(flag: Column, flags: list[str], status: Column, excluded: list[str], allowed: list[str]) -> Column:
    """Whether the flag and the status both say so, whatever the case; an empty list of allowed ones allows all."""
    low = lambda xs: [x.lower() for x in xs]
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    ok = F.lower(F.trim(F.coalesce(flag, F.lit("")))).isin(low(flags)) & ~s.isin(low(excluded))
    return ok & s.isin(low(allowed)) if allowed else ok


def food_permits(df: DataFrame, flags=("A",), excluded=("Expired",), allowed=("Issued", "Permit Renewed")) -> DataFrame:
    names = ["record_id", "record_name", "permit_status", "active_permit", "business_type", "address", "zip"]
    df = _with(df, names)
    home = F.lit(False)
    for c in ("business_type", "record_name", "permit_status", "address"):
        home = home | says(_v(c), *HOME_WORDINGS)
    blank = (_v("record_name") == "") | (_v("address") == "") | ~_v("zip").rlike(r"^\d{5}") | (_v("business_type") == "")
    name = _v("record_name")
    person = (says(name, SURNAME_FIRST, case=True) | says(name, *PERMIT_PERSON)) & ~says(name, BUSINESS_WORDS)
    return verdict(
        df,
        [
            ("invalid", "no record", F.coalesce(*[F.col(n) for n in names]).isNull()),
            ("residential", "a home", home),
            ("inactive", "not active", ~is_active(_v("active_permit"), list(flags), _v("permit_status"), list(excluded), list(allowed))),
            ("unverifiable", "incomplete", blank),
            ("unverifiable", "a person's name", person),
        ],
    )


def city_certificates(df: DataFrame, as_of: str, city: str = r"(?i)san\s*diego") -> DataFrame:
    """With segment, sector and full_address. The owner's name is compared, then dropped."""
    names = "account_key account_status date_cert_expiration date_cert_effective business_owner_name ownership_type dba_name naics_code address_no address_pd address_road address_sfx address_city address_zip".split()
    df = _with(df, names)
    until, start = F.try_to_timestamp(_v("date_cert_expiration")), F.try_to_timestamp(_v("date_cert_effective"))
    now = F.lit(as_of).cast("timestamp")
    form, code = F.upper(_v("ownership_type")), _v("naics_code")
    full = F.concat_ws(" ", *[F.nullif(_v(c), F.lit("")) for c in ("address_no", "address_pd", "address_road", "address_sfx")])
    df = df.select("*", full.alias("full_address"), sector(code).alias("sector"), sector_segment(code).alias("segment"))
    out = verdict(
        df,
        [
            ("inactive", "status", F.lower(_v("account_status")) != "active"),
            ("unverifiable", "unreadable expiry", (_v("date_cert_expiration") != "") & until.isNull()),
            ("inactive", "expired", until < now),
            ("inactive", "not yet effective", start > now),
            ("unverifiable", "no legal form", form == ""),
            ("personal", "legal form of a person", form.isin(catalog.PERSONAL_FORMS)),
            ("unverifiable", "unknown legal form", ~form.isin(catalog.ENTITY_FORMS)),
            ("unverifiable", "no trade name", _v("dba_name") == ""),
            ("personal", "the owner's name", is_owner_name(_v("dba_name"), _v("business_owner_name"))),
            ("unverifiable", "no industry code", code == ""),
            ("residential", "excluded industry", F.regexp_replace(code, r"\D", "").isin(catalog.EXCLUDED_CODES)),
            ("unverifiable", "industry sector", F.col("segment").isNull()),
            ("unverifiable", "address incomplete", (_v("address_no") == "") | (_v("address_road") == "") | (_v("address_city") == "") | ~F.substring(_v("address_zip"), 1, 5).rlike(r"^\d{5}$")),
            ("unverifiable", "other city", ~_v("address_city").rlike(city)),
            ("residential", "not a commercial address", says(full, *NOT_COMMERCIAL_ADDRESS) | says(_v("dba_name"), *NOT_COMMERCIAL_ADDRESS)),
        ],
    )
    return out.drop("business_owner_name")


def multifamily(df: DataFrame, cities: list[str], state: str = "CA", min_units: int = 5, ranges=tuple(catalog.COUNTY_ZIP_RANGES)) -> DataFrame:
    df = _with(df, ["PROPERTY_ID", "PROPERTY_NAME_TEXT", "TOTAL_UNIT_COUNT", "PROPERTY_CATEGORY_NAME", "STD_ADDR", "STD_CITY", "STD_ST", "STD_ZIP5"])
    count = _v("TOTAL_UNIT_COUNT")
    units = F.when(count == "", 0.0).when(count.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), count.try_cast("double"))
    postal = F.substring(_v("STD_ZIP5"), 1, 5)
    inside = F.lower(_v("STD_CITY")).isin([c.lower() for c in cities]) | zip_in_ranges(postal, list(ranges))
    return verdict(
        df,
        [
            ("out_of_area", "state", F.upper(_v("STD_ST")) != state),
            ("unverifiable", "units", units.isNull()),
            ("residential", "too few units", units < min_units),
            ("residential", "category", says(_v("PROPERTY_CATEGORY_NAME"), *NOT_INSTITUTIONAL)),
            ("out_of_area", "city and zip", ~inside),
            ("unverifiable", "address", (_v("STD_ADDR") == "") | (_v("STD_CITY") == "") | ~postal.rlike(r"^\d{5}$")),
            ("residential", "one dwelling", says(_v("STD_ADDR"), *ONE_DWELLING)),
            ("unverifiable", "no id", _v("PROPERTY_ID") == ""),
            ("personal", "not an organization", ~is_organization(_v("PROPERTY_NAME_TEXT"))),
        ],
    )


def schools(df: DataFrame, county: str = "San Diego", status: str = "Active") -> DataFrame:
    df = _with(df, ["CDSCode", "StatusType", "County", "School", "Street", "City", "Zip", "DOCType", "SOCType", "EILName", "Virtual"])
    name, postal = _v("School"), F.substring(_v("Zip"), 1, 5)
    everywhere = F.concat_ws(" ", *[_v(c) for c in ("School", "SOCType", "DOCType", "EILName", "Street")])
    return verdict(
        df,
        [
            ("out_of_area", "county", F.lower(_v("County")) != county.lower()),
            ("inactive", "status", F.lower(_v("StatusType")) != status.lower()),
            ("unverifiable", "not a school", says(name, *NO_SCHOOL)),
            ("residential", "home-based", says(everywhere, *HOME_BASED)),
            ("unverifiable", "virtual", _v("Virtual").rlike(r"(?i)^y(?:es)?$")),
            ("unverifiable", "address", (_v("Street") == "") | (_v("City") == "") | ~postal.rlike(r"^\d{5}$")),
            ("residential", "one dwelling", says(_v("Street"), *ONE_DWELLING)),
            ("unverifiable", "no code", _v("CDSCode") == ""),
            ("personal", "not an institution", ~(is_organization(name) | says(name, SCHOOL_WORDS))),
        ],
    )


def building_permits(df: DataFrame, as_of: str, commercial: list[str], ambiguous: list[str], status: str = "Issued", days: int = 90) -> DataFrame:
    """With issued (a date), issued_days_ago and holder_tier."""
    names = "APPROVAL_ID APPROVAL_TYPE APPROVAL_STATUS APPROVAL_SCOPE APPROVAL_ISSUE_DATE APPROVAL_PERMIT_HOLDER JOB_BC_CODE_DESCRIPTION GIS_ADDRESS PROJECT_TYPE PROJECT_TITLE PROJECT_SCOPE".split()
    df = _with(df, names)
    day = F.substring(_v("APPROVAL_ISSUE_DATE"), 1, 10)
    issued = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day))
    df = df.select("*", issued.alias("issued"), F.datediff(F.lit(as_of).cast("date"), issued).alias("issued_days_ago"), holder_tier(F.col("APPROVAL_PERMIT_HOLDER")).alias("holder_tier"))
    kind = _v("JOB_BC_CODE_DESCRIPTION")
    scope = F.concat_ws(" ", kind, *[_v(c) for c in ("APPROVAL_SCOPE", "PROJECT_SCOPE", "PROJECT_TITLE", "PROJECT_TYPE", "APPROVAL_TYPE")])
    return verdict(
        df,
        [
            ("inactive", "status", _v("APPROVAL_STATUS") != status),
            ("unverifiable", "issue date", F.col("issued").isNull()),
            ("stale", "too old", F.col("issued_days_ago") > days),
            ("unverifiable", "in the future", F.col("issued_days_ago") < 0),
            ("unverifiable", "no id", _v("APPROVAL_ID") == ""),
            ("unverifiable", "no class", kind == ""),
            ("mixed_use_ambiguous", "class", kind.isin(ambiguous)),
            ("not_relevant", "a sign", says(kind, *SIGNS) | says(_v("APPROVAL_TYPE"), *SIGNS)),
            ("not_commercial", "class", ~kind.isin(commercial)),
            ("residential", "scope", says(scope, *PERMIT_HOME)),
            ("unverifiable", "no address", _v("GIS_ADDRESS") == ""),
            ("unverifiable", "address pending", _v("GIS_ADDRESS").rlike(r"(?i)\[pending\]")),
            ("residential", "one dwelling", says(_v("GIS_ADDRESS"), *ONE_DWELLING)),
            ("personal", "holder", F.col("holder_tier").isNull()),
        ],
    )


def active_licenses(df: DataFrame, types: list[str], county: str = "SAN DIEGO", state: str = "CA", status: str = "ACTIVE") -> DataFrame:
    """With license_type (two characters at least) and business_name."""
    df = _with(df, ["License Type", "File Number", "Type Status", "Primary Name", "DBA Name", "Prem Addr 1", "Prem Addr 2", "Prem City", "Prem State", "Prem Zip", "Prem County"])
    code = F.lpad(_v("License Type"), F.greatest(F.lit(2), F.length(_v("License Type"))), F.lit("0"))
    street = F.trim(F.concat_ws(" ", _v("Prem Addr 1"), _v("Prem Addr 2")))
    df = df.select("*", code.alias("license_type"), trade_name(F.col("DBA Name"), F.col("Primary Name")).alias("business_name"))
    return verdict(
        df,
        [
            ("out_of_area", "county", F.upper(_v("Prem County")) != county),
            ("out_of_area", "state", F.upper(_v("Prem State")) != state),
            ("inactive", "status", F.upper(_v("Type Status")) != status),
            ("not_relevant", "type", ~F.col("license_type").isin(types)),
            ("unverifiable", "no file number", _v("File Number") == ""),
            ("unverifiable", "address", (street == "") | (_v("Prem City") == "") | ~F.substring(_v("Prem Zip"), 1, 5).rlike(r"^\d{5}$")),
            ("unverifiable", "not a premise", says(street, *NOT_A_PREMISE)),
            ("residential", "a dwelling", says(street, *LICENSE_HOME)),
            ("personal", "name", F.col("business_name").isNull()),
        ],
    )
