"""Queries that run the rule sets of the registers: a record per order, whose fields are mostly in order and now and then break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registers as r
from ..operators import views
from . import catalog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-31"

# Building classes of permits that are commercial, and those that do not tell.
COMMERCIAL_CLASSES = [
    "Add/Alt Tenant Improvements", "Add/Alt NonRes Bldg or Struct", "ACC STRUCT- NON RES", "Acc Bldg to NonRes", "Demo of NonRes Buildings", "Industrial Building", "Store/Mercantile Building",
    "Office/Bank/Professional Bldg", "Service Station/Repair Garage", "Amusement/Recreation Building", "School/Educational Building", "Commercial Temp Occ Struct", "Hotel/Motel", "Restaurant",
    "Hospital/Institutional Bldg", "Church/Religious Building", "Public Works/Utilities Bldg", "Parking Garage",
]
AMBIGUOUS_CLASSES = ["Acc Bldg to 3+ Fam or NonRes", "Pool or Spa/3+ Fam or NonRes"]
CITIES = ["Chula Vista", "La Mesa"]
LICENSE_TYPES = [t for types in catalog.LICENSE_RATING.values() for t in types] + ["04"]

# Fields of each register: of `step` records in a row one has each of the odd values, the others take turns with the usual ones.
Fields = dict[str, tuple[int, list[str | None], list[str | None]]]
_STREETS = ["12 Main St", "340 Harbor Dr", "7 Unity Way", "88 Spaceport Blvd", "9 Aptos Ave", "5 B St #4"]
_NO_STREET = [None, " ", "PO Box 7", "P.O.Box 12", "1 Elm Apt B", "1 Elm Apartment 12B", "1 Elm Unit 3", "1 Elm PMB 9", "1 Elm#4", "Space 12 Elm", "1 Elm spc 3"]
FOOD: Fields = {
    "record_id": (97, ["r"], [None]),
    "record_name": (61, ["Ola Grill", "Casa Taquería", "Bay Market"], ["Vega, Luz", "Vega, Luz Inc", "Luz Vega Jr.", "Sol dba", "Vega, Luz Ana", "Microenterprise Home Kitchen", None, " "]),
    "permit_status": (41, ["Issued", "permit renewed", " ISSUED "], ["Expired", "expired", "Pending", None]),
    "active_permit": (43, ["A", "a"], ["B", None]),
    "business_type": (47, ["Restaurant", "Presidential Caterer"], ["MHKO", "Cottage  Food", "Private home", "residence", "Residential care", None]),
    "address": (53, ["1 Main St", "2 Home Ave"], ["9 Home Kitchen Rd", "", None]),
    "zip": (59, ["92101", "92101-1234"], ["9210", "x92101", None]),
}
CITY: Fields = {
    "account_status": (101, ["Active", "ACTIVE "], ["Closed", None]),
    "date_cert_expiration": (89, ["2026-01-01", "", "2024-02-01"], ["soon", "2023-12-31"]),
    "date_cert_effective": (83, ["2020-05-05", ""], ["2025-01-01", "once"]),
    "business_owner_name": (3, ["Vega, Luz", "Ola Dental LLC", "José Niño"], []),
    "ownership_type": (67, ["LLC", "corp", "SCORP", "LP", "no", "PRF"], [None, "SOLE", "h-w", "Trust", "IND", "XX"]),
    "dba_name": (61, ["Ola Dental", "Harbor Café", "Bay Auto"], [None, "Luz Vega", "JOSE NINO", "The José Niño Company", "Ola PMB 12", "Trailer Sales", "Luz"]),
    "naics_code": (71, ["621210", "722511", "54-1110", "23", "811111"], [None, "624410", "53-1110", "111110", "5", "814110"]),
    "address_no": (73, ["10", "2200"], [None, " "]),
    "address_pd": (2, ["", "N"], []),
    "address_road": (53, ["Main", "Private Mailer", "Unity"], [None, "PO Box", "Mobile  Home", "Residence"]),
    "address_sfx": (47, ["St", "Ave"], ["St Apt 4", "St Apartment", "Ct unit 9", None]),
    "address_city": (43, ["San Diego", "SANDIEGO"], [None, "Austin"]),
    "address_zip": (41, ["92101", "92103-1111"], ["921", None]),
}
MULTIFAMILY: Fields = {
    "PROPERTY_ID": (73, ["p1"], [None, " "]),
    "PROPERTY_NAME_TEXT": (43, ["Palm Villas", "Bay Senior Living", "Harbor Towers"], ["Vega, Luz", "Palm", None, "Luz Vega Esq."]),
    "TOTAL_UNIT_COUNT": (53, ["40", " 5 ", "1e2", "12.0"], ["many", "4", None, "-7", "40 units", "4d"]),
    "PROPERTY_CATEGORY_NAME": (47, ["Insured", "", "Subsidized"], ["Single Family", "Vacant lot", "MobileHome", "Highland", "Triplex"]),
    "STD_ADDR": (37, _STREETS, _NO_STREET),
    "STD_CITY": (41, ["Chula Vista", "LA MESA", "Elsewhere"], [None]),
    "STD_ST": (61, ["CA", "ca"], ["NV", None]),
    "STD_ZIP5": (31, ["91910", "92100", "91987-1", "91990"], ["x", "9191", None, "92200"]),
}
SCHOOLS: Fields = {
    "CDSCode": (71, ["37"], [None]),
    "StatusType": (53, ["Active", "active"], ["Closed", None]),
    "County": (59, ["San Diego", "SAN DIEGO"], ["Kern", None]),
    "School": (43, ["Ola Elementary", "Harbor Academy", "Highland Sur", "Bay Health"], ["No Data", "none", "N/A", None, "Luz Vega", "Sol", "In-Home Academy"]),
    "Street": (37, _STREETS, _NO_STREET),
    "City": (61, ["San Diego"], [None]),
    "Zip": (47, ["92101", "92101-22"], ["9210", None]),
    "DOCType": (67, ["Unified", ""], ["FCCH"]),
    "SOCType": (73, ["Elementary Schools (Public)", "Presidential"], ["Family Child Care Home", "Residence hall"]),
    "EILName": (79, ["Elementary", ""], ["home based", "homebased"]),
    "Virtual": (41, ["N", "", "V"], ["Y", "yes"]),
}
PERMITS: Fields = {
    "APPROVAL_ID": (101, ["A1"], [None]),
    "APPROVAL_TYPE": (83, ["Building", "Design - permanent"], ["Sign - Permanent", "Sign Pmt", "Signs-temporary"]),
    "APPROVAL_STATUS": (79, ["Issued"], ["issued", "Closed", None]),
    "APPROVAL_SCOPE": (73, ["tenant work", "adultery wing", "Dwellings"], ["new ADU", "Townhomes", "single family", "companion  unit", "JADU"]),
    "APPROVAL_ISSUE_DATE": (67, ["2024-01-10T00:00:00", "2023-11-02", "2024-01-31"], ["2023-11-01", "2024-02-01", "2024-02-30", "01/10/2024", None]),
    "APPROVAL_PERMIT_HOLDER": (
        43, ["Ola Builders, Inc.", "Coastal Plumbing", "Sol LLC", "A&B Roofing"],
        ["Luz Vega", "Luz Vega - Ola Builders Inc", "Luz Vega and Ola LLC", "Luz Vega & Ola LLC", "Luz Vega&Ola LLC", "Luz Construction", "Vega, Luz", "Luz A. Vega", "Sol", None, "Ola / Luz Vega", "Bay Inc Jr", "Vega LLC."],
    ),
    "JOB_BC_CODE_DESCRIPTION": (47, COMMERCIAL_CLASSES, [*AMBIGUOUS_CLASSES, None, "Garage", "restaurant"]),
    "GIS_ADDRESS": (37, _STREETS, [*_NO_STREET, "1 B St [Pending]"]),
    "PROJECT_TYPE": (61, ["", "Commercial"], ["Condominiums", "Residentia"]),
    "PROJECT_TITLE": (59, ["", "Tower"], ["Multi-Family", "SDU 4"]),
    "PROJECT_SCOPE": (53, ["", "roof"], ["accessory apt", "duplex"]),
}
LICENSES: Fields = {
    "License Type": (71, ["41", "47", " 20", "4"], ["99", "7", None, "410"]),
    "File Number": (73, ["9"], [None]),
    "Type Status": (67, ["ACTIVE", "active"], ["SUREND", None]),
    "Primary Name": (41, ["VEGA, LUZ", "Ola Holdings LLC", "Sol"], ["Luz Vega / Ola LLC", "Luz Vega & Ola LLC", "Luz Vega&Ola LLC", None, "Bay Group."]),
    "DBA Name": (29, ["Ola Restaurant", "Sol", "Luz Market"], ["Luz Vega", None, "Vega, Luz", "Luz A Vega.", "Bay Jr", ",", "Álvaro Núñez"]),
    "Prem Addr 1": (37, [*_STREETS, "1 Residenz"], [None, "PO Box 7", "Post Office Box 9", "None", "n/a", "Same", "Trailer 7", "1 Elm Apartment 12B", "MobileHome Park", "1 Elm PMB 9"]),
    "Prem Addr 2": (43, ["", "Suite 1"], ["Apt 4", "residence", "pmb"]),
    "Prem City": (79, ["San Diego"], [None]),
    "Prem State": (61, ["CA", "ca"], ["NV", None]),
    "Prem Zip": (53, ["92101", "92101-1"], ["", "9210"]),
    "Prem County": (59, ["San Diego", "SAN DIEGO"], ["KERN", None]),
}


def _text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else f"'{value}'"


def _field(step: int, usual: list[str | None], odd: list[str | None]) -> str:
    """SQL of one field, the same in Spark and DuckDB."""
    taken = " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(odd))
    turns = " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(usual))
    common = f"CASE (o_orderkey + {step}) % {len(usual)} {turns} END"
    return f"CASE o_orderkey % {step} {taken} ELSE {common} END" if odd else common


def records(spark, sf_dir: str, fields: Fields) -> DataFrame:
    """A register's records, o_orderkey as id."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.selectExpr("o_orderkey AS id", *[f"{_field(*f)} AS `{n}`" for n, f in fields.items()])


def _verdicts(fields: Fields, rules: str, more: str = "", steps: str = "") -> str:
    """SQL with the trimmed fields as table d; steps are further tables, the last of which is named v; each rule gives 'kind: reason'."""
    d = ", ".join(f"trim(coalesce({_field(*f)}, '')) AS \"{n}\"" for n, f in fields.items())
    base = f"WITH d AS (SELECT o_orderkey AS id, {d} FROM orders), " + (steps or "v AS (SELECT * FROM d)")
    return f"{base}, w AS (SELECT *, CASE {rules} END AS verdict FROM v) SELECT id, split_part(verdict, ': ', 1) AS kind, split_part(verdict, ': ', 2) AS reason{more} FROM w"


def _says(c: str, *patterns: str, flags: str = "'i'") -> str:
    """One test per pattern; this engine's own edges of words are those of ASCII."""
    tests = [f"regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}', {flags})" for p in patterns]
    return "(" + " OR ".join(tests) + ")"


def _person(n: str, *exceptions: str) -> str:
    shape = _says(n, r.SURNAME_FIRST, r.INITIAL_BETWEEN, flags="'c'") + " OR " + _says(n, r.PERSON_SUFFIX)
    return f"({shape} OR ({_says(n, r.TWO_NAMES, flags=chr(39) + 'c' + chr(39))} AND NOT {_says(n, *exceptions)}))"


def _bare(n: str) -> str:
    return f"regexp_replace(trim({n}), '[.,\\s]+$', '')"


def _mixed(n: str, *exceptions: str) -> str:
    parts = f"list_filter(regexp_split_to_array(trim({n}), '(?i){r.NAME_SEPARATOR}'), lambda p: p <> '')"
    return f"(len({parts}) > 1 AND len(list_filter({parts}, lambda p: {_person(_bare('p'), *exceptions)})) > 0)"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle.replace("AS STRING", "AS VARCHAR")
        return f

    return add


@query(
    _verdicts(
        FOOD,
        f"""WHEN {' OR '.join(_says(c, *r.HOME_WORDINGS) for c in ('business_type', 'record_name', 'permit_status', 'address'))} THEN 'residential: a home'
        WHEN lower(active_permit) <> 'a' OR lower(permit_status) = 'expired' OR lower(permit_status) NOT IN ('issued', 'permit renewed') THEN 'inactive: not active'
        WHEN record_name = '' OR address = '' OR NOT regexp_matches(zip, '^[0-9]{{5}}') OR business_type = '' THEN 'unverifiable: incomplete'
        WHEN ({_says('record_name', r.SURNAME_FIRST, flags="'c'")} OR {_says('record_name', *r.PERMIT_PERSON)}) AND NOT {_says('record_name', r.BUSINESS_WORDS)} THEN 'unverifiable: a person''s name'""",
    )
)
def register_food_permits(spark, sf_dir):
    """CLS-01..04."""
    return r.food_permits(records(spark, sf_dir, FOOD)).select("id", "kind", "reason")


_KEY = r"regexp_replace(regexp_replace(strip_accents(lower({0})), '\b(inc|llc|l\.l\.c|corp|corporation|company|co|ltd|lp|the|and|de|del|la|el|dba)\b', '', 'g'), '[^a-z0-9]', '', 'g')"
_SET = r"list_sort(list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^a-z]+'), lambda w: len(w) > 1))"


@query(
    _verdicts(
        CITY,
        f"""WHEN lower(account_status) <> 'active' THEN 'inactive: status'
        WHEN date_cert_expiration <> '' AND until IS NULL THEN 'unverifiable: unreadable expiry' WHEN until < TIMESTAMP '{AS_OF}' THEN 'inactive: expired'
        WHEN try_cast(date_cert_effective AS TIMESTAMP) > TIMESTAMP '{AS_OF}' THEN 'inactive: not yet effective'
        WHEN form = '' THEN 'unverifiable: no legal form' WHEN form IN ('SOLE', 'H-W', 'HW', 'TRUST', 'IND', 'INDIVIDUAL') THEN 'personal: legal form of a person'
        WHEN form NOT IN ('CORP', 'LLC', 'SCORP', 'LP', 'NO', 'PRF') THEN 'unverifiable: unknown legal form' WHEN dba_name = '' THEN 'unverifiable: no trade name'
        WHEN trade <> '' AND holder <> '' AND (trade = holder OR ({_SET.format('dba_name')} = {_SET.format('business_owner_name')} AND len({_SET.format('dba_name')}) > 0)) THEN 'personal: the owner''s name'
        WHEN naics_code = '' THEN 'unverifiable: no industry code'
        WHEN digits IN ('814110', '624410', '812990', '711510', '531110', '531210', '812112', '812113') THEN 'residential: excluded industry'
        WHEN len(digits) < 2 OR digits[1:2] NOT IN ('23', '42', '44', '45', '53', '54', '55', '56', '62', '71', '72', '81') THEN 'unverifiable: industry sector'
        WHEN address_no = '' OR address_road = '' OR address_city = '' OR NOT regexp_full_match(address_zip[1:5], '[0-9]{{5}}') THEN 'unverifiable: address incomplete'
        WHEN NOT {_says('address_city', 'san[ ]*diego')} THEN 'unverifiable: other city'
        WHEN {_says('full_address', *r.NOT_COMMERCIAL_ADDRESS)} OR {_says('dba_name', *r.NOT_COMMERCIAL_ADDRESS)} THEN 'residential: not a commercial address'""",
        ", full_address, CASE WHEN digits[1:2] = '72' THEN 'restaurants' WHEN digits[1:2] IN ('62', '54', '55', '56', '71', '81') THEN 'offices' WHEN digits[1:2] = '53' THEN 'property_managers' "
        "WHEN digits[1:2] = '23' THEN 'post_construction' WHEN digits[1:2] IN ('42', '44', '45') THEN 'retail' END AS segment",
        "v AS (SELECT *, try_cast(date_cert_expiration AS TIMESTAMP) AS until, upper(ownership_type) AS form, regexp_replace(naics_code, '[^0-9]', '', 'g') AS digits, "
        f"{_KEY.format('dba_name')} AS trade, {_KEY.format('business_owner_name')} AS holder, "
        "concat_ws(' ', nullif(address_no, ''), nullif(address_pd, ''), nullif(address_road, ''), nullif(address_sfx, '')) AS full_address FROM d)",
    )
)
def register_city_certificates(spark, sf_dir):
    """CLS-05."""
    return r.city_certificates(records(spark, sf_dir, CITY), AS_OF).select("id", "kind", "reason", "full_address", "segment")


@query(
    _verdicts(
        MULTIFAMILY,
        f"""WHEN upper(STD_ST) <> 'CA' THEN 'out_of_area: state' WHEN TOTAL_UNIT_COUNT <> '' AND units IS NULL THEN 'unverifiable: units' WHEN coalesce(units, 0) < 5 THEN 'residential: too few units'
        WHEN {_says('PROPERTY_CATEGORY_NAME', *r.NOT_INSTITUTIONAL)} THEN 'residential: category'
        WHEN lower(STD_CITY) NOT IN ('chula vista', 'la mesa') AND NOT coalesce(try_cast(zip AS INT) BETWEEN 91901 AND 91987 OR try_cast(zip AS INT) BETWEEN 92003 AND 92199, false) THEN 'out_of_area: city and zip'
        WHEN STD_ADDR = '' OR STD_CITY = '' OR NOT regexp_full_match(zip, '[0-9]{{5}}') THEN 'unverifiable: address'
        WHEN {_says('STD_ADDR', *r.ONE_DWELLING)} THEN 'residential: one dwelling' WHEN PROPERTY_ID = '' THEN 'unverifiable: no id'
        WHEN NOT {_says('PROPERTY_NAME_TEXT', r.ENTITY_WORDS)} THEN 'personal: not an organization'""",
        steps="v AS (SELECT *, try_cast(TOTAL_UNIT_COUNT AS DOUBLE) AS units, STD_ZIP5[1:5] AS zip FROM d)",
    )
)
def register_multifamily(spark, sf_dir):
    """CLS-06, CLS-10."""
    return r.multifamily(records(spark, sf_dir, MULTIFAMILY), CITIES).select("id", "kind", "reason")


@query(
    _verdicts(
        SCHOOLS,
        f"""WHEN lower(County) <> 'san diego' THEN 'out_of_area: county' WHEN lower(StatusType) <> 'active' THEN 'inactive: status'
        WHEN lower(School) IN ('', 'no data', 'no school', 'n/a', 'na', 'none') THEN 'unverifiable: not a school'
        WHEN {' OR '.join(_says(c, *r.HOME_BASED) for c in ('School', 'SOCType', 'DOCType', 'EILName', 'Street'))} THEN 'residential: home-based'
        WHEN lower(Virtual) IN ('y', 'yes') THEN 'unverifiable: virtual'
        WHEN Street = '' OR City = '' OR NOT regexp_full_match(Zip[1:5], '[0-9]{{5}}') THEN 'unverifiable: address'
        WHEN {_says('Street', *r.ONE_DWELLING)} THEN 'residential: one dwelling' WHEN CDSCode = '' THEN 'unverifiable: no code'
        WHEN NOT {_says('School', r.ENTITY_WORDS, r.SCHOOL_WORDS)} THEN 'personal: not an institution'""",
    )
)
def register_schools(spark, sf_dir):
    """CLS-07."""
    return r.schools(records(spark, sf_dir, SCHOOLS)).select("id", "kind", "reason")


_HOLDER = _bare("APPROVAL_PERMIT_HOLDER")


@query(
    _verdicts(
        PERMITS,
        f"""WHEN APPROVAL_STATUS <> 'Issued' THEN 'inactive: status' WHEN issued IS NULL THEN 'unverifiable: issue date'
        WHEN issued_days_ago > 90 THEN 'stale: too old' WHEN issued_days_ago < 0 THEN 'unverifiable: in the future' WHEN APPROVAL_ID = '' THEN 'unverifiable: no id'
        WHEN JOB_BC_CODE_DESCRIPTION = '' THEN 'unverifiable: no class' WHEN JOB_BC_CODE_DESCRIPTION IN ({', '.join(map(_text, AMBIGUOUS_CLASSES))}) THEN 'mixed_use_ambiguous: class'
        WHEN {_says('JOB_BC_CODE_DESCRIPTION', *r.SIGNS)} OR {_says('APPROVAL_TYPE', *r.SIGNS)} THEN 'not_relevant: a sign'
        WHEN JOB_BC_CODE_DESCRIPTION NOT IN ({', '.join(map(_text, COMMERCIAL_CLASSES))}) THEN 'not_commercial: class'
        WHEN {' OR '.join(_says(c, *r.PERMIT_HOME) for c in ('JOB_BC_CODE_DESCRIPTION', 'APPROVAL_SCOPE', 'PROJECT_SCOPE', 'PROJECT_TITLE', 'PROJECT_TYPE', 'APPROVAL_TYPE'))} THEN 'residential: scope'
        WHEN GIS_ADDRESS = '' THEN 'unverifiable: no address' WHEN contains(lower(GIS_ADDRESS), '[pending]') THEN 'unverifiable: address pending'
        WHEN {_says('GIS_ADDRESS', *r.ONE_DWELLING)} THEN 'residential: one dwelling' WHEN holder_tier IS NULL THEN 'personal: holder'""",
        ", issued_days_ago, holder_tier",
        "u AS (SELECT *, try_cast(CASE WHEN regexp_full_match(APPROVAL_ISSUE_DATE[1:10], '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN APPROVAL_ISSUE_DATE[1:10] END AS DATE) AS issued FROM d), "
        f"v AS (SELECT *, CAST(date_diff('day', issued, DATE '{AS_OF}') AS INT) AS issued_days_ago, CASE WHEN {_HOLDER} = '' OR {_mixed(_HOLDER, r.ACTIVITY_WORDS)} OR {_person(_HOLDER, r.ACTIVITY_WORDS)} THEN NULL "
        f"WHEN {_says(_HOLDER, r.LEGAL_SUFFIX)} THEN 1 WHEN {_says(_HOLDER, r.ACTIVITY_WORDS)} THEN 2 END AS holder_tier FROM u)",
    )
)
def register_building_permits(spark, sf_dir):
    """CLS-08, CLS-11."""
    return r.building_permits(records(spark, sf_dir, PERMITS), AS_OF, COMMERCIAL_CLASSES, AMBIGUOUS_CLASSES).select("id", "kind", "reason", "issued_days_ago", "holder_tier")


_TRADE, _OWNER = _bare('"DBA Name"'), _bare('"Primary Name"')
_MARKS = (r.ACTIVITY_WORDS, r.ENTITY_WORDS)


@query(
    _verdicts(
        LICENSES,
        f"""WHEN upper("Prem County") <> 'SAN DIEGO' THEN 'out_of_area: county' WHEN upper("Prem State") <> 'CA' THEN 'out_of_area: state' WHEN upper("Type Status") <> 'ACTIVE' THEN 'inactive: status'
        WHEN license_type NOT IN ({', '.join(map(_text, LICENSE_TYPES))}) THEN 'not_relevant: type' WHEN "File Number" = '' THEN 'unverifiable: no file number'
        WHEN street = '' OR "Prem City" = '' OR NOT regexp_full_match("Prem Zip"[1:5], '[0-9]{{5}}') THEN 'unverifiable: address'
        WHEN {_says('street', *r.NOT_A_PREMISE)} THEN 'unverifiable: not a premise' WHEN {_says('street', *r.LICENSE_HOME)} THEN 'residential: a dwelling' WHEN business_name IS NULL THEN 'personal: name'""",
        ", license_type, business_name",
        """v AS (SELECT *, CASE WHEN len("License Type") < 2 THEN lpad("License Type", 2, '0') ELSE "License Type" END AS license_type, trim("Prem Addr 1" || ' ' || "Prem Addr 2") AS street, """
        f"CASE WHEN {_TRADE} <> '' AND NOT {_person(_TRADE, *_MARKS)} THEN {_TRADE} "
        f"WHEN {_OWNER} <> '' AND NOT {_mixed(_OWNER, *_MARKS)} AND NOT {_person(_OWNER, *_MARKS)} AND {_says(_OWNER, r.ENTITY_WORDS)} THEN {_OWNER} END AS business_name FROM d)",
    )
)
def register_licenses(spark, sf_dir):
    """CLS-09, CLS-12."""
    return r.active_licenses(records(spark, sf_dir, LICENSES), LICENSE_TYPES).select("id", "kind", "reason", "license_type", "business_name")
