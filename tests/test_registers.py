"""One row or more per rule of every register, and conservation of rows."""

from leadloom.operators import registers
from leadloom.plans.chain import tally


def run(spark, f, good, cases, **kw):
    """good with each case's changes gives that case's kind."""
    rows = [{**good, **change} for _, change in cases]
    df = spark.createDataFrame([tuple(r.get(k) for k in good) for r in rows], ", ".join(f"`{k}` string" for k in good))
    got = [r["kind"] for r in f(df.coalesce(1), **kw).collect()]
    assert got == [k for k, _ in cases]
    assert sum(r["n"] for r in tally(f(df, **kw)).collect()) == len(cases)


def test_food_permits(spark):
    good = {"record_id": "1", "record_name": "Ola Grill", "permit_status": "Issued", "active_permit": "a", "business_type": "Restaurant", "address": "1 Main St", "zip": "92101-1"}
    run(spark, registers.food_permits, good, [(None, {}), ("invalid", dict.fromkeys(good)), (None, {"record_id": None}), ("residential", {"business_type": "Microenterprise Home Kitchen"}), ("inactive", {"permit_status": "expired"}), ("inactive", {"active_permit": "B"}), ("unverifiable", {"zip": "9210"}), ("unverifiable", {"record_name": "Vega, Luz"}), (None, {"record_name": "Vega, Luz Inc"})])


def test_city_certificates(spark):
    good = dict(account_key="1", account_status="Active", date_cert_expiration="2026-01-01", date_cert_effective="2020-01-01", business_owner_name="Vega, Luz", ownership_type="llc", dba_name="Ola Dental", naics_code="621210", address_no="10", address_pd="", address_road="Main", address_sfx="St", address_city="San Diego", address_zip="92101")
    cases = [
        (None, {}), ("inactive", {"account_status": "Closed"}), ("unverifiable", {"date_cert_expiration": "soon"}), ("inactive", {"date_cert_expiration": "2023-01-01"}), ("inactive", {"date_cert_effective": "2025-01-01"}),
        ("unverifiable", {"ownership_type": None}), ("personal", {"ownership_type": "SOLE"}), ("unverifiable", {"ownership_type": "XX"}), ("unverifiable", {"dba_name": " "}), ("personal", {"dba_name": "Luz Vega"}), ("unverifiable", {"naics_code": ""}),
        ("residential", {"naics_code": "624410"}), ("unverifiable", {"naics_code": "111110"}), ("unverifiable", {"address_no": None}), ("unverifiable", {"address_city": "Austin"}), ("residential", {"address_sfx": "St Apt 4"}), ("residential", {"dba_name": "Ola PMB 12"}),
    ]
    run(spark, registers.city_certificates, good, cases, as_of="2024-01-31")
    assert "business_owner_name" not in registers.city_certificates(spark.createDataFrame([("x",)], "business_owner_name string"), "2024-01-31").columns


def test_multifamily(spark):
    good = dict(PROPERTY_ID="7", PROPERTY_NAME_TEXT="Palm Villas", TOTAL_UNIT_COUNT="40", PROPERTY_CATEGORY_NAME="Insured", STD_ADDR="1 Palm Ave", STD_CITY="Chula Vista", STD_ST="CA", STD_ZIP5="91910")
    cases = [
        (None, {}), ("out_of_area", {"STD_ST": "NV"}), ("unverifiable", {"TOTAL_UNIT_COUNT": "many"}), ("residential", {"TOTAL_UNIT_COUNT": "4"}), ("residential", {"TOTAL_UNIT_COUNT": None}), ("residential", {"PROPERTY_CATEGORY_NAME": "Single Family"}), ("out_of_area", {"STD_CITY": "Elsewhere", "STD_ZIP5": "90001"}),
        (None, {"STD_CITY": "Elsewhere", "STD_ZIP5": "91910"}), ("unverifiable", {"STD_ADDR": None}), ("residential", {"STD_ADDR": "1 Palm Ave Unit 3"}), ("unverifiable", {"PROPERTY_ID": ""}), ("personal", {"PROPERTY_NAME_TEXT": "Vega, Luz"}),
    ]
    run(spark, registers.multifamily, good, cases, cities=["Chula Vista"])


def test_schools(spark):
    good = dict(CDSCode="37", StatusType="Active", County="San Diego", School="Ola Elementary", Street="1 Elm", City="San Diego", Zip="92101", DOCType="", SOCType="", EILName="", Virtual="N")
    cases = [
        (None, {}), ("out_of_area", {"County": "Kern"}), ("inactive", {"StatusType": "Closed"}), ("unverifiable", {"School": "No Data"}), ("unverifiable", {"School": None}), ("residential", {"SOCType": "Family Child Care Home"}), ("unverifiable", {"Virtual": "Y"}),
        ("unverifiable", {"Zip": "x"}), ("residential", {"Street": "1 Elm Apt B"}), ("unverifiable", {"CDSCode": None}), ("personal", {"School": "Luz Vega"}),
    ]
    run(spark, registers.schools, good, cases)


def test_building_permits(spark):
    good = dict(APPROVAL_ID="A1", APPROVAL_TYPE="Building", APPROVAL_STATUS="Issued", APPROVAL_SCOPE="tenant work", APPROVAL_ISSUE_DATE="2024-01-10T00:00", APPROVAL_PERMIT_HOLDER="Ola Builders, Inc.", JOB_BC_CODE_DESCRIPTION="Office", GIS_ADDRESS="1 B St", PROJECT_TYPE="", PROJECT_TITLE="", PROJECT_SCOPE="")
    cases = [
        (None, {}), ("inactive", {"APPROVAL_STATUS": "issued"}), ("unverifiable", {"APPROVAL_ISSUE_DATE": "2024-02-30"}), ("stale", {"APPROVAL_ISSUE_DATE": "2023-10-01"}), ("unverifiable", {"APPROVAL_ISSUE_DATE": "2024-02-01"}), ("unverifiable", {"APPROVAL_ID": ""}),
        ("unverifiable", {"JOB_BC_CODE_DESCRIPTION": None}), ("mixed_use_ambiguous", {"JOB_BC_CODE_DESCRIPTION": "Mixed"}), ("not_relevant", {"APPROVAL_TYPE": "Sign - Permanent"}), ("not_commercial", {"JOB_BC_CODE_DESCRIPTION": "Garage"}), ("residential", {"PROJECT_TITLE": "New ADU"}),
        ("unverifiable", {"GIS_ADDRESS": ""}), ("unverifiable", {"GIS_ADDRESS": "1 B St [Pending]"}), ("residential", {"GIS_ADDRESS": "1 B St#4"}), ("personal", {"APPROVAL_PERMIT_HOLDER": "Luz Vega"}), ("personal", {"APPROVAL_PERMIT_HOLDER": "Luz Vega - Ola Builders Inc"}), (None, {"APPROVAL_PERMIT_HOLDER": "Coastal Plumbing"}), (None, {"GIS_ADDRESS": "1 B St #4"}), (None, {"APPROVAL_PERMIT_HOLDER": "Luz Vega & Ola LLC"}), ("personal", {"APPROVAL_PERMIT_HOLDER": "Luz Vega&Ola LLC"}),
    ]
    run(spark, registers.building_permits, good, cases, as_of="2024-01-31", commercial=["Office"], ambiguous=["Mixed"])


def test_active_licenses(spark):
    good = {"License Type": "41", "File Number": "9", "Type Status": "active", "Primary Name": "VEGA, LUZ", "DBA Name": "Ola Restaurant", "Prem Addr 1": "1 B St", "Prem Addr 2": "", "Prem City": "San Diego", "Prem State": "CA", "Prem Zip": "92101", "Prem County": "San Diego"}
    cases = [
        (None, {}), ("out_of_area", {"Prem County": "KERN"}), ("out_of_area", {"Prem State": "NV"}), ("inactive", {"Type Status": "SUREND"}), ("not_relevant", {"License Type": "99"}), (None, {"License Type": "7"}), ("unverifiable", {"File Number": None}), ("unverifiable", {"Prem Zip": ""}),
        ("unverifiable", {"Prem Addr 1": "PO Box 7"}), ("residential", {"Prem Addr 2": "Apt 4"}), ("residential", {"Prem Addr 2": "Apartment 12B"}), ("personal", {"DBA Name": "Luz Vega", "Primary Name": "Vega, Luz"}), (None, {"DBA Name": "Luz Vega", "Primary Name": "Ola Holdings LLC"}), ("personal", {"DBA Name": "", "Primary Name": "Luz Vega / Ola LLC"}),
    ]
    run(spark, registers.active_licenses, good, cases, types=["41", "07"])


def test_the_queries_meet_every_rule(spark, sf_dir):
    from leadloom.plans.registers import QUERIES

    reasons = {"register_food_permits": 4, "register_city_certificates": 15, "register_multifamily": 9, "register_schools": 9, "register_building_permits": 14, "register_licenses": 9}
    for name, n in reasons.items():
        kinds = QUERIES[name](spark, sf_dir).groupBy("kind", "reason").count().collect()
        assert len({(r["kind"], r["reason"]) for r in kinds if r["kind"]}) == n and any(r["kind"] is None for r in kinds), name
