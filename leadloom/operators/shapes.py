"""Bodies of deliveries: one canonical lead as the records that eight kinds of systems take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from .records import blank

#: Columns of a canonical lead; all but the numbers are text, and any may be null.
CANONICAL = ["id", "channel", "company", "name", "email", "phone", "website", "city", "zip", "address", "annual", "quote", "segment", "temperature", "source", "description"]


def _first(name: Column) -> Column:
    return F.split_part(F.trim(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit(1))


def _rest(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"^\S*\s*", ""))


def _object(given: dict[str, Column], kept: dict[str, Column] | None = None, order: list[str] | None = None) -> Column:
    """An object whose `given` fields are left out where they are blank, and whose `kept` ones are blank text there."""
    fields = {k: F.when(~blank(v.cast("string")), v) for k, v in given.items()}
    fields |= {k: F.coalesce(v, F.lit("")) for k, v in (kept or {}).items()}
    return F.struct(*[fields[k].alias(k) for k in (order or fields)])


def bodies(leads: DataFrame) -> dict[str, Column]:
    """A body per kind of system, as structs whose null fields are left out; see delivered() for their texts."""
    c = {k: F.col(k) for k in CANONICAL}
    first, rest = _first(c["name"]), _rest(c["name"])
    last = F.when(rest != "", rest).when(~blank(c["company"]), c["company"]).otherwise("Lead")
    cold = c["channel"] == "outbound"
    origin = F.when(cold, "Cold Call").otherwise("Web Site")
    amount = F.when(c["annual"] > 0, c["annual"]).when(c["quote"] > 0, c["quote"])
    named = F.when(~blank(c["name"]), c["name"]).when(~blank(c["company"]), c["company"])
    tags = F.filter(F.array(c["channel"], c["segment"], c["temperature"]), lambda t: F.coalesce(t, F.lit("")) != "")
    # Names of the fields that each kind of system takes.
    rest_lead = _object(
        {"firstName": first, "lastName": last, "accountName": c["company"], "emailAddress": c["email"], "phoneNumber": c["phone"], "website": c["website"], "addressCity": c["city"], "addressPostalCode": c["zip"], "addressStreet": c["address"], "source": origin, "status": F.lit("New"), "opportunityAmount": amount, "opportunityAmountCurrency": F.lit("USD"), "description": c["description"]}
    )
    attributes = _object(
        {"email1": c["email"]},
        {"first_name": first, "last_name": last, "account_name": c["company"], "phone_work": c["phone"], "website": c["website"], "primary_address_city": c["city"], "primary_address_postalcode": c["zip"], "primary_address_street": c["address"], "lead_source": origin, "status": F.lit("New"), "description": c["description"]},
        ["first_name", "last_name", "account_name", "email1", "phone_work", "website", "primary_address_city", "primary_address_postalcode", "primary_address_street", "lead_source", "status", "description"],
    )
    flat = _object(
        {"email": c["email"], "source": F.when(cold, 2).otherwise(1), "status": F.lit(1)},
        {"name": F.coalesce(named, F.lit("Lead")), "company": c["company"], "phonenumber": c["phone"], "website": c["website"], "city": c["city"], "zip": c["zip"], "address": c["address"], "description": c["description"]},
        ["name", "company", "email", "phonenumber", "website", "city", "zip", "address", "source", "status", "description"],
    )
    element = _object(
        {"email": c["email"]},
        {"lastname": last, "firstname": first, "company": F.when(~blank(c["company"]), c["company"]).otherwise(F.coalesce(named, F.lit("Lead"))), "phone": c["phone"], "website": c["website"], "city": c["city"], "code": c["zip"], "leadsource": origin, "description": c["description"]},
        ["lastname", "firstname", "company", "email", "phone", "website", "city", "code", "leadsource", "description"],
    )
    properties = _object(
        {"email": c["email"], "firstname": first, "lastname": rest, "phone": c["phone"], "company": c["company"], "website": c["website"], "zip": c["zip"], "city": c["city"], "hs_lead_status": F.lit("NEW"), "lifecyclestage": F.lit("lead")}
    )
    contact = _object({"email": c["email"], "phone": c["phone"], "name": named, "companyName": c["company"], "website": c["website"], "postalCode": c["zip"], "city": c["city"], "source": c["source"]})
    upsert = _object({"dedupKey": c["id"].cast("string"), "businessName": F.coalesce(F.when(~blank(c["company"]), c["company"]), c["name"]), "website": c["website"], "source": c["source"], "email": c["email"], "phone": c["phone"], "contactName": c["name"], "address": c["address"], "city": c["city"], "zip": c["zip"], "channel": c["channel"], "estAnnualValue": c["annual"], "estVisitValue": c["quote"]})
    whole = F.struct(*[c[k] for k in CANONICAL])
    return {
        "webhook": whole,
        "rest_lead": rest_lead,
        "json_api_lead": F.struct(F.struct(F.lit("Leads").alias("type"), attributes.alias("attributes")).alias("data")),
        "flat_lead": flat,
        "element_lead": element,
        "property_contact": F.struct(properties.alias("properties")),
        "tagged_contact": F.struct(*[contact[f].alias(f) for f in ("email", "phone", "name", "companyName", "website", "postalCode", "city", "source")], tags.alias("tags")),
        "company_upsert": upsert,
    }


def delivered(leads: DataFrame, secret: str | None = None) -> DataFrame:
    """(id, shape, body, signature): every lead in every shape as JSON; webhooks are signed if there is a secret.

    Leads are read once: a row becomes eight by an array, without a join.
    """
    made = F.array(*[F.struct(F.lit(k).alias("shape"), F.to_json(v).alias("body")) for k, v in bodies(leads).items()])
    out = leads.select("id", F.inline(made))
    sign = F.lit(None).cast("string") if not secret else F.when(F.col("shape") == "webhook", F.concat(F.lit("sha256="), crypto.hmac_hex(F.when(F.col("shape") == "webhook", F.col("body")), secret)))
    return out.withColumn("signature", sign)
