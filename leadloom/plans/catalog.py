"""Catalogs that drive rules and prices: fixed values, and parameters of the operators that use them."""

from __future__ import annotations

# Prices in whole dollars and factors.
RESIDENTIAL_TYPE = {"standard": 1.0, "deep": 1.55, "move": 1.75, "post_construction": 2.1}
RESIDENTIAL_FREQUENCY = {"one_time": 1.0, "monthly": 0.9, "biweekly": 0.85, "weekly": 0.8}
RESIDENTIAL_ADDONS = {"fridge": 35, "oven": 35, "windows_interior": 65, "laundry": 25, "garage": 55, "cabinets": 45, "patio": 40}
COMMERCIAL_TYPE = {"office": 1.0, "retail": 1.05, "medical": 1.35, "restaurant": 1.4, "post_construction": 1.8}
COMMERCIAL_FREQUENCY = {"one_time": 1.0, "monthly": 0.95, "biweekly": 0.9, "weekly": 0.82, "daily": 0.7}
COMMERCIAL_ADDONS = {"windows_exterior": 120, "carpet_shampoo": 180, "floor_wax": 250, "disinfection": 95}
VISITS_PER_MONTH = {"weekly": 4.33, "biweekly": 2.17, "monthly": 1.0, "daily": 21.7, "one_time": 0.0}

# Segments of prospects in priority order: weight, keywords, industry codes, and the job that prices them.
SEGMENTS = {
    "property_manager": (
        30,
        ["property management", "property manager", "realty", "real estate", "apartments", "leasing", "rentals", "inmobiliaria", "administracion de propiedades"],
        ["531110", "531210", "531311", "531312", "531390"],
    ),
    "office_clinic": (
        26,
        ["dental", "dentist", "clinic", "medical", "physician", "chiropractic", "law office", "attorney", "accounting", "insurance agency", "consultorio", "clinica", "despacho"],
        ["621210", "621111", "621310", "541110", "541211", "524210", "541613"],
    ),
    "restaurant_retail": (
        22,
        ["restaurant", "cafe", "coffee", "bakery", "bar", "grill", "taqueria", "pizzeria", "retail", "boutique", "store", "market", "salon", "barber", "gym", "fitness"],
        ["722511", "722513", "722515", "311811", "445110", "448140", "812112", "713940"],
    ),
    "str_host": (
        20,
        ["short term rental", "vacation rental", "airbnb", "str", "guest house", "hospitality", "renta corta", "alquiler vacacional"],
        ["721199", "721110", "531110"],
    ),
    "post_construction": (
        24,
        ["construction", "contractor", "builder", "remodel", "renovation", "general contractor", "constructora", "remodelacion"],
        ["236118", "236220", "238210", "238350"],
    ),
}
#: Segment, service type, frequency, bedrooms, bathrooms, sqft of the job that prices a prospect.
SEGMENT_JOBS = {
    "property_manager": ("residential", "move", "weekly", 2, 1, None),
    "office_clinic": ("commercial", "office", "weekly", None, None, 4000),
    "restaurant_retail": ("commercial", "restaurant", "daily", None, None, 2500),
    "str_host": ("residential", "standard", "weekly", 2, 1, None),
    "post_construction": ("commercial", "post_construction", "one_time", None, None, 3000),
}

# Steps of each sequence with delays in minutes.
SEQUENCES = {
    "residential": [("quote", 0), ("follow_2h", 120), ("day_1", 1440), ("day_3", 4320), ("day_7", 10080), ("day_14", 20160), ("reactivation", 64800)],
    "commercial": [("quote", 0), ("follow_20h", 1200), ("day_4", 5760), ("day_8", 11520), ("day_15", 21600), ("reactivation", 64800)],
    "outbound": [("intro", 0), ("bump", 5760), ("proof", 12960), ("close", 23040)],
}
STOP_STATUSES = ["won", "lost", "booked", "customer", "spam"]

# Mail domains.
DISPOSABLE = ["mailinator.com", "yopmail.com", "tempmail.com", "guerrillamail.com", "sharklasers.com", "10minutemail.com", "trashmail.com"]
FREE_MAIL = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "live.com", "msn.com", "proton.me", "protonmail.com"]
FREE_MAIL_NAMES = ["gmail", "yahoo", "hotmail", "outlook", "aol", "icloud", "live", "msn"]
PAID_MEDIA = ["cpc", "ppc", "paid", "paid_social"]

# Industry sectors by two digits, the segment of each, and codes that are left out.
SECTOR_SEGMENT = {23: "post_construction", 42: "retail", 44: "retail", 45: "retail", 53: "property_managers", 54: "offices", 55: "offices", 56: "offices", 62: "offices", 71: "offices", 72: "restaurants", 81: "offices"}
EXCLUDED_CODES = ["814110", "624410", "812990", "711510", "531110", "531210", "812112", "812113"]
ENTITY_FORMS = ["CORP", "LLC", "SCORP", "LP", "NO", "PRF"]
PERSONAL_FORMS = ["SOLE", "H-W", "HW", "TRUST", "IND", "INDIVIDUAL"]
COUNTY_ZIP_RANGES = [(91901, 91987), (92003, 92199)]

# License types that have a rating.
LICENSE_RATING = {4: ["41", "47", "75", "42", "48", "61"], 3: ["50", "51", "52", "57", "70", "90"], 2: ["20", "21", "49", "59", "60"]}

# Signals of inbound messages in priority order; a signal is bounded by non-word characters.
INBOUND_SIGNALS = [
    ("opt_out", ["unsubscribe", "remove me", "opt[- ]?out", "no me (?:escriban|contacten)", "dar de baja"]),
    ("negative", ["not interested", "no thanks", "we (?:already )?have a (?:vendor|cleaner|service)", "no (?:nos )?interesa"]),
    ("quote_request", ["quote", "estimate", "pricing", "how much", "presupuesto", "cotiza(?:r|ción)", "walk[- ]?through", "site visit"]),
    ("service_question", ["do you (?:offer|clean|service)", "availability", "schedule", "horario", "(?:ofrecen|hacen|cubren)", "what (?:services|areas)"]),
    ("administrative", ["invoice", "w-?9", "certificate of insurance", "factura", "contrato", "purchase order"]),
]

#: Categories of messages for which an answer is drafted, and why none is for the others.
DRAFTS = {"quote_request": "about your request for a quote", "service_question": "about our services", "administrative": "about your administrative request"}
NO_DRAFT = {"opt_out": "respected, not answered", "negative": "not argued with", "unrelated": "a person reads it"}

# Words that are not part of a name, for the two name keys.
STOP_WORDS_A = ["inc", "llc", "corp", "co", "ltd", "the", "a", "and", "de", "del", "la", "el"]
STOP_WORDS_B = ["inc", "llc", "corp", "corporation", "company", "co", "ltd", "lp", "the", "and", "de", "del", "la", "el", "dba"]

#: Sources in the order in which they claim an entity that several of them have.
SOURCE_PRIORITY = ["schools", "licenses", "permits", "multifamily"]
WARMUP_START, WARMUP_STEP, DAILY_LIMIT, COOLDOWN_DAYS, HITS_PER_HOUR = 10, 5, 40, 90, 8
HOT, WARM = 68, 42
