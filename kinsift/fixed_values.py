"""Code lists, labels, word lists and defaults that results depend on."""

# ---- null tokens -----------------------------------------------------------
LOAD_NULL_TOKENS = ["", "nan", "NaN", "NULL", "null", "N/A", "n/a", "NA"]
CLEAN_NULL_TOKENS = ["nan", "NAN", "None", "", "null", "NULL", "<NA>", "NA", "N/A", "n/a", " "]

# ---- code labels -----------------------------------------------------------
RACE_LABELS = {
    "A": "Asian",
    "B": "Black or African American",
    "I": "American Indian or Alaska Native",
    "M": "Two or More Races",
    "O": "Other",
    "P": "Native Hawaiian or Pacific Islander",
    "U": "Undesignated",
    "W": "White",
}
ETHNIC_LABELS = {
    "HL": "Hispanic or Latino",
    "NL": "Not Hispanic or Not Latino",
    "UN": "Undesignated",
}
PARTY_LABELS = {
    "DEM": "Democratic",
    "REP": "Republican",
    "UNA": "Unaffiliated",
    "LIB": "Libertarian",
    "GRE": "Green",
    "CST": "Constitution",
}
GENDER_LABELS = {"F": "Female", "M": "Male", "U": "Undesignated"}

CODE_LABELS = {
    "race_code": RACE_LABELS,
    "ethnic_code": ETHNIC_LABELS,
    "party_cd": PARTY_LABELS,
    "gender_code": GENDER_LABELS,
}

# ---- cohort filter fields --------------------------------------------------
COHORT_CATEGORICAL = ["race_code", "ethnic_code", "party_cd", "gender_code", "birth_state"]
COHORT_RANGES = ["birth_year", "age_at_year_end"]
COHORT_JSON_VERSION = 1

# ---- demographic fields: display name, and bin edges for numeric ones -------
DEMOGRAPHIC_NAMES = {
    "gender_code": "Gender",
    "race_code": "Race",
    "ethnic_code": "Ethnicity",
    "party_cd": "Registered Party",
    "birth_state": "Birth State",
    "birth_year": "Decade of Birth",
    "age_at_year_end": "Age Bracket",
    "gender": "Gender",
    "city": "City",
}
DECADE_EDGES = list(range(1900, 2031, 10))
AGE_EDGES = [0, 18, 25, 35, 45, 55, 65, 75, 85, 130]
AGE_NAMES = ["<18", "18-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75-84", "85+"]
BINNED_FIELDS = {
    "birth_year": (DECADE_EDGES, [f"{edge}s" for edge in DECADE_EDGES[:-1]]),
    "age_at_year_end": (AGE_EDGES, AGE_NAMES),
}

# ---- semantic types by column-name substring, first hit wins ----------------
TYPE_RULES = [
    ("first_name", ["first", "given"]),
    ("surname", ["last", "sur", "family"]),
    ("full_name", ["name"]),
    ("dob", ["date", "dob", "birth"]),
    ("email", ["email"]),
    ("postcode", ["post", "zip"]),
    ("gender", ["gender", "sex"]),
    ("location", ["city", "town", "county"]),
]
SUGGESTED_COMPARATOR = {
    "first_name": "JaroWinklerAtThresholds",
    "surname": "JaroAtThresholds",
    "dob": "DateOfBirthComparison",
    "email": "EmailComparison",
    "postcode": "PostcodeComparison",
}
SUGGESTED_BLOCKING_TYPES = ["first_name", "surname", "dob", "postcode", "location"]
SELECT_PRIORITY = {
    "first_name": 0, "surname": 1, "dob": 2, "postcode": 3, "email": 4,
    "location": 5, "gender": 6, "text": 7, "id": 99,
}
SELECTIVE_TYPES = ["first_name", "surname", "dob", "postcode", "email"]
SELECTIVE_COLUMNS = ["ncid", "voter_reg_num"]
BOOKKEEPING = ["unique_id", "source_dataset", "cluster"]
FIELD_COMPARATOR = {
    "first_name": "NameComparison",
    "surname": "NameComparison",
    "dob": "DateOfBirthComparison",
}
TRAINING_HINTS = ["first_name", "surname", "last_name", "dob", "birth_year", "city",
                  "res_city_desc", "email", "gender", "gender_code", "postcode", "zip_code"]

# ---- model and run defaults --------------------------------------------------
CLUSTER_THRESHOLD = 0.8
WEIGHT_THRESHOLD = -5.0
DETERMINISTIC_WEIGHT = 100.0
MAX_ITERATIONS = 25
EM_CONVERGENCE = 0.0001
RECALL = 0.6
U_SAMPLE_PAIRS = 100_000
PAIRS_WARNING = 500_000
PAIRS_DANGER = 5_000_000
PRIOR_FALLBACK = -10.0
UNLINKABLE_GRID = (-20.0, 20.0, 0.5)
AGREEMENT_SHARE = 0.85
EPSILON_STEPS = 100

# ---- noise values ------------------------------------------------------------
PLACE_SHORT_FORMS = {
    "New York": "NYC",
    "Los Angeles": "LA",
    "San Francisco": "SF",
    "Saint Louis": "St Louis",
    "Saint Paul": "St Paul",
    "Washington": "DC",
}
VALID_CODES = {
    "gender_code": ["M", "F", "U"],
    "race_code": ["A", "B", "I", "M", "O", "P", "U", "W"],
    "ethnic_code": ["HL", "NL", "UN"],
    "party_cd": ["DEM", "REP", "UNA", "LIB"],
}
DETECTED_GENDER = {
    "male": "M",
    "mostly_male": "M",
    "female": "F",
    "mostly_female": "F",
    "andy": "Unknown",
    "unknown": "Unknown",
}
GENDER_SHARES = [("M", 0.48), ("F", 0.48), ("Unknown", 0.04)]
UNKNOWN_CAP = 0.10
PRESET_RATES = {
    "first_name": 0.14,
    "surname": 0.09,
    "dob": 0.05,
    "email": 0.15,
    "city": 0.11,
    "gender": 0.07,
}
