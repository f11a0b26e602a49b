"""What the checking SQL expects, written out: nothing here is read from the engine.

All of it is fixed values: columns, codes, phrases, check names and declared tests.
"""

# Landing columns, their lengths, and those that must be filled.
LANDING = {
    "student_id": 20, "u_g": 1, "gender": 10, "school": 2, "degtype": 10, "firstgen": 1, "pell": 1,
    "ethnicmultirace": 5, "citizen": 2, "creditenr": 5, "year_field": 4, "semester": 10, "academic_state": 30,
    "regstat": 2, "accumgpa": 10, "term_code": 6,
}
FILLED = ("student_id", "u_g", "school", "term_code")

# Code lists.
SCHOOLS = {
    "AD": "Hillier College of Architecture and Design (HCAD)",
    "CC": "Ying Wu College of Computing (YWCC)",
    "EN": "Newark College of Engineering (NCE)",
    "SL": "College of Science and Liberal Arts (CSLA)",
    "SM": "Martin Tuchman School of Management (MTSM)",
}
CITIZENSHIP = {
    1: "US Citizen",
    2: "International",
    3: "US Permanent Resident",
    4: "Information Not Available",
}
REGISTRATION = {
    1: "First-time",
    2: "Transfer",
    3: "Stop-out / Readmit",
    4: "Continuing",
}
ETHNICITY = {
    1: "Native American-Alaskan Native",
    2: "Aboriginal",
    3: "Central African (Congo, Kenya, Uganda, etc.)",
    4: "Southern African (Namibia, Madagascar, etc.)",
    5: "Northern African (Morocco, Algeria, etc.)",
    6: "African American/Black",
    7: "Caribbean (Haiti, Dominican Republic, etc.)",
    8: "Central American (Nicaragua, Guatemala, etc.)",
    9: "Cuban",
    10: "Latino",
    11: "Hispanic",
    12: "Mexican",
    13: "Puerto Rican",
    14: "South American (Brazil, Venezuela, Argentina, etc.)",
    15: "Central Asian (Afghanistan, Kazakhstan, etc.)",
    16: "Southeast Asian (Indonesia, Thailand, Vietnam, etc.)",
    17: "South Asian (India, Pakistan, Bangladesh, etc.)",
    18: "East Asian (China, Japan, Korea, Philippines, etc.)",
    19: "Pacific-Islander (Fiji, Tahiti, Hawaii, etc.)",
    20: "Asian American",
    21: "Iberian-European (Spanish-Portuguese)",
    22: "Eastern European (Ukraine, Poland, Albania, etc.)",
    23: "Indo-European (Turkey, Azerbaijan, etc.)",
    24: "European (Italy, Sweden, Germany, etc.)",
    25: "Middle Eastern (Israel, Jordan, Lebanon, etc.)",
    26: "White American",
    27: "Australian/New Zealander",
}

# The gate's checks, in order.
CHECKS = (
    "staged file has rows",
    "no nulls in key columns",
    "term_code valid format",
    "no duplicate rows at (student_id, u_g, degtype, term_code) grain",
    "u_g in (U, G, D)",
    "school in (AD, CC, EN, SL, SM)",
    "pell in (Y, N, '') -- blank is a known data state, decoded to Unknown in STG",
    "regstat in (1, 2, 3, 4)",
    "academic_state in (Enrolled, Graduated, Maintaining Registration)",
)

# Phrases that point at the data, and at a document.
DATA = (
    "graduation rate", "retention rate", "attrition", "enrollment", "how many students", "number of students",
    "pell", "cohort", "school", "college", "engineering", "computing", "management", "undergrad", "graduate",
    "master", "doctoral", "phd", "semester", "term", "fall", "spring", "2015", "2016", "2017", "2018", "2019",
    "2020", "2021", "2022", "2023", "2024", "gpa", "credits", "full-time", "part-time", "firstgen",
    "first generation", "first-gen", "female", "male", "gender", "degree", "completed", "dropped", "trend",
    "average", "percentage", "rate", "count", "total", "compare", "which school", "highest", "lowest", "arr",
    "adjusted retention", "dropout", "at risk", "risk score", "prediction", "stop out", "stopout", "readmit",
    "continuing students", "prior students", "pell gap", "equity gap", "term over term", "term-over-term",
    "cohort year", "matured cohort", "two year", "2-year", "one year", "1-year", "plot", "chart", "graph",
    "visualize", "visualise", "u_g", "degtype",
)
DOCUMENT = (
    "what does the brief say", "according to the report", "in the document", "what is the assignment",
    "explain the methodology", "round 1", "the pdf", "the report", "assumption", "formula defined", "the file",
    "the document", "this scenario", "the scenario", "uploaded", "summarize", "summarise", "the upload",
    "mentioned in", "described in", "in the pdf", "in the file",
)

# Wording of relative time and of charts.
LAST_YEAR = r"\b(last|past)\s+year\b"
THIS_YEAR = r"\b(this|current)\s+year\b"
LAST_TERM = r"\b(last|previous)\s+(semester|term)\b"
THIS_TERM = r"\b(this|current)\s+(semester|term)\b"
PAST_YEARS = r"\bpast\s+(\d+)\s+years?\b"
RECENT = r"\brecent(ly)?\b"
CHART_VERB = r"\b(plot|chart|graph|visuali[sz]e)\b"
CHART_TREND = (
    r"\btrend(s)?\b.*\b(over time|by year|by term|by semester|by cohort)\b"
    r"|\b(over time|by year|by term|by semester|by cohort)\b.*\btrend(s)?\b"
)
NOT_A_CHART = (
    r"\bdata lineage\b|\bdependency graph\b|\bgraph database\b|\bknowledge graph\b"
    r"|\bwhat (is|does|are)\b.*\b(chart|graph)\b.*\b(mean|measure)\b"
)

# Fixed value: what stands between excerpts.
RULE = "\n\n---\n\n"

# The declared tests, as model, test, columns and values.
TESTS = (
    ("stg_student_enrollment", "not_null", ("student_id",), ()),
    ("stg_student_enrollment", "not_null", ("u_g",), ()),
    ("stg_student_enrollment", "accepted_values", ("u_g",), ("U", "G", "D")),
    ("stg_student_enrollment", "accepted_values", ("school",), ("AD", "CC", "EN", "SL", "SM")),
    ("stg_student_enrollment", "not_null", ("term_code",), ()),
    ("stg_student_enrollment", "accepted_values", ("pell",), ("Y", "N", "Unknown")),
    ("stg_student_enrollment", "accepted_values", ("firstgen",), ("Y", "N", "Unknown")),
    ("stg_student_enrollment", "accepted_values", ("academic_state",), ("Enrolled", "Graduated", "Maintaining Registration")),
    ("stg_student_enrollment", "unique_combination", ("student_id", "u_g", "degtype", "term_code"), ()),
    ("stg_term_calendar", "not_null", ("current_term",), ()),
    ("stg_term_calendar", "unique", ("current_term",), ()),
    ("stg_term_calendar", "not_null", ("next_major_term",), ()),
    ("int_program_episodes", "not_null", ("program_episode_id",), ()),
    ("int_program_episodes", "unique", ("program_episode_id",), ()),
    ("int_program_episodes", "not_null", ("student_id",), ()),
    ("int_program_episodes", "not_null", ("cohort_term",), ()),
    ("int_program_episodes", "accepted_values", ("is_first_time_cohort",), (0, 1)),
    ("int_program_episodes", "accepted_values", ("graduated_flag",), (0, 1)),
    ("int_program_episodes", "accepted_values", ("retained_one_year",), (0, 1)),
    ("int_program_episodes", "accepted_values", ("retained_two_year",), (0, 1)),
    ("int_program_episodes", "unique_combination", ("student_id", "u_g", "degtype"), ()),
    ("fct_graduation_rate_term", "not_null", ("current_term",), ()),
    ("fct_graduation_rate_term", "accepted_range", ("term_graduation_rate_pct",), (0, 100)),
    ("fct_graduation_rate_term", "unique_combination", ("current_term", "degtype", "u_g", "gender", "school", "pell"), ()),
    ("fct_retention_rate_term", "not_null", ("current_term",), ()),
    ("fct_retention_rate_term", "accepted_range", ("adjusted_retention_rate",), (0, 100)),
    ("fct_retention_rate_term", "accepted_range", ("attrition_rate_pct",), (0, 100)),
    ("fct_retention_rate_term", "unique_combination", ("current_term", "degtype", "u_g", "school"), ()),
    ("dim_program_episode", "not_null", ("program_episode_id",), ()),
    ("dim_program_episode", "unique", ("program_episode_id",), ()),
    ("fct_enrollment_term", "not_null", ("student_id",), ()),
    ("fct_enrollment_term", "not_null", ("term_code",), ()),
    ("fct_enrollment_term", "accepted_values", ("u_g",), ("U", "G", "D")),
    ("fct_enrollment_term", "accepted_values", ("pell",), ("Y", "N", "Unknown")),
    ("fct_enrollment_term", "unique_combination", ("program_episode_id", "term_code"), ()),
    ("fct_retention_rate_cohort", "accepted_values", ("u_g",), ("U", "G", "D")),
    ("fct_retention_rate_cohort", "accepted_values", ("pell",), ("Y", "N", "Unknown")),
    ("fct_retention_rate_cohort", "accepted_range", ("first_year_retention_rate_pct",), (0, 100)),
    ("fct_retention_rate_cohort", "accepted_range", ("second_year_retention_rate_pct",), (0, 100)),
    ("fct_retention_rate_cohort", "unique_combination", ("degtype", "u_g", "gender", "school", "pell", "cohort_year"), ()),
    ("fct_graduation_rate", "accepted_values", ("u_g",), ("U", "G", "D")),
    ("fct_graduation_rate", "accepted_values", ("pell",), ("Y", "N", "Unknown")),
    ("fct_graduation_rate", "accepted_range", ("graduation_rate_pct",), (0, 100)),
    ("fct_graduation_rate", "unique_combination", ("degtype", "u_g", "gender", "school", "pell", "cohort_year"), ()),
    ("fct_graduation_rate", "expression_is_true", ("cohort_year",), (2,)),
)
