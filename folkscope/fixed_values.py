"""Word lists, lookup tables and constants that results depend on."""

# Genres counted as mature content.
MATURE_GENRES = ["Action", "Crime", "Thriller", "Horror", "War"]

# Film records keep these twelve fields.
FILM_FIELDS = [
    "imdb_id",
    "original_title",
    "adult",
    "genres_name",
    "original_language",
    "popularity",
    "production_countries_name",
    "release_date",
    "budget",
    "revenue",
    "vote_average",
    "vote_count",
]

# Films count when released after this year; a country counts with more films than this.
LAST_EXCLUDED_YEAR = 2010
MIN_FILMS_EXCLUSIVE = 50

# A film is poor value above this budget and below this rating.
POOR_VALUE_BUDGET = 13_000_000
POOR_VALUE_RATING = 5.4

# Class threshold for predicted shares, residual band, influential rows shown.
CLASS_THRESHOLD = 0.2
RESIDUAL_BAND = 2.0
INFLUENTIAL_ROWS = 3

# Edges of the hand-made bins for culture scores, the last bin open to the right.
SCORE_BIN_EDGES = [0, 20, 40, 60, 80, 100, float("inf")]

# Answer levels in file order, with the short names used for wide columns.
IMPORTANCE_LEVELS = {
    "Very important": "VI",
    "Somewhat important": "SI",
    "Not too important": "NTI",
    "Not at all important": "NIAA",
    "Dont know (DO NOT READ)": "DK",
    "Refused (DO NOT READ)": "R",
}
ACCEPTANCE_LEVELS = {
    "Homosexuality should be accepted by society": "Y",
    "Homosexuality should not be accepted by society": "N",
    "Dont know (DO NOT READ)": "DK",
    "Refused (DO NOT READ)": "R",
}
# Answers drawn to the right of zero in diverging charts; all others count as "No".
IMPORTANCE_YES = ["Very important", "Somewhat important"]
ACCEPTANCE_YES = ["Homosexuality should be accepted by society"]

# Country names per source -> the name used everywhere.
NAME_ALIASES = {
    "survey": {
        "United States": "United States of America",
    },
    "income": {
        "United States": "United States of America",
        "Slovak Republic": "Slovakia",
        "Korea, Rep.": "South Korea",
        "Russian Federation": "Russia",
    },
    "culture": {
        "U.S.A.": "United States of America",
        "Africa East": "Kenya",
        "Africa West": "Tunisia",
        "Slovak Rep": "Slovakia",
        "Czech Rep": "Czech Republic",
        "Korea South": "South Korea",
        "Arab countries": "Lebanon",
        "Great Britain": "United Kingdom",
    },
    "chart": {
        "United States of America": "United States",
    },
}

# Predictors of the final model of mature content.
MODEL_PREDICTORS = [
    "income_level",
    "HOMOSEXUALITY",
    "RELIGION_IMPORT",
    "extrapolated_genderY",
    "pdi",
    "ltowvs",
    "ivr",
    "budget_mean",
]

# Country codes of the culture scores -> ISO 3166 alpha-3.
CULTURE_CODES = {
    "ALG": "DZA",
    "AFE": "KEN",
    "AUL": "AUS",
    "BAN": "BGD",
    "BOS": "BIH",
    "BUL": "BGR",
    "BUF": "BFA",
    "CHI": "CHN",
    "COS": "CRI",
    "CRO": "HRV",
    "ECA": "ECU",
    "DEN": "DNK",
    "ARA": "LBN",
    "SLV": "SVN",
    "SAL": "SLV",
    "SLK": "SVK",
    "GER": "DEU",
    "GRE": "GRC",
    "GUA": "GTM",
    "HOK": "HKG",
    "ICE": "ISL",
    "IDO": "IDN",
    "IRA": "IRN",
    "IRE": "IRL",
    "KYR": "KGZ",
    "LAT": "LVA",
    "LIT": "LTU",
    "MAL": "MYS",
    "MOL": "MDA",
    "MOR": "MAR",
    "NET": "NLD",
    "NIG": "NGA",
    "PHI": "PHL",
    "POR": "PRT",
    "PUE": "PRI",
    "ROM": "ROU",
    "SER": "SRB",
    "SIN": "SGP",
    "SAF": "ZAF",
    "SPA": "ESP",
    "SWI": "CHE",
    "TAI": "TWN",
    "TAN": "TZA",
    "TRI": "TTO",
    "URU": "URY",
    "VIE": "VNM",
    "ZAM": "ZMB",
    "ZIM": "ZWE",
}
