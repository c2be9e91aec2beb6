"""Default parameters.  Fixed values: results depend on them; every operator takes its own."""

WEIGHTS = {
    "hard_skills": 0.25,
    "title_match": 0.30,
    "soft_skills": 0.10,
    "location_score": 0.20,
    "tier_score": 0.15,
}
MIN_SCORE = 65
MIN_SCORE_TIER1 = 58

TARGET_TITLES = [
    "service delivery manager",
    "delivery manager",
    "sdm",
    "chef de projet",
    "responsable operations services",
    "operations services",
    "pmo",
    "product manager",
    "product owner",
    "data engineer",
]

HARD_SKILLS = {
    r"\bitil\b": 15,
    r"\bdelivery\b": 15,
    r"\binfog[eé]rance\b": 15,
    r"\bsla\b": 10,
    r"\bkpi\b": 8,
    r"\bincident\b": 8,
    r"\bcopil\b": 5,
    r"\bt[eé]l[eé]com\b": 10,
    r"\bb2b\b": 8,
    r"\b(?:xdsl|thd|lte|4g|5g)\b": 5,
    r"\baws\b": 8,
    r"\bpython\b": 8,
    r"\betl\b": 8,
    r"\bairflow\b": 5,
    r"\bmongo\b": 5,
    r"\bmanagement d.[eé]quipe\b": 10,
    r"\bpmo\b": 8,
    r"\bgestion de projets?\b": 10,
    r"\bpilotage\b": 8,
    r"\bagile\b": 8,
    r"\bscrum\b": 8,
    r"\bjira\b": 5,
    r"\bmoa\b": 8,
    r"\bmoe\b": 5,
    r"\broadmap\b": 5,
    r"\bbacklog\b": 5,
    r"\bbudget\b": 5,
    r"\bplanning\b": 5,
    r"\b(?:prince2|pmp)\b": 5,
    r"\bsql\b": 8,
    r"\bspark\b": 5,
    r"\bkafka\b": 5,
    r"\b(?:snowflake|dbt)\b": 5,
    r"\b(?:azure|gcp)\b": 5,
    r"\bdocker\b": 5,
    r"\bpower bi\b": 5,
}
SOFT_SKILLS = {
    r"\bmanagement\b": 20,
    r"\binternational\b": 15,
    r"\bmulti[- ]sites?\b": 15,
    r"\banglais\b": 15,
    r"\bencadrement\b": 10,
    r"\b(?:gouvernance|governance)\b": 10,
    r"\btransversal\b": 10,
    r"\brelation client\b": 10,
}

EXCLUDED_CONTRACTS = [
    "cdd", "stage", "stagiaire", "alternance", "alternant", "apprentissage", "apprenti",
    "intérim", "interim", "mis", "mission", "freelance", "indépendant", "independant",
    "saisonnier", "contract", "temporary", "internship", "apprenticeship", "vie",
]
EXCLUDED_TITLE = r"\b(stages?|stagiaires?|alternan\w+|apprenti\w*|int[eé]rims?|cdd)\b"

# (score, places), tried in order on the folded location.
LOCATION_RINGS = [
    (100, ["nort-sur-erdre"]),
    (90, ["nantes", "saint-herblain", "reze", "vertou", "carquefou", "orvault",
          "saint-sebastien", "bouguenais", "la-chapelle-sur-erdre"]),
    (75, ["ancenis", "clisson", "chateaubriant", "saint-nazaire", "pornic",
          "nort-sur-erdre", "blain", "guerande"]),
]
HOME_DEPARTMENT = "44"
HOME_DEPARTMENT_NAME = "loire-atlantique"
PREFILTERED_SOURCES = ["france_travail", "apec_rss", "careers_site"]

ZONE_CITIES = [
    "nantes", "saint-herblain", "st-herblain", "carquefou", "ancenis",
    "saint-nazaire", "reze", "rezé", "orvault", "vertou",
]
ZONE_CENTRE = (47.2184, -1.5536)
ZONE_KM = 50.0
EARTH_RADIUS_KM = 6371.0

TIER_SCORES = {1: 100, 2: 80, 3: 60}
OFF_LIST_SCORE = 50

# Sources: physical name to (logical name, display label), and the collection order.
SOURCES = {
    "jobspy_indeed": ("jobspy", "Indeed"),
    "jobspy_glassdoor": ("jobspy", "Glassdoor"),
    "jobspy_google": ("jobspy", "Google Jobs"),
    "jobspy_linkedin": ("jobspy", "LinkedIn"),
    "france_travail": ("france_travail", "France Travail"),
    "apec_rss": ("apec", "APEC"),
    "careers_site": ("careers_sites", None),
}
LOGICAL_SOURCES = ["jobspy", "france_travail", "apec", "careers_sites"]
LOGICAL_SOURCE_LABELS = {
    "jobspy": "jobspy (Indeed / Google)",
    "france_travail": "France Travail",
    "apec": "APEC (RSS)",
    "careers_sites": "Sites carrières",
}
BOARD_SITES = {
    "indeed": "jobspy_indeed",
    "glassdoor": "jobspy_glassdoor",
    "google": "jobspy_google",
    "linkedin": "jobspy_linkedin",
}
RECENCY_DAYS = 3
RECENCY_HOURS = 48

TRACKER_STATUSES = [
    "À cibler", "Offre repérée", "Candidature envoyée", "En cours",
    "Entretien", "Relance", "Stand-by", "Refus",
]
# Hosts of career pages and the mapper that reads them; the text that marks a card,
# and its place.
CAREER_DOMAINS = {
    "careers.manitou-group.com": "blocks",
    "recrutement.arkea.com": "cegid",
    "docaposte-recrute.profils.org": "cegid",
    "careers.smartrecruiters.com": "smartrecruiters",
    "careers.akeneo.com": "teamtailor",
    "job-boards.eu.greenhouse.io": "greenhouse",
    "www.inetum.com": "cards",
}
CARD_MARKER = "france - nantes"
CARD_PLACE = "Nantes, France"
NAV_LABELS = [
    "lire la suite", "en savoir plus", "read more", "voir l'offre", "postuler", "candidater",
]
