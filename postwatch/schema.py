"""Table schemas as DDL.  Production reads always name a schema, none is inferred."""


def names(ddl: str) -> list[str]:
    """Column names of a flat DDL schema."""
    return [field.split()[0] for field in ddl.split(",")]


POSTINGS = """
    source STRING, external_id STRING, title STRING, company STRING, location STRING,
    contract_type STRING, salary_min INT, salary_max INT, remote_pct INT, description STRING,
    url STRING, posted_at DATE, raw STRING, ingest_seq BIGINT"""
POSTING_COLUMNS = names(POSTINGS)

EMPLOYERS = """
    ord INT, name STRING, tier INT, sector STRING, careers_url STRING,
    aliases ARRAY<STRING>, ats STRING, link_pattern STRING"""

SEEN_ATTRIBUTES = ["source", "url", "title", "company"]
SEEN = """
    fingerprint STRING, first_seen DATE, last_seen DATE, source STRING, url STRING,
    title STRING, company STRING"""

# --- landed payloads, one row per fetched page -------------------------------------------
BOARD_ROWS = """
    site STRING, id STRING, job_url STRING, title STRING, company STRING, location STRING,
    job_type STRING, `interval` STRING, min_amount STRING, max_amount STRING,
    is_remote BOOLEAN, description STRING, date_posted STRING"""
PUBLIC_EMPLOYMENT_PAGE = """
    resultats ARRAY<STRUCT<id: STRING, intitule: STRING, description: STRING,
    dateCreation: STRING, typeContrat: STRING, dureeTravailLibelleConverti: STRING,
    entreprise: STRUCT<nom: STRING>, lieuTravail: STRUCT<libelle: STRING>,
    salaire: STRUCT<libelle: STRING>, origineOffre: STRUCT<urlOrigine: STRING>>>"""
EXECUTIVE_PAGE = """
    resultats ARRAY<STRUCT<numeroOffre: STRING, id: STRING, intitule: STRING,
    lieuTexte: STRING, nomCommercial: STRING, offreConfidentielle: BOOLEAN,
    salaireTexte: STRING, texteOffre: STRING, datePublication: STRING,
    localisable: BOOLEAN, latitude: STRING, longitude: STRING>>, totalCount INT"""
SMARTRECRUITERS_PAGE = """
    content ARRAY<STRUCT<id: STRING, name: STRING, releasedDate: STRING,
    company: STRUCT<name: STRING>,
    location: STRUCT<city: STRING, postalCode: STRING, remote: BOOLEAN>>>, totalFound INT"""
TEAMTAILOR_PAGE = """
    items ARRAY<STRUCT<id: STRING, url: STRING, title: STRING, content_html: STRING,
    date_published: STRING>>"""
GREENHOUSE_PAGE = """
    jobs ARRAY<STRUCT<id: STRING, title: STRING, absolute_url: STRING, updated_at: STRING,
    location: STRUCT<name: STRING>>>"""
LEVER_PAGE = """
    ARRAY<STRUCT<id: STRING, text: STRING, hostedUrl: STRING, createdAt: STRING,
    description: STRING, lists: STRING, descriptionPlain: STRING,
    categories: STRUCT<location: STRING>>>"""
JOB_AD = "jobAd STRUCT<sections: MAP<STRING, STRUCT<text: STRING>>>"
