"""Registered queries over landed pages and payloads.

Payloads are built row by row from the driver tables: one landed page per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions import labels, places
from postwatch.operators import stats
from postwatch.plans import defaults, views
from postwatch.plans.queries import query
from postwatch.plans.views import table
from postwatch.session import spread
from postwatch.sources import pages, payloads, registry

PUBLIC = ["external_id", "title", "company", "location", "contract_type", "salary_min",
          "salary_max", "remote_pct", "description", "url", "posted_at", "ingest_seq"]

# --- HTML pages ------------------------------------------------------------------------------
ORIGIN = "regexp_extract(url, '^(https?://[^/]+)', 1)"
LINKS_SQL = f"""l AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS link_text,
         unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS pos
  FROM pages),
  u AS (SELECT *, {ORIGIN} || '/' || replace(url_encode(substr(href, 2)), '%2C', ',') AS link_url
        FROM l)"""


def _listings(spark: SparkSession, sf: str, pattern: str = "/e") -> DataFrame:
    df = spread(table(spark, sf, "pages"), "page_id")
    return pages.flat_pages(df.select(
        df.page_id.alias("page_seq"), "url", labels.url_host(df.url).alias("employer"),
        F.lit(pattern).alias("link_pattern"), "html"))


@query(f"WITH {LINKS_SQL} SELECT page_id AS page_seq, href, link_url, link_text, "
       "link_text AS block FROM u")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_links(_listings(spark, sf)).select(
        "page_seq", "href", "link_url", "link_text", "block")


@query(f"""WITH {LINKS_SQL}
  SELECT link_url AS url, link_text AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS company,
         CAST(NULL AS STRING) AS contract_type, CAST(NULL AS DATE) AS posted_at
  FROM u WHERE contains(link_url, '/e') AND length(link_text) >= 8
  QUALIFY row_number() OVER (PARTITION BY link_url ORDER BY page_id, pos) = 1""")
def harvest_listing(spark: SparkSession, sf: str) -> DataFrame:
    return pages.harvest_links(_listings(spark, sf)).select(
        "url", "title", "company", "contract_type", "posted_at")


@query(f"""WITH {LINKS_SQL},
  m AS (SELECT page_id, count(*) FILTER (WHERE contains(link_url, '/e')) AS matched,
          count(*) FILTER (WHERE contains(link_url, '/e') AND length(link_text) >= 8) AS kept,
          string_agg(CASE WHEN contains(link_url, '/e') THEN substr(link_text, 1, 40) END, ' | '
            ORDER BY pos) AS titles,
          count(*) AS links,
          array_to_string(list_slice(list_sort(list_distinct(list(substr(href, 1, 70)))), 1, 15),
            ' | ') AS hrefs FROM u GROUP BY page_id)
  SELECT m.page_id AS page_seq, p.url, links, matched, kept,
    CASE WHEN matched > 0 AND kept = 0 THEN titles END AS titles,
    CASE WHEN matched = 0 THEN hrefs END AS hrefs,
    CAST((length(html) - length(replace(html, 'example', ''))) / 7 AS INT) AS marker_hits
  FROM m JOIN pages p USING (page_id)""")
def harvest_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    df = pages.harvest_diagnostics(_listings(spark, sf), marker="Example")
    return df.withColumns({c: F.array_join(c, " | ") for c in ("titles", "hrefs")})


@query(r"""WITH s AS (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(regexp_replace(
    url, '[?#].*$', ''), '^https?://[^/]+', ''), '/+$', ''), '([^/]*)$', 1) AS seg FROM pages),
  t AS (SELECT page_id, trim(translate(regexp_replace(regexp_replace(seg, '\.(html?|aspx)$', ''),
    '^([\da-f]{2,}-){1,2}', ''), '-_', '  ')) AS t FROM s)
  SELECT page_id, upper(substr(t, 1, 1)) || substr(t, 2) AS title FROM t""")
def slug_titles(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "pages")
    return df.select("page_id", labels.title_from_slug(df.url).alias("title"))


TEXT_SQL = r"""x AS (SELECT page_id, url, array_to_string(list_filter(list_transform(
    string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>'),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), ' ') AS raw FROM pages),
  t AS (SELECT page_id, url, replace(replace(replace(replace(raw, '&quot;', '"'), '&copy;', '©'),
    '&middot;', '·'), '&amp;', '&') AS page_text FROM x)"""


@query(f"WITH {TEXT_SQL} SELECT page_id AS page_seq, page_text FROM t")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_text(_listings(spark, sf)).select("page_seq", "page_text")


PAGE_POSTINGS = """
  SELECT p.url, d.source, CASE d.doc_id % 3 WHEN 0 THEN 'Lyon' ELSE '' END AS location,
         CASE WHEN d.doc_id % 2 = 0 THEN d.text END AS description, d.doc_id AS ingest_seq
  FROM documents d CROSS JOIN (SELECT count(*) AS n FROM pages ) k
    LEFT JOIN pages p ON p.page_id = d.doc_id % k.n"""


def place_sql(text: str) -> str:
    low = f"lower({text})"
    cities = "".join(
        f" WHEN contains({low}, '{c}') THEN '{c.title()}'" for c in defaults.ZONE_CITIES)
    return rf"""CASE{cities}
      WHEN contains({low}, 'loire-atlantique') OR contains({low}, 'loire atlantique')
        THEN 'Loire-Atlantique'
      ELSE regexp_extract({text}, '\b(\d{{5}})\s+[A-ZÉÈÀ][a-zé]', 1) END"""


ENRICHED_SQL = f"""WITH {TEXT_SQL}, v AS ({PAGE_POSTINGS}),
  e AS (SELECT v.ingest_seq, v.url, coalesce(page_text, description) AS description,
    CASE WHEN v.location = '' AND page_text IS NOT NULL THEN {place_sql('page_text')}
      ELSE v.location END AS location FROM v LEFT JOIN t USING (url))"""


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    postings = views.view(spark, sf, PAGE_POSTINGS + " ", "documents", "pages")
    texts = pages.page_text(_listings(spark, sf))
    return pages.enrich_descriptions(postings, texts)


@query(ENRICHED_SQL + " SELECT * FROM e")
def enriched_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("ingest_seq", "url", "description", "location")


@query(ENRICHED_SQL + """ SELECT count(*) FILTER (WHERE coalesce(description, '') <> '') AS enriched,
    count(*) AS candidates FROM e""")
def enrichment_rate(spark: SparkSession, sf: str) -> DataFrame:
    return stats.enrichment_rate(_enriched(spark, sf))


PLACED = """
  SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' poste à REZÉ ou Nantes'
    WHEN 1 THEN ' en Loire Atlantique' WHEN 2 THEN ' 35000 Rennes' WHEN 3 THEN ' 35000 emplois'
    WHEN 4 THEN ' à Saint-Herblain, 44800' ELSE '' END AS text FROM documents """


@query(f"WITH p AS ({PLACED}) SELECT doc_id, {place_sql('text')} AS place FROM p")
def place_from_text(spark: SparkSession, sf: str) -> DataFrame:
    df = views.view(spark, sf, PLACED, "documents").withColumn("low", F.lower("text"))
    return df.select("doc_id", places.place_from_text(df.text, df.low).alias("place"))


CARDS = """
  SELECT o.o_orderkey AS page_seq, c.c_mktsegment AS employer, CAST(NULL AS STRING) AS link_pattern,
    o.o_custkey AS k, CASE o.o_orderpriority WHEN '1-URGENT' THEN 'CDI' WHEN '2-HIGH' THEN 'Stage'
      WHEN '3-MEDIUM' THEN 'Alternance' WHEN '5-LOW' THEN 'CDD' ELSE 'Autre' END AS contract,
    'Poste ' || c.c_name AS title, 'NATION_' || CAST(c.c_nationkey AS STRING) AS city,
    CAST(o.o_orderdate AS DATE) AS d, lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0') || '/'
      || lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') || '/'
      || CAST(year(o.o_orderdate) AS STRING) AS day
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey """


def _cards(spark: SparkSession, sf: str, url: str, html: str) -> DataFrame:
    df = spread(views.view(spark, sf, CARDS, "orders", "customer"), "page_seq")
    return pages.flat_pages(df.selectExpr(
        "page_seq", f"'{url}' as url", "employer", "link_pattern", f"{html} as html"))


@query(f"""WITH c AS ({CARDS})
  SELECT 'https://m.example.com/fr/offres/' || k AS url, title, employer AS company,
    CASE WHEN contract <> 'Autre' THEN contract END AS contract_type, city || ', France' AS location,
    page_seq * 1048576 AS page_at FROM c WHERE contract NOT IN ('Stage', 'Alternance')
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_seq) = 1""")
def harvest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    html = """'<ul><a href="/fr/offres/#x">Toutes</a><li><a href="https://m.example.com/fr/offres/'
      || k || '#top">' || title || '</a><p>' || contract || '<p>France<p>' || city
      || '</li><li><a href="https://m.example.com/fr/offres/' || k || '">Encore</a> CDI</ul>'"""
    flat = _cards(spark, sf, "https://m.example.com/fr/offres/", html)
    got = pages.harvest_links(flat, pages.BLOCKS)
    return got.select("url", "title", "company", "contract_type", "location",
                      F.floor(F.col("ingest_seq") / (1 << 20)).alias("p")).selectExpr(
        "url", "title", "company", "contract_type", "location", "p * 1048576 as page_at")


@query(f"""WITH c AS ({CARDS})
  SELECT 'https://c.example.com/liste/emploi-' || k || '.aspx?id=1' AS url, title,
    employer AS company, CASE WHEN contract <> 'Autre' THEN contract END AS contract_type,
    d AS posted_at FROM c WHERE contract NOT IN ('Stage', 'Alternance')
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_seq) = 1""")
def harvest_tiles(spark: SparkSession, sf: str) -> DataFrame:
    html = """'<ul><li><a href="emploi-' || k || '.aspx?id=1#a">' || title || '</a> '
      || lower(contract) || ' ' || day || '</li><li><a href="emploi-' || k || '.htm">x</a></ul>'"""
    flat = _cards(spark, sf, "https://c.example.com/liste/l.aspx", html)
    return pages.harvest_links(flat, pages.TILES).select(
        "url", "title", "company", "contract_type", "posted_at")


@query(f"""WITH c AS ({CARDS})
  SELECT 'https://i.example.com/j/' || k AS url, title, employer AS company,
    CASE contract WHEN 'CDI' THEN 'CDI' WHEN 'CDD' THEN 'CDD' END AS contract_type,
    'Nantes, France' AS location FROM c WHERE contract <> 'Stage'
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_seq) = 1""")
def harvest_cards(spark: SparkSession, sf: str) -> DataFrame:
    html = """'<body><main>' || repeat('menu ', 200) || '<div><div><h2>' || title || '</h2></div><p>'
      || CASE WHEN contract = 'Stage' THEN 'France - Lyon' ELSE 'FRANCE - Nantes' END || ' '
      || CASE contract WHEN 'CDI' THEN 'Open-ended' WHEN 'CDD' THEN 'Fixed-term' ELSE '' END
      || '</p><a href="/j/' || k || '#x">Read more</a></div></main>'"""
    flat = _cards(spark, sf, "https://i.example.com/en/jobs", html)
    return pages.harvest_containers(flat, "France - Nantes", "Nantes, France").select(
        "url", "title", "company", "contract_type", "location")


# --- JSON payloads ---------------------------------------------------------------------------
BASE = """
  SELECT o.o_orderkey AS page_seq, CAST(o.o_orderkey AS STRING) AS id, c.c_name AS name,
    o.o_orderstatus AS st, c.c_nationkey AS nk, c.c_mktsegment AS seg,
    CAST(CAST(floor(o.o_totalprice / 1000) AS INT) AS STRING) AS price,
    CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS day, CAST(o.o_orderdate AS DATE) AS d,
    o.o_orderdate AS ts,
    CASE c.c_nationkey % 5 WHEN 0 THEN 'Nantes' WHEN 1 THEN 'Lyon' WHEN 2 THEN 'Remote, France'
      WHEN 3 THEN 'REZÉ (Sud)' ELSE '' END AS city
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey """


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return spread(views.view(spark, sf, BASE, "orders", "customer"), "page_seq")


def _landed(spark: SparkSession, sf: str, body: str) -> DataFrame:
    return _base(spark, sf).selectExpr(
        "page_seq", "seg as employer", "'https://careers.example.com/Slug/jobs' as careers_url",
        f"to_json({body}) as body")


def public(mapped: DataFrame) -> DataFrame:
    return payloads.accepted(mapped).select(PUBLIC)


def public_sql(from_where: str, **columns: str) -> str:
    """SELECT of the posting columns; those not given are null."""
    kinds = {"salary_min": "INT", "salary_max": "INT", "remote_pct": "INT", "posted_at": "DATE"}
    cells = [
        f"{columns.get(c) or f'CAST(NULL AS {kinds.get(c, "STRING")})'} AS {c}" for c in PUBLIC
    ]
    return f"WITH b AS ({BASE}) SELECT {', '.join(cells)} FROM {from_where}"


@query(public_sql(
    "b WHERE nk % 7 <> 0 AND st <> 'P'", external_id="CASE WHEN nk % 2 = 0 THEN id ELSE 'https://b/' || id END",
    title="CASE WHEN nk % 3 = 0 THEN '(sans titre)' ELSE 'Poste ' || id END",
    company="CASE WHEN nk % 4 = 0 THEN 'Anonyme' ELSE name END", location="city",
    contract_type="CASE WHEN seg = 'BUILDING' THEN 'Stage' WHEN seg = 'MACHINERY' THEN 'Freelance' END",
    salary_min="CAST(CASE WHEN st = 'F' THEN CAST(price AS INT) END AS INT)",
    remote_pct="CASE WHEN nk % 2 = 1 THEN 100 END", url="'https://b/' || id", posted_at="d",
    ingest_seq="page_seq"))
def board_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _base(spark, sf).selectExpr(
        "CASE WHEN nk % 7 = 0 THEN 'monster' ELSE 'indeed' END as site",
        "CASE WHEN nk % 2 = 0 THEN id END as id",
        "CASE WHEN st = 'P' THEN ' ' ELSE 'https://b/' || id END as job_url",
        "CASE WHEN nk % 3 = 0 THEN 'nan' ELSE ' Poste ' || id END as title",
        "CASE WHEN nk % 4 = 0 THEN '' ELSE name END as company", "city as location",
        "CASE seg WHEN 'BUILDING' THEN 'internship' WHEN 'MACHINERY' THEN 'Contract' END as job_type",
        "CASE WHEN st = 'F' THEN 'yearly' ELSE 'hourly' END as `interval`",
        "price || '000' as min_amount", "'x' as max_amount", "nk % 2 = 1 as is_remote",
        "' ' as description", "day || 'T10:00' as date_posted", "page_seq as ingest_seq")
    return public(payloads.map_board_rows(rows))


EMPLOYMENT_BODY = """struct(array(
  struct(id, 'Poste ' || id as intitule, 'texte' as description, day || 'T08:00:00Z' as dateCreation,
    'CDI' as typeContrat, CASE WHEN nk % 2 = 0 THEN 'Temps plein - TÉLÉTRAVAIL' END
      as dureeTravailLibelleConverti, struct(name as nom) as entreprise,
    struct(city as libelle) as lieuTravail, struct('Annuel de ' || price || '000,0 Euros' as libelle)
      as salaire, struct(CASE WHEN st = 'F' THEN 'https://o/' || id END as urlOrigine)
      as origineOffre),
  from_json('{"id": "' || CASE WHEN st = 'O' THEN 'x' || id ELSE '' END || '"}', 'id STRING,
    intitule STRING, description STRING, dateCreation STRING, typeContrat STRING,
    dureeTravailLibelleConverti STRING, entreprise STRUCT<nom: STRING>,
    lieuTravail STRUCT<libelle: STRING>, salaire STRUCT<libelle: STRING>,
    origineOffre STRUCT<urlOrigine: STRING>')) as resultats)"""
PUBLIC_URL = "'https://candidat.francetravail.fr/offres/recherche/detail/' || "


@query(public_sql(
    "b", external_id="id", title="'Poste ' || id", company="name", location="city",
    contract_type="'CDI'",
    salary_min="CASE WHEN CAST(price AS INT) BETWEEN 15 AND 200 THEN CAST(price AS INT) END",
    remote_pct="CASE WHEN nk % 2 = 0 THEN 100 END", description="'texte'",
    url=f"CASE WHEN st = 'F' THEN 'https://o/' || id ELSE {PUBLIC_URL} id END", posted_at="d",
    ingest_seq="page_seq * 1048576") + " UNION ALL " + public_sql(
    "b WHERE st = 'O'", external_id="'x' || id", title="'(sans titre)'", company="'Anonyme'",
    location="''", url=f"{PUBLIC_URL} 'x' || id", ingest_seq="page_seq * 1048576 + 1"
).replace("WITH b AS (" + BASE + ") ", ""))
def public_employment_offers(spark: SparkSession, sf: str) -> DataFrame:
    return public(payloads.map_public_employment_offers(_landed(spark, sf, EMPLOYMENT_BODY)))


EXEC_BODY = """struct(array(
  struct(CASE WHEN nk % 6 <> 0 THEN id END as numeroOffre, CASE WHEN nk % 6 = 0 AND st <> 'P' THEN
    'i' || id END as id, CASE WHEN st = 'F' AND nk % 5 = 1 THEN ' ' ELSE ' Poste ' || id END
    as intitule, CASE WHEN nk % 3 = 0 THEN 'Nantes - 44' ELSE 'Angers - 49' END as lieuTexte,
    CASE WHEN nk % 4 = 0 THEN 'ZZ_' || name ELSE name END as nomCommercial,
    nk = 5 as offreConfidentielle, price || ' - 90 k€ brut' as salaireTexte, ' ' as texteOffre,
    day || 'T00:00' as datePublication, nk % 2 = 0 as localisable,
    CASE WHEN nk % 10 = 0 THEN '47.36' ELSE '47.47' END as latitude,
    CASE WHEN nk % 10 = 0 THEN '-1.18' ELSE '-0.55' END as longitude)) as resultats)"""
EXEC_ID = "CASE WHEN nk % 6 <> 0 THEN id WHEN st <> 'P' THEN 'i' || id END"
EXEC_TITLED = "NOT (st = 'F' AND nk % 5 = 1)"
EXEC_ZONE = "CASE WHEN nk % 2 = 0 THEN nk % 10 = 0 ELSE nk % 3 = 0 END"
EXEC_PAY = """list_filter([CAST(price AS INT), 90], lambda x: x BETWEEN 15 AND 200)"""


@query(public_sql(
    f"b WHERE {EXEC_ID} IS NOT NULL AND {EXEC_TITLED} AND {EXEC_ZONE}", external_id=EXEC_ID,
    title="'Poste ' || id", company="CASE WHEN nk % 4 = 0 OR nk = 5 THEN 'Anonyme (APEC)' ELSE name END",
    location="CASE WHEN nk % 3 = 0 THEN 'Nantes - 44' ELSE 'Angers - 49' END", contract_type="'CDI'",
    salary_min=f"list_min({EXEC_PAY})",
    salary_max=f"CASE WHEN len({EXEC_PAY}) > 1 THEN list_max({EXEC_PAY}) END",
    url=f"'https://www.apec.fr/candidat/recherche-emploi.html/emploi/detail-offre/' || {EXEC_ID}",
    posted_at="d", ingest_seq="page_seq * 1048576"))
def exec_offers(spark: SparkSession, sf: str) -> DataFrame:
    return public(payloads.map_exec_offers(_landed(spark, sf, EXEC_BODY)))


@query(f"""WITH b AS ({BASE}), r AS (SELECT CASE WHEN {EXEC_ID} IS NULL THEN 'no id'
    WHEN NOT {EXEC_TITLED} THEN 'no title' WHEN NOT {EXEC_ZONE} THEN 'out of zone' END AS reject
  FROM b) SELECT reject, count(*) AS n FROM r WHERE reject IS NOT NULL GROUP BY reject""")
def quarantine_counts(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.quarantine_counts(payloads.map_exec_offers(_landed(spark, sf, EXEC_BODY)))


CONTENT_BODY = """struct(array(
  struct(id, ' Poste ' || id || ' ' as name, day || 'T1' as releasedDate,
    struct(CASE WHEN nk % 2 = 0 THEN name END as name) as company,
    struct(nullif(city, '') as city, CASE WHEN nk = 4 THEN '44000' ELSE '69000' END as postalCode,
           nk = 9 as remote) as location),
  struct('x' || id as id, '' as name, day as releasedDate, struct(name as name) as company,
    struct('Nantes' as city, '' as postalCode, true as remote) as location)) as content)"""
CONTENT_ZONE = "(nk % 5 IN (0, 3) OR nk = 4 OR nk = 9)"


@query(public_sql(
    f"b WHERE {CONTENT_ZONE}", external_id="id", title="'Poste ' || id",
    company="CASE WHEN nk % 2 = 0 THEN name ELSE seg END",
    location="coalesce(nullif(city, ''), 'Remote') || ', France'",
    remote_pct="CASE WHEN nk = 9 THEN 100 END",
    url="'https://jobs.smartrecruiters.com/Slug/' || id", posted_at="d",
    ingest_seq="page_seq * 1048576"))
def ats_smartrecruiters(spark: SparkSession, sf: str) -> DataFrame:
    return public(payloads.map_ats_smartrecruiters(_landed(spark, sf, CONTENT_BODY)))


FEED_BODY = """struct(array(
  struct(CASE WHEN nk % 2 = 0 THEN id END as id, CASE WHEN st = 'P' THEN ' ' ELSE 'https://t/' || id
    END as url, 'Poste ' || id as title, '<p>Un <b>' || name || '</b><br>texte' as content_html,
    day as date_published)) as items)"""


@query(public_sql(
    "b WHERE st <> 'P'", external_id="CASE WHEN nk % 2 = 0 THEN id ELSE 'https://t/' || id END",
    title="'Poste ' || id", company="seg", location="''", description="'Un ' || name || ' texte'",
    url="'https://t/' || id", posted_at="d", ingest_seq="page_seq * 1048576"))
def ats_teamtailor(spark: SparkSession, sf: str) -> DataFrame:
    return public(payloads.map_ats_teamtailor(_landed(spark, sf, FEED_BODY)))


@query(f"""WITH b AS ({BASE}) SELECT page_seq * 1048576 AS ingest_seq,
  '{{' || CASE WHEN nk % 2 = 0 THEN '"id":"' || id || '",' ELSE '' END || '"url":"https://t/' || id
  || '","title":"Poste ' || id || '","date_published":"' || day || '"}}' AS raw
  FROM b WHERE st <> 'P'""")
def kept_payloads(spark: SparkSession, sf: str) -> DataFrame:
    mapped = payloads.map_ats_teamtailor(_landed(spark, sf, FEED_BODY))
    return payloads.accepted(mapped).select("ingest_seq", "raw")


JOBS_BODY = """struct(array(
  struct(id, 'Poste ' || id as title, CASE WHEN st = 'P' THEN '' ELSE 'https://g/' || id END
    as absolute_url, day || 'T' as updated_at, struct(city as name) as location)) as jobs)"""


@query(public_sql(
    "b WHERE nk % 5 IN (0, 2, 3) AND st <> 'P'", external_id="id", title="'Poste ' || id",
    company="seg", location="city", remote_pct="CASE WHEN nk % 5 = 2 THEN 100 END",
    url="'https://g/' || id", posted_at="d", ingest_seq="page_seq * 1048576"))
def ats_greenhouse(spark: SparkSession, sf: str) -> DataFrame:
    return public(payloads.map_ats_greenhouse(_landed(spark, sf, JOBS_BODY)))


ARRAY_BODY = """array(
  struct(id, 'Poste ' || id as text, 'https://l/' || id as hostedUrl,
    CASE WHEN st = 'O' THEN 'bad' ELSE CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING) END
      as createdAt, '<p>x' as description, array('a') as lists, ' ' || name as descriptionPlain,
    struct(city as location) as categories))"""


@query(public_sql(
    "b WHERE nk % 5 IN (0, 2, 3)", external_id="id", title="'Poste ' || id", company="seg",
    location="city", remote_pct="CASE WHEN nk % 5 = 2 THEN 100 END", description="name",
    url="'https://l/' || id", posted_at="CASE WHEN st <> 'O' THEN d END",
    ingest_seq="page_seq * 1048576"))
def ats_lever(spark: SparkSession, sf: str) -> DataFrame:
    return public(payloads.map_ats_lever(_landed(spark, sf, ARRAY_BODY)))


@query(f"""WITH b AS ({BASE}) SELECT id AS url, 'Un ' || name || CASE WHEN st = 'F' THEN '' ELSE
  ' deux ' || seg END AS page_text FROM b""")
def job_ad_text(spark: SparkSession, sf: str) -> DataFrame:
    body = """to_json(struct(struct(map('a', struct('<p>Un</p><p>' || name as text),
      'b', struct(CASE WHEN st = 'F' THEN '' ELSE '<i>deux</i> ' || seg END as text)) as sections)
      as jobAd))"""
    return pages.job_ad_text(
        _base(spark, sf).selectExpr("id as url", f"{body} as body"))


@query(f"""WITH b AS ({BASE})
  SELECT 'https://g/' || id AS url, seg AS company FROM b WHERE nk % 5 IN (0, 2, 3) AND st = 'F'
  UNION ALL SELECT 'https://l/' || id, seg FROM b WHERE nk % 5 IN (0, 2, 3) AND st = 'O'
  UNION ALL SELECT 'skipped ' || id, seg FROM b WHERE nk % 5 = 1 OR st = 'P'""")
def source_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Landed pages of several systems by ats or domain, and the pages nobody can read."""
    body = f"""CASE st WHEN 'F' THEN to_json({JOBS_BODY}) WHEN 'O' THEN to_json({ARRAY_BODY}) END"""
    landed = _base(spark, sf).selectExpr(
        "page_seq", "seg as employer", "id", "cast(null as string) as link_pattern",
        "CASE WHEN st = 'F' AND nk % 5 <> 1 THEN 'greenhouse' WHEN nk % 5 = 1 THEN 'other' END as ats",
        "CASE WHEN st = 'O' AND nk % 5 <> 1 THEN 'https://jobs.lever.co/x' ELSE 'https://no.org/' END "
        "as careers_url", f"{body} as body")
    postings, skipped = registry.dispatch_career_pages(
        landed, {"jobs.lever.co": "lever"})
    return postings.select("url", "company").unionByName(
        skipped.select(F.concat(F.lit("skipped "), "id").alias("url"),
                       F.col("employer").alias("company")))


@query(f"""WITH b AS ({BASE})
  SELECT 0 * 1152921504606846976 + page_seq AS ingest_seq, 'jobspy_indeed' AS source, 'https://b/' || id AS url
  FROM b WHERE nk % 7 <> 0
  UNION ALL SELECT 2 * 1152921504606846976 + page_seq * 1048576, 'apec_rss',
    'https://www.apec.fr/candidat/recherche-emploi.html/emploi/detail-offre/' || {EXEC_ID}
  FROM b WHERE {EXEC_ID} IS NOT NULL AND {EXEC_TITLED} AND {EXEC_ZONE}
  UNION ALL SELECT 3 * 1152921504606846976 + page_seq * 1048576, 'careers_site', 'https://g/' || id
  FROM b WHERE nk % 5 IN (0, 2, 3) AND st <> 'P'""")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources in fixed order and one that fails, which leaves the others alone."""
    boards = _base(spark, sf).selectExpr(
        "CASE WHEN nk % 7 = 0 THEN 'monster' ELSE 'indeed' END as site", "id",
        "'https://b/' || id as job_url", "'t' as title", "name as company", "city as location",
        "'' as job_type", "'' as `interval`", "'' as min_amount", "'' as max_amount",
        "false as is_remote", "'' as description", "day as date_posted", "page_seq as ingest_seq")

    def broken() -> DataFrame:
        raise OSError("source down")

    union, errors = registry.union_sources({
        "careers_sites": payloads.accepted(
            payloads.map_ats_greenhouse(_landed(spark, sf, JOBS_BODY))),
        "apec": payloads.accepted(payloads.map_exec_offers(_landed(spark, sf, EXEC_BODY))),
        "jobspy": payloads.accepted(payloads.map_board_rows(boards)),
        "france_travail": broken,
    }, isolate=True)
    assert list(errors) == ["france_travail"]
    return union.select("ingest_seq", "source", "url")
