"""Registered queries: every operator over the driver tables, with the SQL that checks it.

A query without SQL cannot be said in SQL (streams, whole runs); tests check those.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions import dates, labels, numbers, places
from postwatch.functions.text import clean, clean_employer, fingerprint, normalize
from postwatch.operators import dedup, filters, lexicon, match, publish, score, state, stats
from postwatch.plans import defaults, views
from postwatch.plans.daily import daily_run
from postwatch.plans.views import doc_postings, event_sightings, order_postings, table
from postwatch.schema import SEEN, names
from postwatch.session import scratch_path, spread
from postwatch.streaming import runs
from postwatch.streaming import seen as seen_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


# --- SQL pieces ------------------------------------------------------------------------------
def norm(x: str) -> str:
    marker = r"\s*[\(\[]?\s*[hfm]\s*/\s*[hfm]\s*[\)\]]?\s*"
    text = f"regexp_replace(strip_accents(lower({x})), '{marker}', ' ', 'g')"
    text = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"trim(regexp_replace({text}, '[.,;:!?]+$', ''))"


def print_sql(company: str, title: str) -> str:
    return f"sha256({norm(company)} || '|' || {norm(title)})"


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(trim(split_part({norm(x)}, '—', 1)), '\s*\(p[1-3]\)$', ''))"


def lexicon_sql(text: str, words: dict[str, int]) -> str:
    terms = [
        f"CASE WHEN regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_]){p[2:-2]}"
        f"($|[^\\p{{L}}\\p{{N}}_])') THEN {w} ELSE 0 END"
        for p, w in words.items()
    ]
    return f"least(100, {' + '.join(terms)})"


def match_sql(companies: str, employers: str) -> str:
    """CTEs cn, nd and em over the named CTEs: naive comparison of all pairs."""
    edge = "'(^|[^a-z0-9])' || {0} || '($|[^a-z0-9])'"
    inside = "CASE WHEN contains({1}, {0}) THEN regexp_matches({1}, " + edge + ") ELSE false END"
    hit = inside.format("needle", "company_norm")
    back = inside.format("company_norm", "needle")
    return f"""
      cn AS (SELECT DISTINCT {norm('company')} AS company_norm FROM {companies}),
      nd AS (SELECT ord, name, tier, {norm('u')} AS needle FROM (
               SELECT ord, name, tier, name AS u FROM {employers}
               UNION ALL SELECT ord, name, tier, alias FROM {employers})),
      em AS (SELECT company_norm, arg_min(name, ord) AS employer, arg_min(tier, ord) AS employer_tier
             FROM cn JOIN nd ON company_norm <> '' AND needle <> '' AND ({hit} OR {back})
             GROUP BY company_norm)"""


SUPPLIER_EMPLOYERS = """
  SELECT CAST(s_suppkey AS INT) AS ord, s_name AS name, CAST(s_suppkey % 3 + 1 AS INT) AS tier,
         'Maison ' || s_name AS alias FROM supplier"""
SEGMENT_EMPLOYERS = """
  SELECT CAST(c_custkey AS INT) AS ord, c_name AS name, CAST(c_custkey % 3 + 1 AS INT) AS tier,
         'Maison ' || c_name AS alias FROM customer"""
TIER_SQL = "CASE employer_tier WHEN 1 THEN 100 WHEN 2 THEN 80 WHEN 3 THEN 60 ELSE 50 END"

HARD = {r"\bthe\b": 15, r"\bque\b": 20, r"\bder\b": 10, r"\b(?:los|las)\b": 12, r"\bof the\b": 10,
        r"\bworthless\b": 8, r"\ben la\b": 9, r"\ba.d\b": 15, r"\bund\b": 18, r"\bles?\b": 15}
SOFT = {r"\bwith\b": 20, r"\bdans\b": 30, r"\bdie\b": 25, r"\bmulti[- ]sites?\b": 15,
        r"\bpara?\b": 35, r"\bto\b": 10}
TARGETS = ["chef de projet", "Data Engineer", "red ring", "large gear", "cold plate (H/F)"]
MIN_SCORE, MIN_TIER1 = 68, 62

# Part names are an adjective and a noun; the checking SQL works out the similarity of every name
# from its definition.
_ADJECTIVES = ["red", "blue", "hot", "cold", "small", "large", "old", "new"]
_NOUNS = ["ring", "widget", "bolt", "anvil", "plate", "rod", "gear", "gizmo"]
LONGEST_SQL = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i:
  list_transform(range(1, length(a) - i + 2), lambda k: {
    'k': CASE WHEN contains(b, substr(a, i, k)) THEN k ELSE 0 END,
    'i': -i, 'j': -instr(b, substr(a, i, k))}))))"""


def fuzzy_sql(targets: list[str], shapes: list[str]) -> str:
    """Longest common part (the first in the title, then in the target), then the same left and
    right of it."""
    titles = ", ".join(f"('{shape.format(f'{a} {n}')}')"
                       for shape in shapes for a in _ADJECTIVES for n in _NOUNS)
    wanted = ", ".join(f"('{t}')" for t in match.clean_targets(targets))
    return f"""(
  WITH RECURSIVE pairs AS (
    SELECT title, target FROM (VALUES {titles}) AS n(title), (VALUES {wanted}) AS w(target)),
  parts AS (
    SELECT title, target, a, b, {LONGEST_SQL} AS m
    FROM (SELECT *, title AS a, target AS b FROM pairs)
    UNION ALL
    SELECT title, target, a, b, {LONGEST_SQL} AS m FROM (
      SELECT title, target, unnest([substr(a, 1, -m.i - 1), substr(a, m.k - m.i)]) AS a,
             unnest([substr(b, 1, -m.j - 1), substr(b, m.k - m.j)]) AS b
      FROM parts WHERE m.k > 0)),
  ratios AS (
    SELECT title, target,
           2.0::DOUBLE * sum(coalesce(m.k, 0)) / (length(title) + length(target)) AS r
    FROM parts GROUP BY title, target)
  SELECT title AS title_norm, CASE WHEN bool_or(contains(title, target)) THEN 100.0::DOUBLE
         ELSE round_even(max(r) * 100, 1) END AS title_match
  FROM ratios GROUP BY title) AS fz"""


# --- text ------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {norm('text')} AS normalized FROM documents")
def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    df = views.documents(spark, sf)
    return df.select("doc_id", normalize(df.text).alias("normalized"))


@query(f"WITH v AS ({views.ORDER_POSTINGS}) SELECT ingest_seq, "
       f"{print_sql('company', 'title')} AS fingerprint FROM v")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    df = order_postings(spark, sf)
    return df.select("ingest_seq", fingerprint(df.company, df.title).alias("fingerprint"))


@query(f"WITH v AS ({views.ORDER_POSTINGS}) SELECT ingest_seq, {clean_sql('company')} AS employer "
       "FROM v")
def clean_employers(spark: SparkSession, sf: str) -> DataFrame:
    df = order_postings(spark, sf)
    return df.select("ingest_seq", clean_employer(df.company).alias("employer"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' AND event_type <> 'view'
            THEN event_type END AS cleaned FROM events""")
def missing_values(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    dirty = F.when(df.event_type == "error", "NaN").when(df.event_type == "view", " \t ").otherwise(
        F.concat(F.lit("  "), df.event_type, F.lit("\n")))
    return df.select("event_id", clean(dirty).alias("cleaned"))


# --- dedup and state -------------------------------------------------------------------------
@query(f"""WITH v AS ({views.SIGHTINGS})
  SELECT fingerprint, run_date, ingest_seq, url FROM v
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ingest_seq) = 1""")
def keep_first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    df = event_sightings(spark, sf).select("fingerprint", "run_date", "ingest_seq", "url")
    return dedup.keep_first(df, ["fingerprint"])


@query(f"""WITH v AS ({views.ORDER_POSTINGS})
  SELECT url, title, company, ingest_seq FROM v
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY ingest_seq) = 1""")
def keep_first_by_url(spark: SparkSession, sf: str) -> DataFrame:
    df = order_postings(spark, sf).select("url", "title", "company", "ingest_seq")
    return dedup.keep_first(df, ["url"])


@query(f"""WITH v AS ({views.SIGHTINGS}),
  f AS (SELECT fingerprint, min(run_date) AS first_run FROM v GROUP BY fingerprint)
  SELECT run_date, count(*) AS collected,
         count(*) FILTER (WHERE run_date = first_run) AS new,
         count(*) FILTER (WHERE run_date > first_run) AS already_seen
  FROM v JOIN f USING (fingerprint) GROUP BY run_date""")
def new_vs_known_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return state.new_known_by_run(event_sightings(spark, sf))


SPLIT_DAY = dt.date(1998, 1, 1)
SPLIT_SQL = f"""WITH v AS (SELECT *, {print_sql('company', 'title')} AS fingerprint
    FROM ({views.ORDER_POSTINGS})),
  seen AS (SELECT DISTINCT fingerprint FROM v WHERE posted_at < DATE '{SPLIT_DAY}'),
  b AS (SELECT *, fingerprint IN (SELECT fingerprint FROM seen) AS is_known
        FROM v WHERE posted_at >= DATE '{SPLIT_DAY}')"""


def _seen_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = order_postings(spark, sf)
    df = df.withColumn("fingerprint", fingerprint(df.company, df.title))
    return df.filter(df.posted_at < SPLIT_DAY), df.filter(df.posted_at >= SPLIT_DAY)


@query(SPLIT_SQL + " SELECT ingest_seq, fingerprint, is_known FROM b")
def known_flags(spark: SparkSession, sf: str) -> DataFrame:
    seen, batch = _seen_and_batch(spark, sf)
    return state.flag_known(batch.select("ingest_seq", "fingerprint"), seen)


@query(SPLIT_SQL + """ SELECT ingest_seq, title, CASE WHEN is_known THEN 'known' ELSE 'new' END
  AS part FROM b""")
def split_new_known(spark: SparkSession, sf: str) -> DataFrame:
    seen, batch = _seen_and_batch(spark, sf)
    new, known = state.split_new_known(batch, seen)
    return (
        new.select("ingest_seq", "title", F.lit("new").alias("part"))
        .unionByName(known.select("ingest_seq", "title", F.lit("known").alias("part")))
    )


SEEN_SQL = f"""WITH v AS ({views.SIGHTINGS})
  SELECT fingerprint, min(run_date) AS first_seen, max(run_date) AS last_seen,
         arg_min(source, ingest_seq) AS source, arg_min(url, ingest_seq) AS url,
         arg_min(title, ingest_seq) AS title, arg_min(company, ingest_seq) AS company
  FROM v GROUP BY fingerprint"""


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    df = event_sightings(spark, sf)
    run = F.datediff(df.run_date, F.lit(dt.date(2024, 1, 1)))
    return state.sightings(df, run, df.run_date)


@query(SEEN_SQL)
def seen_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.as_seen(state.fold_sightings(_sightings(spark, sf)))


MERGE_DAY, MERGE_RUN_DAY = dt.date(2024, 1, 15), dt.date(2024, 1, 2)
MERGE_SQL = f"""WITH v AS ({views.SIGHTINGS}),
  w AS (SELECT fingerprint, run_date < DATE '{MERGE_DAY}' AS old,
               CASE WHEN run_date < DATE '{MERGE_DAY}' THEN run_date
                    ELSE DATE '{MERGE_RUN_DAY}' END AS d, source, url, title, company, ingest_seq
        FROM v)
  SELECT fingerprint, arg_min(d, ingest_seq) AS first_seen, arg_max(d, ingest_seq) AS last_seen,
         arg_min(source, ingest_seq) AS source, arg_min(url, ingest_seq) AS url,
         arg_min(title, ingest_seq) AS title, arg_min(company, ingest_seq) AS company
  FROM w GROUP BY fingerprint"""


@query(MERGE_SQL)
def merge_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Half the days as state, the other half as one run with an older date: last_seen follows
    the run, not the calendar."""
    rows = event_sightings(spark, sf)
    run = F.datediff(rows.run_date, F.lit(dt.date(2024, 1, 1)))
    old = rows.filter(rows.run_date < MERGE_DAY)
    folded = state.fold_sightings(state.sightings(old, run, F.col("run_date")))
    batch = rows.filter(rows.run_date >= MERGE_DAY)
    return state.as_seen(state.merge_seen(folded, batch, 1000, MERGE_RUN_DAY))


@query(MERGE_SQL)
def seen_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the stored log, with a compaction in between and a repeated run."""
    rows = event_sightings(spark, sf)
    log = state.SeenLog(spark, scratch_path(spark, "seen"))
    week = dt.timedelta(days=7)
    old = rows.filter(rows.run_date < MERGE_DAY)
    start = old.agg(F.min("run_date")).first()[0] or MERGE_DAY
    days = [start + dt.timedelta(days=i) for i in range((MERGE_DAY - start).days)]
    for run, day in enumerate(days):
        log.append(old.filter(old.run_date == day), run, day)
        if day == start + week:
            log.compact(run)
    for _ in range(2):
        log.append(rows.filter(rows.run_date >= MERGE_DAY), len(days), MERGE_RUN_DAY)
    return log.read()


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of sightings."""
    source = table(spark, sf, "events")
    stream = (
        spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1).parquet(sf)
    )
    rows = stream.select(
        F.concat_ws("-", stream.user_id.cast("string"), stream.event_type).alias("fingerprint"),
        stream.ts.cast("date").alias("run_date"), stream.event_id.alias("ingest_seq"),
        stream.event_type.alias("source"),
        F.concat(F.lit("u"), stream.event_id.cast("string")).alias("url"),
        stream.props.alias("title"), stream.user_id.cast("string").alias("company"),
    )
    run = F.datediff(rows.run_date, F.lit(dt.date(2024, 1, 1)))
    return state.sightings(rows, run, rows.run_date)


def _streamed(spark: SparkSession, sf: str) -> tuple[str, str]:
    output, checkpoint = scratch_path(spark, "stream-flags"), scratch_path(spark, "stream-check")
    seen_stream.stream_seen_state(_event_stream(spark, sf), output, checkpoint).awaitTermination()
    return output, checkpoint


@query(SEEN_SQL)
def stream_seen_state(spark: SparkSession, sf: str) -> DataFrame:
    _, checkpoint = _streamed(spark, sf)
    return seen_stream.read_streamed_state(spark, checkpoint).select(names(SEEN))


@query("""SELECT user_id || '-' || event_type AS fingerprint, event_id AS ingest_seq,
    min(CAST(ts AS DATE)) OVER (PARTITION BY user_id, event_type) < CAST(ts AS DATE) AS is_known
  FROM events""")
def stream_known_flags(spark: SparkSession, sf: str) -> DataFrame:
    output, _ = _streamed(spark, sf)
    return seen_stream.read_flags(spark, output).select("fingerprint", "ingest_seq", "is_known")


# --- filters ---------------------------------------------------------------------------------
VOCABULARY_SQL = ", ".join(f"'{w}'" for w in defaults.EXCLUDED_CONTRACTS)
CONTRACT_SQL = rf"""
  (list_has_any(list_append(string_split_regex(trim(lower(coalesce(contract_type, ''))), '\s+'),
                            trim(lower(coalesce(contract_type, '')))), [{VOCABULARY_SQL}])
   OR regexp_matches(title,
        '(?i)\b(stages?|stagiaires?|alternan\w+|apprenti\w*|int[eé]rims?|cdd)\b'))"""


@query(f"WITH v AS ({views.ORDER_POSTINGS}) SELECT ingest_seq, title, contract_type FROM v "
       f"WHERE NOT {CONTRACT_SQL}")
def contract_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.exclude_contracts(order_postings(spark, sf)).select(
        "ingest_seq", "title", "contract_type")


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'Stage' WHEN 'error' THEN 'Intérim'
            WHEN 'click' THEN 'Freelance' END AS contract FROM events""")
def contract_canonical(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    kind = F.create_map(*map(F.lit, [
        "signup", "fulltime, Internship", "error", "temporary, contract", "click", "CONTRACT",
        "view", "fulltime"]))[df.event_type]
    return df.select("event_id", labels.canonical_contract(kind).alias("contract"))


RECENT = dt.datetime(1998, 7, 1, 12)


@query(f"WITH v AS ({views.ORDER_POSTINGS}) SELECT ingest_seq, posted_at FROM v WHERE posted_at "
       "BETWEEN DATE '1998-06-28' AND DATE '1998-07-01'")
def recency_days(spark: SparkSession, sf: str) -> DataFrame:
    return filters.recency_filter(
        order_postings(spark, sf), RECENT, days=defaults.RECENCY_DAYS
    ).select("ingest_seq", "posted_at")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-18 06:00:00' "
       "AND TIMESTAMP '2024-01-20 06:00:00'")
def recency_hours(spark: SparkSession, sf: str) -> DataFrame:
    return filters.recency_filter(
        table(spark, sf, "events"), dt.datetime(2024, 1, 20, 6), hours=defaults.RECENCY_HOURS,
        column="ts",
    ).select("event_id", "ts")


@query(f"WITH v AS ({views.ORDER_POSTINGS}) SELECT ingest_seq, title FROM v WHERE source IN "
       "('apec_rss', 'france_travail') AND (contains(lower(title), 'gear') OR "
       "contains(lower(title), 'red bolt'))")
def search_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.search_filter(
        order_postings(spark, sf), ["Gear", "red bolt"],
        isin={"source": ["apec_rss", "france_travail"]},
    ).select("ingest_seq", "title")


@query(f"WITH v AS ({views.ORDER_POSTINGS}) SELECT ingest_seq, source FROM v WHERE source LIKE "
       "'jobspy%' OR source = 'careers_site'")
def select_sources(spark: SparkSession, sf: str) -> DataFrame:
    return filters.select_sources(
        order_postings(spark, sf), ["jobspy", "careers_sites"]).select("ingest_seq", "source")


@query(f"WITH v AS ({views.DOC_POSTINGS}) SELECT ingest_seq, url FROM v WHERE source = "
       "'careers_site' AND coalesce(description, '') = ''")
def needs_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return filters.needs_enrichment(doc_postings(spark, sf)).select("ingest_seq", "url")


CAPS = {"jobspy_indeed": 1500, "france_travail": 1000, "apec_rss": 200}


@query(f"""WITH v AS ({views.ORDER_POSTINGS})
  SELECT source, ingest_seq FROM v
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY posted_at DESC, ingest_seq)
          <= CASE source WHEN 'jobspy_indeed' THEN 1500 WHEN 'france_travail' THEN 1000
             WHEN 'apec_rss' THEN 200 ELSE 1000000000 END""")
def row_cap(spark: SparkSession, sf: str) -> DataFrame:
    df = order_postings(spark, sf).select("source", "ingest_seq", "posted_at")
    return dedup.row_cap(
        df, ["source"], CAPS, [F.desc("posted_at"), F.asc("ingest_seq")]
    ).select("source", "ingest_seq")


GEO = """
  SELECT c_custkey, c_nationkey % 5 <> 0 AS localisable, c_mktsegment AS employer,
         47.2184 + CAST(c_custkey % 200 - 100 AS DOUBLE) / 90 AS latitude,
         -1.5536 + CAST(c_custkey % 17 - 8 AS DOUBLE) / 10 AS longitude,
         'Ville - ' || CAST(40 + c_nationkey % 10 AS STRING) AS place,
         CASE c_nationkey % 4 WHEN 0 THEN 'NANTES Nord' WHEN 1 THEN 'Lyon' WHEN 2 THEN NULL
           ELSE 'Sainte-Rezé' END AS city,
         CAST(43000 + c_custkey % 2000 AS STRING) AS postcode, c_acctbal < 0 AS remote
  FROM customer """
KM_SQL = """2 * 6371.0 * asin(sqrt(pow(sin(radians(latitude - 47.2184) / 2), 2)
  + cos(radians(47.2184)) * cos(radians(latitude)) * pow(sin(radians(longitude + 1.5536) / 2), 2)))"""
RADIUS_SQL = rf"""CASE WHEN localisable THEN {KM_SQL} <= 50
  ELSE regexp_extract(place, '(\d{{2,3}}|2[AB])\s*$', 1) = '44' END"""
PLACE_SQL = """(remote OR postcode LIKE '44%' OR coalesce(regexp_matches(lower(city),
  'nantes|saint-herblain|st-herblain|carquefou|ancenis|saint-nazaire|reze|rezé|orvault|vertou'),
  false))"""


def _geo(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, GEO, "customer")


@query(f"WITH g AS ({GEO}) SELECT c_custkey, round({KM_SQL}, 3) AS km, {RADIUS_SQL} AS in_zone "
       "FROM g")
def geo_radius(spark: SparkSession, sf: str) -> DataFrame:
    g = _geo(spark, sf)
    return g.select(
        "c_custkey", F.round(places.haversine_km(g.latitude, g.longitude), 3).alias("km"),
        places.in_radius(g.localisable, g.latitude, g.longitude, g.place).alias("in_zone"))


@query(f"WITH g AS ({GEO}) SELECT c_custkey FROM g WHERE {RADIUS_SQL}")
def zone_by_radius(spark: SparkSession, sf: str) -> DataFrame:
    df = _geo(spark, sf).withColumnRenamed("place", "location")
    return filters.zone_filter(df, "radius").select("c_custkey")


@query(f"WITH g AS ({GEO}) SELECT c_custkey FROM g WHERE {PLACE_SQL}")
def zone_by_place(spark: SparkSession, sf: str) -> DataFrame:
    return filters.zone_filter(_geo(spark, sf), "place").select("c_custkey")


@query(f"WITH g AS ({GEO}) SELECT employer, count(*) FILTER (WHERE {PLACE_SQL}) AS in_zone, "
       "count(*) AS scanned FROM g GROUP BY employer")
def zone_rate(spark: SparkSession, sf: str) -> DataFrame:
    g = _geo(spark, sf)
    return stats.zone_rate(g, places.in_zone(g.city, g.postcode, g.remote))


# --- scores ----------------------------------------------------------------------------------
@query(f"SELECT doc_id, {lexicon_sql('text', HARD)} AS hard, {lexicon_sql('text', SOFT)} AS soft "
       "FROM documents")
def lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    df = views.documents(spark, sf)
    return df.select("doc_id", lexicon.lexicon_score(df.text, HARD).alias("hard"),
                     lexicon.lexicon_score(df.text, SOFT).alias("soft"))


@query(f"SELECT doc_id, {lexicon_sql('text', HARD)} AS hard FROM documents")
def lexicon_score_by_token(spark: SparkSession, sf: str) -> DataFrame:
    df = views.documents(spark, sf).select("doc_id", "text")
    return lexicon.score_lexicon(df, "text", HARD, "hard", "doc_id").select(
        "doc_id", "hard")


LOCATION_SQL = f"""
  CASE WHEN remote_pct = 100 THEN 100
    WHEN contains(loc_h, 'nort-sur-erdre') THEN 100
    WHEN regexp_matches(loc_h, 'nantes|saint-herblain|reze|vertou|carquefou|orvault|'
      || 'saint-sebastien|bouguenais|la-chapelle-sur-erdre') THEN 90
    WHEN regexp_matches(loc_h, 'ancenis|clisson|chateaubriant|saint-nazaire|pornic|blain|guerande')
      THEN 75
    WHEN regexp_matches(loc, '^44\\s*-|\\b44\\d{{3}}\\b') OR contains(loc_h, 'loire-atlantique')
      THEN 60
    WHEN regexp_extract(loc, '\\b(\\d{{5}})\\b', 1) <> ''
      AND regexp_extract(loc, '\\b(\\d{{5}})\\b', 1) NOT LIKE '44%' THEN 30
    WHEN remote_pct >= 50 THEN 70
    WHEN source IN ('france_travail', 'apec_rss', 'careers_site') THEN 75 ELSE 50 END"""
LOCATED = f"""SELECT *, replace(loc, ' ', '-') AS loc_h FROM (
  SELECT *, {norm('location')} AS loc FROM ({views.DOC_POSTINGS}))"""


@query(f"WITH v AS ({LOCATED}) SELECT ingest_seq, {LOCATION_SQL} AS location_score FROM v")
def location_score(spark: SparkSession, sf: str) -> DataFrame:
    return score.score_location(doc_postings(spark, sf)).select("ingest_seq", "location_score")


TITLE_TARGETS = ["gear", "technicien red bolt", "large gizmo", "Old  Ring (F/H)"]


@query(f"""WITH v AS ({views.ORDER_POSTINGS})
  SELECT ingest_seq, title_match FROM v LEFT JOIN
    {fuzzy_sql(TITLE_TARGETS, ["technicien {}", "{}", "{} cdd"])} ON title_norm = {norm('title')}""")
def title_match(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_titles(order_postings(spark, sf), TITLE_TARGETS).select(
        "ingest_seq", "title_match")


@query(f"""WITH v AS (SELECT DISTINCT {norm('title')} AS title_norm FROM ({views.ORDER_POSTINGS}))
  SELECT title_norm, title_match FROM v LEFT JOIN
    {fuzzy_sql(TITLE_TARGETS, ["technicien {}", "{}", "{} cdd"])} USING (title_norm)""")
def title_lookup(spark: SparkSession, sf: str) -> DataFrame:
    df = order_postings(spark, sf)
    return match.title_lookup(df.select(normalize(df.title).alias("title_norm")), TITLE_TARGETS)


ORDER_MATCH_SQL = f"""WITH v AS ({views.ORDER_POSTINGS}), e AS ({SEGMENT_EMPLOYERS}),
  {match_sql('v', 'e')},
  m AS (SELECT v.*, employer, employer_tier FROM v LEFT JOIN em
        ON em.company_norm = {norm('v.company')})"""


def _matched_orders(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_employer(order_postings(spark, sf), views.segment_employers(spark, sf))


@query(ORDER_MATCH_SQL + f""" SELECT ingest_seq, employer, employer_tier, {TIER_SQL} AS tier_score
  FROM m""")
def employer_match(spark: SparkSession, sf: str) -> DataFrame:
    m = _matched_orders(spark, sf)
    return m.select("ingest_seq", "employer", "employer_tier",
                    match.tier_score(m.employer_tier).alias("tier_score"))


TEXT_SQL = "title || chr(10) || coalesce(description, '')"
SCORED_SQL = f"""WITH v AS ({LOCATED}), e AS ({SUPPLIER_EMPLOYERS}), {match_sql('v', 'e')},
  parts AS (
    SELECT v.*, employer, employer_tier, title_match, {LOCATION_SQL} AS location_score,
           {lexicon_sql(TEXT_SQL, HARD)} AS hard_skills, {lexicon_sql(TEXT_SQL, SOFT)} AS soft_skills,
           {TIER_SQL} AS tier_score
    FROM v LEFT JOIN em ON em.company_norm = {norm('company')} LEFT JOIN
      {fuzzy_sql(TARGETS, ["chef de projet {}", "{}", "stage {}", "data engineer - {}"])}
      ON title_norm = {norm('title')}),
  s AS (SELECT *, CAST(format('{{:.1f}}',
      CAST(0.25 AS DOUBLE) * hard_skills + CAST(0.3 AS DOUBLE) * title_match
      + CAST(0.1 AS DOUBLE) * soft_skills + CAST(0.2 AS DOUBLE) * location_score
      + CAST(0.15 AS DOUBLE) * tier_score) AS DOUBLE) AS score,
    coalesce(nullif(concat_ws(', ', 'P' || employer_tier || ' cible',
      CASE WHEN location_score >= 90 THEN coalesce(nullif(trim(split_part(location, ',', 1)), ''), chr(1))
        END,
      CASE WHEN title_match = 100 THEN 'titre exact' WHEN hard_skills >= 50 THEN 'skills forts'
        END), ''), 'hors-liste à valider') AS reason0 FROM parts),
  scored AS (SELECT *, replace(reason0, chr(1), '') AS match_reason FROM s),
  kept AS (SELECT * FROM scored WHERE score >= CASE WHEN employer_tier = 1 THEN {MIN_TIER1}
           ELSE {MIN_SCORE} END)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return score.score_postings(
        doc_postings(spark, sf), views.supplier_employers(spark, sf), TARGETS, HARD, SOFT)


def _retained(spark: SparkSession, sf: str) -> DataFrame:
    return score.retain(_scored(spark, sf), MIN_SCORE, MIN_TIER1)


@query(SCORED_SQL + """ SELECT ingest_seq, hard_skills, title_match, soft_skills, location_score,
  tier_score, score, employer, employer_tier, match_reason FROM scored""")
def scored_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "ingest_seq", "hard_skills", "title_match", "soft_skills", "location_score", "tier_score",
        "score", "employer", "employer_tier", "match_reason")


@query(SCORED_SQL + " SELECT ingest_seq, score, employer_tier FROM kept "
       "ORDER BY score DESC, ingest_seq")
def retained_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return score.rank(_retained(spark, sf)).select("ingest_seq", "score", "employer_tier")


@query(SCORED_SQL + " SELECT ingest_seq, title, score, match_reason FROM kept "
       "ORDER BY score DESC, ingest_seq LIMIT 3")
def top_offers(spark: SparkSession, sf: str) -> DataFrame:
    return score.top(_retained(spark, sf), 3).select("ingest_seq", "title", "score", "match_reason")


# --- publishing ------------------------------------------------------------------------------
RUN_DATE = dt.date(2024, 2, 15)
OFFER_SQL = f"""
  SELECT '15/02/2024' AS found_on,
    CASE WHEN employer_tier IS NOT NULL THEN company || ' (P' || employer_tier || ')' ELSE company
      END AS employer,
    title, coalesce(nullif(location, ''), 'n.c.') AS location,
    coalesce(nullif(contract_type, ''), 'n.c.') AS contract,
    CASE WHEN salary_min <> 0 AND salary_max <> 0 THEN salary_min || '–' || salary_max || ' k€'
      WHEN salary_min <> 0 THEN salary_min || ' k€+' ELSE 'n.c.' END AS salary,
    CASE WHEN posted_at IS NULL THEN 'récent'
      WHEN greatest(0, DATE '2024-02-15' - posted_at) <= 1 THEN '1 jour'
      ELSE (DATE '2024-02-15' - posted_at) || ' jours' END AS age,
    url,
    CASE source WHEN 'careers_site' THEN 'Site officiel ' || company WHEN 'jobspy_indeed' THEN 'Indeed'
      WHEN 'jobspy_glassdoor' THEN 'Glassdoor' WHEN 'jobspy_google' THEN 'Google Jobs'
      WHEN 'jobspy_linkedin' THEN 'LinkedIn' WHEN 'france_travail' THEN 'France Travail'
      WHEN 'apec_rss' THEN 'APEC' ELSE source END AS source,
    match_reason AS reason, 'Nouvelle' AS status, round_even(score, 0) / 100 AS compat"""


@query(SCORED_SQL + OFFER_SQL + " FROM kept")
def offer_rows(spark: SparkSession, sf: str) -> DataFrame:
    return publish.offer_rows(_retained(spark, sf), RUN_DATE)


PUBLISHED = """
  SELECT 'Groupe ' || s.s_name || ' (P1) — relu' AS employer, p.p_name AS title,
         'https://jobs.example.org/' || CAST(p.p_partkey * 7 AS STRING) AS url
  FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey % (SELECT count(*) FROM supplier )"""
FRESH_SQL = f"""o AS ({PUBLISHED}),
  f AS (SELECT *, {clean_sql('company')} AS ce, {norm('title')} AS nt FROM v
        WHERE url NOT IN (SELECT url FROM o)
          AND ({clean_sql('company')} || '|' || {norm('title')}) NOT IN
              (SELECT {clean_sql('employer')} || '|' || {norm('title')} FROM o))"""


def _published(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, PUBLISHED, "part", "supplier")


@query(f"WITH v AS ({views.DOC_POSTINGS}), {FRESH_SQL} SELECT ingest_seq, url, title FROM f")
def not_yet_published(spark: SparkSession, sf: str) -> DataFrame:
    return publish.not_yet_published(
        doc_postings(spark, sf), _published(spark, sf)).select("ingest_seq", "url", "title")


def greedy_sql(rows: str) -> str:
    """Sequential acceptance of rows by score, as a recursion over one row at a time."""
    return f"""
  k AS (SELECT *, row_number() OVER (ORDER BY score DESC, ingest_seq) AS rn,
               ce || '|' || nt AS pair FROM {rows}),
  g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS urls,
               CAST([] AS VARCHAR[]) AS pairs, false AS ok
        UNION ALL
        SELECT k.rn, CASE WHEN a THEN list_append(urls, k.url) ELSE urls END,
               CASE WHEN a THEN list_append(pairs, k.pair) ELSE pairs END, a
        FROM (SELECT g.*, k.*, NOT list_contains(g.urls, k.url)
                     AND NOT list_contains(g.pairs, k.pair) AS a
              FROM g JOIN (SELECT rn AS krn, url, pair FROM k) k ON k.krn = g.rn + 1) q
        JOIN k ON k.rn = q.krn)"""


SCORED_DOCS = f"""SELECT *, CAST(ingest_seq * 37 % 1000 AS DOUBLE) / 10 AS score
  FROM ({views.DOC_POSTINGS})"""


def _with_score(spark: SparkSession, sf: str) -> DataFrame:
    return doc_postings(spark, sf).selectExpr(
        "*", "CAST(ingest_seq * 37 % 1000 AS DOUBLE) / 10 AS score")


@query(f"""WITH RECURSIVE v AS ({SCORED_DOCS}), {FRESH_SQL}, {greedy_sql('f')}
  SELECT k.ingest_seq, k.url, k.score FROM g JOIN k ON k.rn = g.rn WHERE g.ok""")
def append_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return publish.select_offers(
        _with_score(spark, sf), _published(spark, sf)).select("ingest_seq", "url", "score")


@query(f"""WITH RECURSIVE v AS ({SCORED_DOCS}),
  f AS (SELECT *, {clean_sql('company')} AS ce, {norm('title')} AS nt FROM v), {greedy_sql('f')}
  SELECT k.url, k.company AS employer, k.title, round_even(k.score, 0) / 100 AS compat
  FROM g JOIN k ON k.rn = g.rn WHERE g.ok""")
def append_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Through the stored table, appended twice: the second time changes nothing."""
    offers = publish.OfferTable(spark, scratch_path(spark, "offers"))
    batch = _with_score(spark, sf).selectExpr(
        "*", "cast(null as int) as employer_tier", "'x' as match_reason")
    offers.append(batch, 1, RUN_DATE)
    offers.append(batch, 2, RUN_DATE)
    return offers.read().select("url", "employer", "title", "compat")


TRACKER = """
  SELECT c_custkey AS row_id, c_name || ' (P1)' AS employer,
         CASE c_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'À cibler' WHEN 2 THEN 'Entretien'
           WHEN 3 THEN NULL ELSE 'a cibler !' END AS status,
         'avant' AS last_action, 'après' AS next_action
  FROM customer """
TOUCHED_SQL = """t AS (SELECT DISTINCT employer FROM m
  WHERE employer_tier IS NOT NULL)"""


@query(ORDER_MATCH_SQL + f", {TOUCHED_SQL} SELECT employer FROM t")
def touched_employers(spark: SparkSession, sf: str) -> DataFrame:
    return publish.touched_employers(_matched_orders(spark, sf))


@query(ORDER_MATCH_SQL + f""", {TOUCHED_SQL}, tr AS ({TRACKER}),
  ch AS (SELECT tr.*, coalesce({norm('status')}, '') IN ('', 'a cibler')
           AND coalesce(replace(tr.employer, ' (P1)', '') IN (SELECT employer FROM t), false)
           AS changed FROM tr)
  SELECT row_id, employer, CASE WHEN changed THEN 'Offre repérée' ELSE status END AS status,
    CASE WHEN changed THEN 'Offre détectée le 15/02/2024' ELSE last_action END AS last_action,
    CASE WHEN changed THEN 'Analyser l''offre + postuler' ELSE next_action END AS next_action,
    changed FROM ch""")
def employer_status(spark: SparkSession, sf: str) -> DataFrame:
    touched = publish.touched_employers(_matched_orders(spark, sf))
    return publish.update_employer_status(
        views.view(spark, sf, TRACKER, "customer"), touched,
        views.segment_employers(spark, sf), RUN_DATE)


STATUS_SQL = """SELECT CASE o_orderstatus WHEN 'F' THEN 'refus' WHEN 'O' THEN 'a cibler'
  ELSE 'en cours' END AS s, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1"""


@query(f"""WITH c AS ({STATUS_SQL})
  SELECT ord, label, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES
    (0, 'À cibler', 'a cibler'), (1, 'Offre repérée', ''), (2, 'Candidature envoyée', ''),
    (3, 'En cours', 'en cours'), (4, 'Entretien', ''), (5, 'Relance', ''), (6, 'Stand-by', ''),
    (7, 'Refus', 'refus')) AS l(ord, label, s) LEFT JOIN c USING (s)
  UNION ALL SELECT 8, 'Total cibles', CAST(sum(n) AS BIGINT) FROM c""")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    tracker = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE 'c' || o_custkey END AS employer",
        "CASE o_orderstatus WHEN 'F' THEN 'REFUS' WHEN 'O' THEN 'À cibler' ELSE ' En cours.' END "
        "AS status")
    return stats.status_counts(tracker)


LOGICAL_SQL = """CASE WHEN source LIKE 'jobspy%' THEN 'jobspy' WHEN source = 'apec_rss' THEN 'apec'
  WHEN source = 'careers_site' THEN 'careers_sites' ELSE source END"""
RUN_SOURCES = ["jobspy", "apec", "careers_sites"]


@query(f"""WITH v AS ({views.ORDER_POSTINGS}),
  c AS (SELECT {LOGICAL_SQL} AS source, count(*) AS n FROM v WHERE NOT {CONTRACT_SQL} GROUP BY 1)
  SELECT ord, source, coalesce(n, 0) AS n, source <> 'apec' AS ok FROM (VALUES (0, 'jobspy'),
    (1, 'france_travail'), (2, 'apec'), (3, 'careers_sites')) AS l(ord, source)
  LEFT JOIN c USING (source)""")
def source_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.source_stats(
        filters.exclude_contracts(order_postings(spark, sf)), errored=["apec"])


@query(f"""WITH v AS ({views.ORDER_POSTINGS}),
  old AS (SELECT {LOGICAL_SQL} AS source, CAST(count(*) AS STRING) AS n FROM v
          WHERE posted_at < DATE '{SPLIT_DAY}' AND source <> 'apec_rss' GROUP BY 1),
  run AS (SELECT {LOGICAL_SQL} AS source, CAST(count(*) AS STRING) AS n FROM v
          WHERE posted_at >= DATE '{SPLIT_DAY}' GROUP BY 1)
  SELECT ord, label,
    CASE WHEN source = 'france_travail' THEN coalesce(old.n, '') ELSE coalesce(run.n, '0') END AS n,
    CASE source WHEN 'france_travail' THEN 'OK' WHEN 'careers_sites' THEN 'NOK' ELSE 'OK' END
      AS ok_label,
    CASE source WHEN 'france_travail' THEN '31/12/1997' WHEN 'careers_sites' THEN '31/12/1997'
      ELSE '15/02/2024' END AS last_ok
  FROM (VALUES (0, 'jobspy', 'jobspy (Indeed / Google)'), (1, 'france_travail', 'France Travail'),
    (2, 'apec', 'APEC (RSS)'), (3, 'careers_sites', 'Sites carrières')) AS l(ord, source, label)
  LEFT JOIN old USING (source) LEFT JOIN run USING (source)""")
def source_status(spark: SparkSession, sf: str) -> DataFrame:
    df = order_postings(spark, sf)
    old = stats.source_stats(
        df.filter((df.posted_at < SPLIT_DAY) & (df.source != "apec_rss")))
    label = F.create_map(*[F.lit(x) for kv in defaults.LOGICAL_SOURCE_LABELS.items() for x in kv])
    previous = old.filter("source <> 'apec'").select(
        label[old.source].alias("label"), old.n.cast("string").alias("n"),
        F.lit("OK").alias("ok_label"), F.lit("31/12/1997").alias("last_ok"))
    run = stats.source_stats(
        df.filter(df.posted_at >= SPLIT_DAY), RUN_SOURCES, errored=["careers_sites"])
    return publish.source_status(previous, run, RUN_DATE)


@query(SPLIT_SQL + """ SELECT count(*) AS collected, count(*) FILTER (WHERE is_known) AS already_seen,
  count(*) FILTER (WHERE NOT is_known) AS new,
  count(*) FILTER (WHERE NOT is_known AND salary_min >= 50) AS retained,
  count(*) FILTER (WHERE NOT is_known AND salary_min >= 80) AS appended FROM b""")
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    seen, batch = _seen_and_batch(spark, sf)
    flagged = state.flag_known(batch, seen)
    return stats.funnel(flagged.selectExpr(
        "is_known", "not is_known and salary_min >= 50 as is_retained",
        "not is_known and salary_min >= 80 as is_appended"))


@query(SCORED_SQL + """, l AS (SELECT score, ingest_seq, format('[{:5.1f}] {} — {} ({}) | '
    || 'hard {:.0f} · titre {:.0f} · soft {:.0f} · loc {:.0f} · tier {:.0f} → {} | {}', score, title,
    company, coalesce(nullif(location, ''), 'lieu n.c.'), CAST(hard_skills AS DOUBLE),
    title_match, CAST(soft_skills AS DOUBLE), CAST(location_score AS DOUBLE),
    CAST(tier_score AS DOUBLE), match_reason, url) AS line
    FROM kept ORDER BY score DESC, ingest_seq LIMIT 3)
  SELECT (SELECT count(*) FROM scored) AS collected, (SELECT count(*) FROM kept) AS retained,
    (SELECT string_agg(line, chr(10) ORDER BY score DESC, ingest_seq) FROM l) AS top,
    greatest(0, (SELECT count(*) FROM kept) - 3) AS others,
    'apec : collecte échouée — délai' AS alerts""")
def daily_report(spark: SparkSession, sf: str) -> DataFrame:
    retained = _retained(spark, sf)
    totals = stats.merge_rows(
        stats.count_rows(doc_postings(spark, sf), "collected"),
        stats.count_rows(retained, "retained"))
    report = stats.daily_report(totals, retained, alerts=["apec : collecte échouée — délai"])
    return report.withColumns({c: F.array_join(c, "\n") for c in ("top", "alerts")})


@query(f"""WITH v AS ({views.DOC_POSTINGS})
  SELECT ingest_seq, title, CASE WHEN description <> '' THEN substr(description, 1, 150) || '…'
    ELSE description END AS description FROM v ORDER BY ingest_seq LIMIT 3""")
def sample_head(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sample_head(doc_postings(spark, sf)).select("ingest_seq", "title", "description")


# --- salaries and dates ----------------------------------------------------------------------
@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN round_even(o_totalprice / 1000, 0)
    WHEN o_orderstatus = 'O' THEN round_even(o_totalprice * 12 / 1000, 0) END AS INT) AS keur
  FROM orders""")
def salary_interval(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders")
    kind = F.when(df.o_orderstatus == "F", "Yearly").when(df.o_orderstatus == "O", "monthly")
    amount = F.concat(F.lit(" "), df.o_totalprice.cast("string"))
    return df.select("o_orderkey", numbers.to_keur(amount, kind.otherwise("hourly")).alias("keur"))


LABELS = """
  SELECT o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'Annuel de ' || replace(CAST(o_totalprice AS STRING), '.', ',')
        || ' Euros à ' || CAST(CAST(floor(o_totalprice / 2) AS INT) AS STRING)
        || ' Euros sur 12 mois'
      WHEN 'O' THEN 'Mensuel de ' || CAST(CAST(floor(o_totalprice / 40) AS INT) AS STRING)
        || ',5 Euros, prime 12 000 ou 13' ELSE 'Horaire de 15 Euros' END AS label,
    CASE o_orderstatus WHEN 'F' THEN CAST(CAST(floor(o_totalprice / 2000) AS INT) AS STRING)
        || ' - ' || CAST(CAST(floor(o_totalprice / 1500) AS INT) AS STRING) || ',5 k€ brut annuel'
      WHEN 'O' THEN 'A partir de ' || CAST(CAST(floor(o_totalprice / 4000) AS INT) AS STRING)
        || ' KEUR' ELSE 'Selon profil 40 50' END AS keur_label
  FROM orders """


def range_sql(numbers_of: str) -> str:
    """Minimum and maximum of the first two values within 15 and 200."""
    return f"""SELECT o_orderkey, CAST(list_min(p) AS INT) AS salary_min,
      CAST(CASE WHEN len(p) > 1 THEN list_max(p) END AS INT) AS salary_max
      FROM (SELECT o_orderkey, list_slice(list_filter({numbers_of},
              lambda x: x BETWEEN 15 AND 200), 1, 2) AS p FROM l)"""


@query(f"WITH l AS ({LABELS}) " + range_sql(r"""
    CASE WHEN contains(label, 'Horaire') THEN CAST([] AS DOUBLE[]) ELSE
      list_transform(regexp_extract_all(label, '\d[\d\s]*(?:[.,]\d+)?'), lambda n:
        round_even(CAST(replace(regexp_replace(n, '\s', '', 'g'), ',', '.') AS DOUBLE)
        * CASE WHEN contains(label, 'Annuel') THEN 1 ELSE 12 END / 1000, 0)) END"""))
def salary_label(spark: SparkSession, sf: str) -> DataFrame:
    df = spread(views.view(spark, sf, LABELS, "orders"), "o_orderkey")
    return df.withColumn("r", numbers.salary_from_label(df.label)).select(
        "o_orderkey", "r.salary_min", "r.salary_max")


@query(f"WITH l AS ({LABELS}) " + range_sql(r"""
    CASE WHEN contains(keur_label, 'profil') THEN CAST([] AS DOUBLE[]) ELSE
      list_transform(regexp_extract_all(keur_label, '\d+(?:[.,]\d+)?'), lambda n:
        round_even(CAST(replace(n, ',', '.') AS DOUBLE), 0)) END"""))
def salary_keur(spark: SparkSession, sf: str) -> DataFrame:
    df = spread(views.view(spark, sf, LABELS, "orders"), "o_orderkey")
    return df.withColumn("r", numbers.salary_from_keur_label(df.keur_label)).select(
        "o_orderkey", "r.salary_min", "r.salary_max")


_MONTH = "CASE month(o_orderdate) " + " ".join(
    f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(dates.FRENCH_MONTHS)) + " END"
DATES = f"""
  SELECT o_orderkey, o_orderdate,
    CASE WHEN o_orderkey % 10 = 3 THEN 'inconnu' ELSE CAST(o_orderdate AS STRING) || 'Z' END AS iso,
    CASE WHEN o_orderkey % 10 = 4 THEN '31 février 2024 puis ' WHEN o_orderkey % 10 = 5
      THEN '3 foo 2024, ' ELSE 'Publié le ' END || CAST(day(o_orderdate) AS STRING) || ' '
      || {_MONTH} || '  ' || CAST(year(o_orderdate) AS STRING) AS french,
    CASE WHEN o_orderkey % 10 = 6 THEN '31/02/2024 ' ELSE 'le ' END
      || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/'
      || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/'
      || CAST(year(o_orderdate) AS STRING) AS slash
  FROM orders """


@query(rf"""WITH d AS ({DATES})
  SELECT o_orderkey, try_cast(substr(iso, 1, 10) AS DATE) AS iso_date,
    CASE WHEN o_orderkey % 10 NOT IN (4, 5) THEN CAST(o_orderdate AS DATE) END AS french_date,
    CAST(try_strptime(regexp_extract(slash, '\d{{2}}/\d{{2}}/\d{{4}}'), '%d/%m/%Y') AS DATE)
      AS slash_date,
    CAST(o_orderdate AS DATE) AS epoch_date FROM d""")
def posted_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(views.view(spark, sf, DATES, "orders"), "o_orderkey")
    millis = F.unix_millis(d.o_orderdate.cast("timestamp")).cast("string")
    return d.select(
        "o_orderkey", dates.iso_date(d.iso).alias("iso_date"),
        dates.french_date(d.french).alias("french_date"),
        dates.slash_date(d.slash).alias("slash_date"),
        dates.epoch_ms_date(millis).alias("epoch_date"))


# --- whole runs ------------------------------------------------------------------------------
@query()
def daily_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over the documents as postings; the report of the second."""
    df = doc_postings(spark, sf)
    seen = state.SeenLog(spark, scratch_path(spark, "seen"))
    offers = publish.OfferTable(spark, scratch_path(spark, "offers"))
    half = df.filter("posted_at < date '2024-01-20' or posted_at is null")
    for run, batch in enumerate([half, df]):
        result = daily_run(
            batch, views.supplier_employers(spark, sf), seen, offers, run, RUN_DATE,
            targets=TARGETS, min_score=MIN_SCORE, min_score_tier1=MIN_TIER1, hard=HARD, soft=SOFT)
    return result.report.withColumns({c: F.array_join(c, "\n") for c in ("top", "alerts")})


@query()
def stream_new_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a landing stream; the offers it published."""
    landing = scratch_path(spark, "landing")
    df = doc_postings(spark, sf)
    df.write.parquet(landing)
    offers = publish.OfferTable(spark, scratch_path(spark, "offers"))
    runs.stream_new_postings(
        spark.readStream.schema(df.schema).parquet(landing),
        views.supplier_employers(spark, sf), state.SeenLog(spark, scratch_path(spark, "seen")),
        offers, scratch_path(spark, "stream-check"), lambda batch, i: RUN_DATE,
        targets=TARGETS, min_score=MIN_SCORE, min_score_tier1=MIN_TIER1, hard=HARD, soft=SOFT,
    ).awaitTermination()
    return offers.read().select("url", "employer", "title", "reason", "compat")
