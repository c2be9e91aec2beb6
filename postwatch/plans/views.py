"""Posting tables derived from the driver tables, for the registered queries.

The select lists below are plain SQL that both Spark and the checking engine understand; they
only shape inputs, the operators under test are applied on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postwatch.session import spread

# Documents as postings: long texts, few companies.
DOC_POSTINGS = """
  SELECT CASE d.doc_id % 7 WHEN 0 THEN 'jobspy_indeed' WHEN 1 THEN 'france_travail'
           WHEN 2 THEN 'apec_rss' WHEN 3 THEN 'careers_site' WHEN 4 THEN 'jobspy_google'
           WHEN 5 THEN 'jobspy_linkedin' ELSE 'jobspy_glassdoor' END AS source,
         CAST(d.doc_id AS STRING) AS external_id,
         CASE d.doc_id % 6 WHEN 0 THEN 'Chef de Projet ' || p.p_name || ' (H/F)'
           WHEN 1 THEN upper(p.p_name) || '  F/H' WHEN 2 THEN 'Stage ' || p.p_name
           WHEN 3 THEN 'Data Engineer - ' || p.p_name WHEN 4 THEN p.p_name || ' !'
           ELSE p.p_name END AS title,
         CASE d.doc_id % 3 WHEN 0 THEN s.s_name WHEN 1 THEN upper(s.s_name) || ' Group'
           ELSE 'Groupe ' || s.s_name || ' (P1)' END AS company,
         CASE d.doc_id % 8 WHEN 0 THEN '44 - NANTES' WHEN 1 THEN 'Nort-sur-Erdre'
           WHEN 2 THEN 'Ancenis, France' WHEN 3 THEN '44 - SAVENAY'
           WHEN 4 THEN '33000 ' || n.n_name WHEN 5 THEN n.n_name WHEN 6 THEN ''
           ELSE 'Saint Herblain, ' || n.n_name END AS location,
         CASE d.doc_id % 5 WHEN 0 THEN 'CDI' WHEN 1 THEN 'CDD' WHEN 2 THEN NULL
           WHEN 3 THEN 'fulltime contract' ELSE 'permanent' END AS contract_type,
         CAST(CASE WHEN d.doc_id % 4 < 2 THEN floor(p.p_retailprice / 25) END AS INT) AS salary_min,
         CAST(CASE WHEN d.doc_id % 4 = 0 THEN floor(p.p_retailprice / 20) END AS INT) AS salary_max,
         CAST(CASE d.doc_id % 11 WHEN 0 THEN 100 WHEN 1 THEN 50 END AS INT) AS remote_pct,
         CASE WHEN d.doc_id % 9 <> 0 THEN d.text END AS description,
         'https://jobs.example.org/' || CAST(d.doc_id % 700 AS STRING) AS url,
         CASE WHEN d.doc_id % 10 <> 0 THEN DATE '2024-01-01' + CAST(d.doc_id % 40 AS INT) END
           AS posted_at,
         CAST(NULL AS STRING) AS raw,
         d.doc_id AS ingest_seq
  FROM documents d JOIN part p ON p.p_partkey = d.doc_id
       JOIN supplier s ON s.s_suppkey = d.doc_id % (SELECT count(*) FROM supplier )
       JOIN nation n ON n.n_nationkey = d.doc_id % (SELECT count(*) FROM nation )
"""

# Orders as postings: many rows and companies, no texts.
ORDER_POSTINGS = """
  SELECT CASE o.o_orderpriority WHEN '1-URGENT' THEN 'jobspy_indeed'
           WHEN '2-HIGH' THEN 'france_travail' WHEN '3-MEDIUM' THEN 'apec_rss'
           WHEN '5-LOW' THEN 'careers_site' ELSE 'jobspy_google' END AS source,
         CAST(o.o_orderkey AS STRING) AS external_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'Technicien ' || p.p_name || ' (F/H)'
           WHEN 'P' THEN upper(p.p_name) || '.' ELSE p.p_name || ' CDD' END AS title,
         CASE o.o_orderkey % 3 WHEN 0 THEN c.c_name WHEN 1 THEN upper(c.c_name) || ' Group'
           ELSE 'Groupe ' || c.c_name || ' (P2) — site officiel' END AS company,
         'NATION_' || CAST(c.c_nationkey AS STRING) AS location,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'CDI' WHEN 'MACHINERY' THEN 'Intérim'
           WHEN 'FURNITURE' THEN ' full  MISSION ' WHEN 'AUTOMOBILE' THEN NULL
           ELSE 'permanent' END AS contract_type,
         CAST(floor(o.o_totalprice / 5000) AS INT) AS salary_min,
         CAST(CASE WHEN o.o_orderstatus <> 'O' THEN floor(o.o_totalprice / 4000) END AS INT)
           AS salary_max,
         CAST(NULL AS INT) AS remote_pct,
         CAST(NULL AS STRING) AS description,
         'https://jobs.example.org/' || CAST(o.o_custkey AS STRING) || '/' || o.o_orderstatus
           AS url,
         CAST(o.o_orderdate AS DATE) AS posted_at,
         CAST(NULL AS STRING) AS raw,
         o.o_orderkey AS ingest_seq
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
       JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part )
"""

# Events as the run-by-run feed: one run per day, a fingerprint per user and event type.
SIGHTINGS = """
  SELECT CAST(e.user_id AS STRING) || '-' || e.event_type AS fingerprint,
         CAST(e.ts AS DATE) AS run_date, e.event_id AS ingest_seq,
         e.event_type AS source, 'u' || CAST(e.event_id AS STRING) AS url,
         e.props AS title, CAST(e.user_id AS STRING) AS company
  FROM events e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(
        _bind(sql, tables), **{name: table(spark, sf_dir, name) for name in tables}
    )


def _bind(sql: str, tables: tuple[str, ...]) -> str:
    """Point FROM and JOIN at the DataFrames passed to spark.sql."""
    for name in tables:
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ")
        sql = sql.replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        view(spark, sf_dir, DOC_POSTINGS, "documents", "part", "supplier", "nation"), "ingest_seq"
    )


def order_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        view(spark, sf_dir, ORDER_POSTINGS, "orders", "customer", "part"), "ingest_seq"
    )


def event_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SIGHTINGS + " ", "events")


def supplier_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the employer dimension."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as int) as ord", "s_name as name", "cast(s_suppkey % 3 + 1 as int) as tier",
        "cast(null as string) as sector", "cast(null as string) as careers_url",
        "array(concat('Maison ', s_name)) as aliases", "cast(null as string) as ats",
        "cast(null as string) as link_pattern",
    )


def segment_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a larger employer dimension."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as int) as ord", "c_name as name", "cast(c_custkey % 3 + 1 as int) as tier",
        "cast(null as string) as sector", "cast(null as string) as careers_url",
        "array('Maison ' || c_name) as aliases", "cast(null as string) as ats",
        "cast(null as string) as link_pattern",
    )
