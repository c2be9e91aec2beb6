"""Landed JSON payloads to postings, one mapper per payload shape.

Input: one row per fetched page (page_seq bigint, body string and, for employer career sites,
employer string, careers_url string), read with an explicit schema.  Each mapper returns the
mapped rows with a reject column: null for a usable posting, else the reason.  `accepted` and
`quarantine` split on it.  Fields that are null or missing are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch import schema
from postwatch.functions import dates, labels, numbers, places
from postwatch.functions.order import page_order
from postwatch.functions.text import clean, or_default, strip
from postwatch.plans import defaults
from postwatch.schema import POSTING_COLUMNS
from postwatch.sources.html import html_nodes, sql_text


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) == ""


def _trimmed(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit(""))


def _reject(*rules: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(condition, reason).otherwise(out)
    return out


def keep_raw(item: Column, drop: tuple[str, ...] = ()) -> Column:
    """The payload item as JSON text, without the named fields."""
    return F.to_json(item.dropFields(*drop) if drop else item)


def parse_pages(pages: DataFrame, page_schema: str, items: str | None) -> DataFrame:
    """One row per item of the page's array, in arrival order (ingest_seq)."""
    parsed = pages.withColumn("_page", F.from_json("body", page_schema)).drop("body")
    array = F.col("_page") if items is None else F.col("_page")[items]
    keep = [c for c in parsed.columns if c != "_page"]
    return parsed.select(*keep, F.posexplode(array).alias("_pos", "item")).withColumn(
        "ingest_seq", page_order(F.col("page_seq"), F.col("_pos"))
    )


def _postings(df: DataFrame, reject: Column, **columns: Column) -> DataFrame:
    null = F.lit(None)
    values = {
        "location": F.lit(""),
        "contract_type": null,
        "salary_min": null,
        "salary_max": null,
        "remote_pct": null,
        "description": null,
        "posted_at": null,
        **columns,
        "ingest_seq": F.col("ingest_seq"),
    }
    typed = [
        values[name].cast(kind).alias(name)
        for name, kind in (field.split() for field in schema.POSTINGS.split(","))
    ]
    return df.select(*typed, reject.alias("reject"))


def accepted(mapped: DataFrame) -> DataFrame:
    return mapped.filter("reject is null").select(POSTING_COLUMNS)


def quarantine(mapped: DataFrame) -> DataFrame:
    """Rows that cannot be used, with their reason."""
    return mapped.filter("reject is not null")


def quarantine_counts(mapped: DataFrame) -> DataFrame:
    return quarantine(mapped).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


def map_board_rows(df: DataFrame) -> DataFrame:
    """Job-board rows (BOARD_ROWS columns and ingest_seq)."""
    site = clean(df.site)
    source = F.coalesce(*[
        F.when(site == name, F.lit(value)) for name, value in defaults.BOARD_SITES.items()
    ])
    url = clean(df.job_url)
    item = F.struct(*[c for c in df.columns if c != "ingest_seq"])
    return _postings(
        df,
        _reject((source.isNull(), "unknown site"), (url.isNull(), "no url")),
        source=source,
        external_id=F.coalesce(clean(df.id), url),
        title=F.coalesce(clean(df.title), F.lit("(sans titre)")),
        company=F.coalesce(clean(df.company), F.lit("Anonyme")),
        location=F.coalesce(clean(df.location), F.lit("")),
        contract_type=labels.canonical_contract(clean(df.job_type)),
        salary_min=numbers.to_keur(df.min_amount, clean(df["interval"])),
        salary_max=numbers.to_keur(df.max_amount, clean(df["interval"])),
        remote_pct=F.when(df.is_remote, 100),
        description=clean(df.description),
        url=url,
        posted_at=dates.iso_date(df.date_posted),
        raw=keep_raw(item),
    )


def map_public_employment_offers(pages: DataFrame) -> DataFrame:
    """Public employment service: resultats[]."""
    df = parse_pages(pages, schema.PUBLIC_EMPLOYMENT_PAGE, "resultats")
    o = F.col("item")
    salary = numbers.salary_from_label(F.coalesce(o["salaire"]["libelle"], F.lit("")))
    built = F.concat(
        F.lit("https://candidat.francetravail.fr/offres/recherche/detail/"), o["id"]
    )
    time = F.lower(F.coalesce(o["dureeTravailLibelleConverti"], F.lit("")))
    return _postings(
        df,
        _reject((_blank(o["id"]), "no id")),
        source=F.lit("france_travail"),
        external_id=o["id"],
        title=or_default(o["intitule"], "(sans titre)"),
        company=or_default(o["entreprise"]["nom"], "Anonyme"),
        location=or_default(o["lieuTravail"]["libelle"], ""),
        contract_type=o["typeContrat"],
        salary_min=salary["salary_min"],
        salary_max=salary["salary_max"],
        remote_pct=F.when(places.contains_any(time, ["teletravail", "télétravail"]), 100),
        description=o["description"],
        url=F.when(_blank(o["origineOffre"]["urlOrigine"]), built)
        .otherwise(o["origineOffre"]["urlOrigine"]),
        posted_at=dates.iso_date(o["dateCreation"]),
        raw=keep_raw(o),
    )


def map_exec_offers(pages: DataFrame) -> DataFrame:
    """Executive job search: resultats[], kept within the radius."""
    df = parse_pages(pages, schema.EXECUTIVE_PAGE, "resultats")
    o = F.col("item")
    number = F.when(_blank(o["numeroOffre"]), o["id"]).otherwise(o["numeroOffre"])
    title, place = _trimmed(o["intitule"]), _trimmed(o["lieuTexte"])
    name = o["nomCommercial"]
    hidden = F.coalesce(o["offreConfidentielle"], F.lit(False)) | F.coalesce(
        name.startswith("ZZ_"), F.lit(False)
    )
    company = F.when(hidden | _blank(name), "Anonyme (APEC)").otherwise(strip(name))
    salary = numbers.salary_from_keur_label(F.coalesce(o["salaireTexte"], F.lit("")))
    zone = places.in_radius(o["localisable"], o["latitude"], o["longitude"], o["lieuTexte"])
    return _postings(
        df,
        _reject(
            (_blank(number), "no id"), (title == "", "no title"), (~zone, "out of zone")
        ),
        source=F.lit("apec_rss"),
        external_id=number,
        title=title,
        company=company,
        location=place,
        contract_type=F.lit("CDI"),
        salary_min=salary["salary_min"],
        salary_max=salary["salary_max"],
        description=F.nullif(_trimmed(o["texteOffre"]), F.lit("")),
        url=F.format_string(
            "https://www.apec.fr/candidat/recherche-emploi.html/emploi/detail-offre/%s", number
        ),
        posted_at=dates.iso_date(o["datePublication"]),
        raw=keep_raw(o),
    )


def _slug(careers_url: Column) -> Column:
    """First path segment of the careers url."""
    path = F.regexp_replace(labels.url_path(careers_url), "^/+|/+$", "")
    return F.split(path, "/")[0]


def map_ats_smartrecruiters(pages: DataFrame) -> DataFrame:
    """content[] of one employer's board: remote, home postcode or zone city only."""
    df = parse_pages(pages, schema.SMARTRECRUITERS_PAGE, "content")
    o = F.col("item")
    place = o["location"]
    title, name = _trimmed(o["name"]), o["company"]["name"]
    zone = places.in_zone(place["city"], place["postalCode"], place["remote"])
    return _postings(
        df,
        _reject((~zone, "out of zone"), (_blank(o["id"]), "no id"), (title == "", "no title")),
        source=F.lit("careers_site"),
        external_id=o["id"],
        title=title,
        company=strip(F.when(_blank(name), F.col("employer")).otherwise(name)),
        location=F.concat(or_default(place["city"], "Remote"), F.lit(", France")),
        remote_pct=F.when(place["remote"], 100),
        url=F.concat_ws(
            "/", F.lit("https://jobs.smartrecruiters.com"), _slug(F.col("careers_url")), o["id"]
        ),
        posted_at=dates.iso_date(o["releasedDate"]),
        raw=keep_raw(o),
    )


def map_ats_teamtailor(pages: DataFrame) -> DataFrame:
    """items[] of a JSON feed; the description is the text of the item's HTML."""
    df = parse_pages(pages, schema.TEAMTAILOR_PAGE, "items")
    o = F.col("item")
    # Taken out of the struct first: the UDF then gets one column, not the whole item.
    df = df.withColumn("n", html_nodes(F.lit(""), F.coalesce(o["content_html"], F.lit(""))))
    url, title = _trimmed(o["url"]), _trimmed(o["title"])
    return _postings(
        df,
        _reject((url == "", "no url"), (title == "", "no title")),
        source=F.lit("careers_site"),
        external_id=F.coalesce(o["id"], url),
        title=title,
        company=F.col("employer"),
        description=F.nullif(F.expr(sql_text("0", " ")), F.lit("")),
        url=url,
        posted_at=dates.iso_date(o["date_published"]),
        raw=keep_raw(o, ("content_html",)),
    )


def map_ats_greenhouse(pages: DataFrame) -> DataFrame:
    """jobs[] whose location names a zone city or remote work."""
    df = parse_pages(pages, schema.GREENHOUSE_PAGE, "jobs")
    o = F.col("item")
    place = _trimmed(o["location"]["name"])
    low = F.lower(place)
    zone = places.contains_any(low, [*defaults.ZONE_CITIES, "remote", "télétravail", "teletravail"])
    title, url = _trimmed(o["title"]), _trimmed(o["absolute_url"])
    return _postings(
        df,
        _reject((~zone, "out of zone"), (title == "", "no title"), (url == "", "no url")),
        source=F.lit("careers_site"),
        external_id=F.coalesce(o["id"], url),
        title=title,
        company=F.col("employer"),
        location=place,
        remote_pct=F.when(low.contains("remote"), 100),
        url=url,
        posted_at=dates.iso_date(o["updated_at"]),
        raw=keep_raw(o),
    )


def map_ats_lever(pages: DataFrame) -> DataFrame:
    """Bare array of postings; the date is an epoch in milliseconds."""
    df = parse_pages(pages, schema.LEVER_PAGE, None)
    o = F.col("item")
    place = _trimmed(o["categories"]["location"])
    low = F.lower(place)
    zone = places.contains_any(low, [*defaults.ZONE_CITIES, "remote"])
    title, url = _trimmed(o["text"]), _trimmed(o["hostedUrl"])
    return _postings(
        df,
        _reject((~zone, "out of zone"), (title == "", "no title"), (url == "", "no url")),
        source=F.lit("careers_site"),
        external_id=F.coalesce(o["id"], url),
        title=title,
        company=F.col("employer"),
        location=place,
        remote_pct=F.when(low.contains("remote"), 100),
        description=F.nullif(_trimmed(o["descriptionPlain"]), F.lit("")),
        url=url,
        posted_at=dates.epoch_ms_date(o["createdAt"]),
        raw=keep_raw(o, ("description", "lists")),
    )
