"""Postings and texts out of landed HTML pages (columns page_seq, url, html and, for listings,
employer and link_pattern)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwatch.functions.dates import french_date, slash_date
from postwatch.functions.labels import title_from_slug, url_path
from postwatch.functions.order import page_order
from postwatch.functions.places import place_from_text
from postwatch.operators.dedup import keep_first
from postwatch.operators.skew import salted_join
from postwatch.plans import defaults
from postwatch.schema import JOB_AD
from postwatch.sources.html import (
    MAIN_TEXT, html_nodes, sql_ancestors, sql_block, sql_heading_in, sql_text,
)

MIN_TITLE = 8


def flat_pages(pages: DataFrame) -> DataFrame:
    """Replace html by its node arrays n."""
    return pages.withColumn("n", html_nodes(F.col("url"), F.col("html"))).drop("html")


def page_links(flat: DataFrame, where: str = "true") -> DataFrame:
    """One row per link: pos, href (as written), link_url (resolved), link_text, heading (for a
    link without text, the first one in the nearest of three ancestors that has any) and block
    (text around the link, one line per text).  The rules run inside the page's row, so nothing
    is shuffled.  where: SQL over n and i, the link's place; other links are dropped before any
    text is built."""
    heading = f"""
        get(filter(transform({sql_ancestors('l.pos', 3)}, a -> {sql_heading_in('a')}),
                   h -> h is not null), 0)"""
    links = f"""
        transform(
          filter(sequence(0, size(n.tag) - 1), i -> n.tag[i] = 'a' and {where}),
          i -> struct(i as pos, n.href[i] as href, n.url[i] as link_url,
                      {sql_text('i', '')} as link_text, {sql_block('i')} as b))"""
    with_heading = f"""
        transform(links, l -> struct(l.pos, l.href, l.link_url, l.link_text, l.b,
                                     if(l.link_text = '', {heading}, null) as h))"""
    # One text per distinct block, with the links in it: the page's row stays linear in the page.
    by_block = f"""
        transform(array_distinct(transform(links, l -> l.b)), b -> struct(
          {sql_text('b', chr(92) + 'n')} as block,
          transform(filter(links, l -> l.b = b), l -> struct(
            l.pos, l.href, l.link_url, l.link_text,
            if(l.h is null, null, {sql_text('l.h', '')}) as heading)) as held))"""
    kept = [c for c in flat.columns if c != "n"]
    return (
        flat.withColumn("links", F.expr(links))
        .withColumn("links", F.expr(with_heading))
        .withColumn("links", F.expr(by_block))
        .drop("n")
        .select(*kept, F.inline("links"))
        .select(*kept, F.inline("held"), "block")
    )


def first_contract(block: Column, vocabulary: list[str], ignore_case: bool) -> Column:
    """First contract of the list, in list order, that the block names as a word."""
    flags = "(?iuU)" if ignore_case else "(?U)"
    return F.coalesce(
        *[F.when(block.rlike(rf"{flags}\b\Q{c}\E\b"), F.lit(c)) for c in vocabulary]
    )


def city_after(block: Column, line: str) -> Column:
    """The line after the first one that equals `line`."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(lines, line).cast("int")
    return F.when(at > 0, F.get(lines, at))


@dataclass(frozen=True)
class Listing:
    """How a family of listing pages is read."""

    contracts: tuple[str, ...]
    ignore_case: bool
    keep_contracts: tuple[str, ...] | None = None  # other contracts drop the link
    date: str = "french"
    url_marker: str | None = None  # href must contain it; None: the employer's link_pattern
    url_suffix: str | None = None  # and this
    title_fallback: bool = False  # heading, then slug, when the link text is no title
    city_line: str | None = None


GENERIC = Listing(("CDI", "CDD"), ignore_case=True, title_fallback=True)
BLOCKS = Listing(
    ("CDI", "CDD", "Alternance", "Stage"), ignore_case=False, keep_contracts=("CDI", "CDD"),
    url_marker="/fr/offres/", city_line="France",
)
TILES = Listing(
    ("CDI", "CDD", "ALTERNANCE", "STAGE", "EMPLOI VACANCES"), ignore_case=True,
    keep_contracts=("CDI", "CDD"), date="slash", url_marker="emploi-", url_suffix=".aspx",
)


def _without_slash(col: Column) -> Column:
    return F.regexp_replace(col, "/+$", "")


def _posting(links: DataFrame, **columns: Column) -> DataFrame:
    empty = F.lit(None)
    values = {
        "source": F.lit("careers_site"),
        "external_id": F.col("link_url"),
        "title": F.col("link_title"),
        "company": F.col("employer"),
        "location": F.lit(""),
        "contract_type": empty.cast("string"),
        "salary_min": empty.cast("int"),
        "salary_max": empty.cast("int"),
        "remote_pct": empty.cast("int"),
        "description": empty.cast("string"),
        "url": F.col("link_url"),
        "posted_at": empty.cast("date"),
        "raw": F.to_json(F.struct("employer", F.substring("block", 1, 500).alias("block"))),
        "ingest_seq": page_order(F.col("page_seq"), F.col("pos")),
        **columns,
    }
    return links.select(*[c.alias(n) for n, c in values.items()])


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matched_links(flat: DataFrame, listing: Listing) -> DataFrame:
    """Links that belong to the listing, with link_url as kept and link_title (maybe '')."""
    where = "n.url[i] is not null"
    if listing.url_marker is None:
        where += r" and contains(split(n.url[i], '\\?')[0], link_pattern)"
    else:
        where += f" and contains(n.href[i], {sql_string(listing.url_marker)})"
    links = page_links(flat, where)
    if listing.url_marker is None:
        links = links.withColumn("link_url", F.split("link_url", r"\?")[0]).filter(
            F.col("link_url").contains(F.col("link_pattern"))
            & ~F.split(F.col("href"), "[?#]")[0].isin("")
            & (_without_slash(url_path(F.col("link_url")))
               != _without_slash(url_path(F.col("url"))))
        )
    else:
        links = links.filter(F.col("href").contains(listing.url_marker))
        if listing.url_suffix:
            links = links.filter(F.split("href", "#")[0].contains(listing.url_suffix))
        else:
            # Not the listing page itself.
            links = links.filter(
                ~_without_slash(F.split("href", "#")[0])
                .endswith(_without_slash(F.lit(listing.url_marker)))
            )
    title = F.col("link_text")
    if listing.title_fallback:
        title = F.when(title == "", F.coalesce("heading", F.lit(""))).otherwise(title)
        title = F.when(
            (F.length(title) < MIN_TITLE) | F.lower(title).isin(defaults.NAV_LABELS),
            title_from_slug(F.col("link_url")),
        ).otherwise(title)
    return links.withColumn("link_title", title)


def harvest_links(flat: DataFrame, listing: Listing = GENERIC) -> DataFrame:
    """Postings of listing pages: the first usable link per url and page, then per url over all
    pages in page order."""
    links = matched_links(flat, listing)
    links = links.filter(
        F.length("link_title") >= (MIN_TITLE if listing.title_fallback else 1)
    )
    links = links.withColumn("_seq", page_order(F.col("page_seq"), F.col("pos")))
    contract = first_contract(F.col("block"), list(listing.contracts), listing.ignore_case)
    links = links.withColumn("_contract", contract)
    if listing.keep_contracts is not None:
        # The first link of a url counts even when its contract then drops it.
        links = keep_first(links, ["page_seq", "link_url"], "_seq")
        links = links.filter(
            F.col("_contract").isNull() | F.col("_contract").isin(*listing.keep_contracts)
        )
    links = keep_first(links, ["link_url"], "_seq")
    location = F.lit("")
    if listing.city_line:
        city = city_after(F.col("block"), listing.city_line)
        location = F.concat_ws(", ", city, F.lit(listing.city_line))
    date = french_date if listing.date == "french" else slash_date
    return _posting(
        links, contract_type=F.col("_contract"), posted_at=date(F.col("block")),
        location=location,
    )


def harvest_containers(flat: DataFrame, marker: str, location: str,
                       max_chars: int = 600) -> DataFrame:
    """Postings of pages whose cards are found by a text: blocks of at most max_chars that hold
    the marker, the first link in the block or in one of its three nearest ancestors; generic
    link labels give way to the heading there.  A url's first card counts, even without title."""
    card = f"""
        transform(
          filter(sequence(0, size(n.tag) - 1),
                 i -> n.tag[i] in ('div', 'li', 'article', 'p', 'h2', 'h3')),
          i -> struct(i as pos, {sql_text('i', ' ')} as block))"""
    fits = f"length(c.block) <= {max_chars} and contains(lower(c.block), lower(:marker))"
    holder = f"""
        get(filter(concat(array(c.pos), {sql_ancestors('c.pos', 3)}),
                   a -> exists(sequence(a, n.last[a]), j -> n.tag[j] = 'a' and n.href[j] <> '')),
            0)"""
    link = """
        get(filter(sequence(c.at, n.last[c.at]), j -> n.tag[j] = 'a' and n.href[j] <> ''), 0)"""
    quoted = marker.replace("\\", "\\\\").replace("'", "\\'")
    cards = (
        flat.withColumn("cards", F.expr(card))
        .withColumn("cards", F.expr(f"filter(cards, c -> {fits})".replace(":marker", f"'{quoted}'")))
        .withColumn("cards", F.expr(f"transform(cards, c -> struct(c.pos, c.block, {holder} as at))"))
        .withColumn("cards", F.expr(
            f"transform(filter(cards, c -> c.at is not null), c -> struct(c.pos, c.block, c.at, {link} as j))"))
        .withColumn("cards", F.expr(f"""
            transform(cards, c -> struct(
              c.pos, c.block, n.url[c.j] as link_url, {sql_text('c.j', '')} as link_text,
              {sql_heading_in('c.at')} as h))"""))
        .withColumn("cards", F.expr(f"""
            transform(cards, c -> struct(c.pos, c.block, c.link_url, c.link_text,
              if(c.h is null, '', {sql_text('c.h', '')}) as heading))"""))
        .select(*[c for c in flat.columns if c != "n"], F.inline("cards"))
        .filter("link_url is not null")
        .withColumn("_seq", page_order(F.col("page_seq"), F.col("pos")))
    )
    cards = keep_first(cards, ["page_seq", "link_url"], "_seq")
    text = F.col("link_text")
    generic = ["", *defaults.NAV_LABELS[:3]]
    cards = cards.withColumn(
        "link_title", F.when(F.lower(text).isin(generic), F.col("heading")).otherwise(text)
    ).filter(F.length("link_title") >= MIN_TITLE)
    low = F.lower("block")
    return _posting(
        keep_first(cards, ["link_url"], "_seq"),
        location=F.lit(location),
        contract_type=F.when(low.contains("open-ended"), "CDI")
        .when(low.contains("fixed-term"), "CDD"),
        raw=F.to_json(F.struct("employer", F.substring("block", 1, 300).alias("block"))),
    )


def harvest_diagnostics(flat: DataFrame, listing: Listing = GENERIC, marker: str = "") -> DataFrame:
    """Per page: links, matched links, kept links; for pages that keep none, a sample of the
    matched titles or else of the hrefs; and how often the page text holds the marker.

    The href sample comes out of the page's own array and the title sample has ten entries at
    most; a page's links are one input row, so its group is bounded."""
    links = matched_links(flat, listing)
    kept = F.length("link_title") >= (MIN_TITLE if listing.title_fallback else 1)
    shown = F.when(F.col("link_text") == "", "∅").otherwise(F.substring("link_text", 1, 40))
    first = F.row_number().over(Window.partitionBy("page_seq").orderBy("pos"))
    per_page = (
        links.withColumns({"_kept": kept, "_shown": shown, "_rn": first})
        .groupBy("page_seq").agg(
            F.count(F.lit(1)).alias("matched"),
            F.count_if("_kept").alias("kept"),
            # ten entries at most
            F.collect_list(F.when(F.col("_rn") <= 10, F.struct("_rn", "_shown"))).alias("_first"),
        )
        .withColumn("titles", F.transform(F.array_sort("_first"), lambda t: t["_shown"]))
    )
    hrefs = F.expr("""
        slice(array_sort(array_distinct(transform(
          filter(sequence(0, size(n.tag) - 1), i -> n.tag[i] = 'a' and n.href[i] <> ''),
          i -> substring(n.href[i], 1, 70)))), 1, 15)""")
    text = F.lower(F.expr(sql_text("0", "")))
    hits = F.size(F.split(text, F.lit(r"\Q" + marker.lower() + r"\E"))) - 1 if marker else F.lit(0)
    pages = flat.select(
        "page_seq", "url", hrefs.alias("hrefs"), hits.cast("int").alias("marker_hits"),
        F.expr("size(filter(n.tag, t -> t = 'a'))").alias("links"),
    )
    out = pages.join(per_page, "page_seq", "left")
    matched, kept_n = (F.coalesce(c, F.lit(0)) for c in ("matched", "kept"))
    return out.select(
        "page_seq", "url", "links", matched.alias("matched"), kept_n.alias("kept"),
        F.when((matched > 0) & (kept_n == 0), F.col("titles")).alias("titles"),
        F.when(matched == 0, F.col("hrefs")).alias("hrefs"),
        "marker_hits",
    )


def page_text(flat: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(url, page_text): text of the first main, else the first article, else the body."""
    text = F.expr(MAIN_TEXT)
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    keys = [c for c in flat.columns if c != "n"]
    return flat.select(*keys, F.nullif(text, F.lit("")).alias("page_text"))


def job_ad_text(payloads: DataFrame, body: str = "body",
                max_chars: int | None = None) -> DataFrame:
    """page_text of posting-detail payloads: the texts of all sections, in payload order."""
    sections = F.map_values(F.from_json(F.col(body), JOB_AD)["jobAd"]["sections"])
    joined = F.array_join(
        F.filter(F.transform(sections, lambda s: s["text"]), lambda t: t != ""), "<br>"
    )
    flat = payloads.withColumn("n", html_nodes(F.lit(""), joined)).drop(body)
    text = F.expr(sql_text("0", " "))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return flat.withColumn("page_text", F.nullif(text, F.lit(""))).drop("n")


def enrich_descriptions(postings: DataFrame, texts: DataFrame) -> DataFrame:
    """Description := page text of the posting's url, and a blank location := the place that text
    names.  Postings without a page keep what they have.  texts: one row per url, or with
    page_seq, of which the first page of a url counts."""
    if "page_seq" in texts.columns:
        texts = keep_first(texts, ["url"], "page_seq")
    found = salted_join(
        postings, texts.select("url", "page_text"), ["url"], "left", F.col("ingest_seq"),
    ).withColumn("_low", F.lower("page_text"))
    described = F.coalesce("page_text", "description")
    blank = (F.col("location") == "") & F.col("page_text").isNotNull()
    place = place_from_text(F.col("page_text"), F.col("_low"))
    return (
        found.withColumn("location", F.when(blank, place).otherwise(F.col("location")))
        .withColumn("description", described)
        .select(postings.columns)
    )
