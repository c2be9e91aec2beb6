import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postwatch.functions import order
from postwatch.plans import defaults
from postwatch.schema import BOARD_ROWS, POSTING_COLUMNS, names
from postwatch.sources import dims, pages, payloads, registry

BODY = "page_seq long, body string"
EMPLOYER_BODY = "page_seq long, employer string, careers_url string, body string"


def rows(mapped):
    return payloads.accepted(mapped).orderBy("ingest_seq").collect()


def reasons(mapped):
    return {r.reject: r.n for r in payloads.quarantine_counts(mapped).collect()}


def test_board_rows(spark):
    base = dict(site="indeed", id="7", job_url="https://b/7", title="PMO", company="Acme",
                location="Nantes", job_type="fulltime", interval="yearly", min_amount="42500",
                max_amount="nan", is_remote=True, description=" d ", date_posted="2026-07-04")
    cases = [{}, {"site": "monster"}, {"job_url": " "},
             {"id": None, "title": "", "company": None, "location": None, "is_remote": False,
              "job_type": "contract", "date_posted": "NaT", "interval": "hourly",
              "site": "linkedin", "description": ""}]
    data = [tuple({**base, **c}.values()) + (i,) for i, c in enumerate(cases)]
    mapped = payloads.map_board_rows(
        spark.createDataFrame(data, BOARD_ROWS + ", ingest_seq BIGINT"))
    a, b = rows(mapped)
    assert mapped.columns == [*POSTING_COLUMNS, "reject"]
    assert (a.source, a.salary_min, a.salary_max, a.remote_pct, a.posted_at, a.contract_type,
            a.description) == ("jobspy_indeed", 42, None, 100, dt.date(2026, 7, 4), None, "d")
    assert (b.source, b.external_id, b.title, b.company, b.location, b.contract_type, b.remote_pct,
            b.salary_min, b.posted_at, b.description) == (
        "jobspy_linkedin", "https://b/7", "(sans titre)", "Anonyme", "", "Freelance", None, None,
        None, None)
    assert json.loads(a.raw)["id"] == "7" and names(BOARD_ROWS)[7] == "`interval`"
    assert reasons(mapped) == {"unknown site": 1, "no url": 1}


def test_public_employment(spark):
    page = {"resultats": [
        {"id": "A1", "intitule": "Chef de projet", "typeContrat": "CDI",
         "dureeTravailLibelleConverti": "Temps plein, Télétravail",
         "entreprise": {"nom": "Acme"}, "lieuTravail": {"libelle": "44 - NANTES"},
         "salaire": {"libelle": "Annuel de 55000,00 Euros à 65000,00 Euros sur 12 mois"},
         "origineOffre": {"urlOrigine": "https://o/A1"}, "dateCreation": "2026-07-04T10:00:00Z"},
        {"id": 12, "entreprise": None},
        {"intitule": "sans id"}]}
    mapped = payloads.map_public_employment_offers(
        spark.createDataFrame([(3, json.dumps(page)), (4, "<html>"), (5, "{}")], BODY))
    a, b = rows(mapped)
    assert (a.url, a.salary_min, a.salary_max, a.remote_pct, a.ingest_seq) == (
        "https://o/A1", 55, 65, 100, 3 << order.ITEM_BITS)
    assert (b.external_id, b.url, b.title, b.company, b.location, b.remote_pct) == (
        "12", "https://candidat.francetravail.fr/offres/recherche/detail/12", "(sans titre)",
        "Anonyme", "", None)
    assert reasons(mapped) == {"no id": 1}


def test_exec(spark):
    near = {"localisable": True, "latitude": "47.36", "longitude": -1.18}
    page = {"totalCount": 5, "resultats": [
        {"numeroOffre": "N1", "intitule": " PMO ", "lieuTexte": "Nantes - 44",
         "nomCommercial": " Acme ", "salaireTexte": "43 - 53 k€ brut annuel", "texteOffre": "  ",
         "datePublication": "2026-07-04T15:38:29.000+0000", **near},
        {"id": 9, "intitule": "PO", "nomCommercial": "ZZ_X", "lieuTexte": "Nantes - 44"},
        {"id": "10", "intitule": "PO", "lieuTexte": "Angers - 49"},
        {"intitule": "PO", **near}, {"id": "11", "intitule": " ", **near}]}
    mapped = payloads.map_exec_offers(spark.createDataFrame([(0, json.dumps(page))], BODY))
    a, b = rows(mapped)
    assert (a.external_id, a.title, a.company, a.salary_min, a.salary_max, a.description,
            a.contract_type) == ("N1", "PMO", "Acme", 43, 53, None, "CDI")
    assert a.url.endswith("detail-offre/N1") and b.company == "Anonyme (APEC)"
    assert reasons(mapped) == {"no id": 1, "no title": 1, "out of zone": 1}


@pytest.mark.parametrize("mapper, page, kept, want", [
    (payloads.map_ats_smartrecruiters,
     {"content": [
         {"id": 1, "name": "PMO", "company": {"name": "SBS"}, "releasedDate": "2026-07-04T1",
          "location": {"city": "Nantes", "postalCode": "44000"}},
         {"id": "2", "name": "PO", "location": {"remote": True}},
         {"id": "3", "name": "PO", "location": {"city": "Lyon", "postalCode": 69000}}]},
     ["1", "2"],
     ("SBS", "Nantes, France", None, "https://jobs.smartrecruiters.com/Slug/1")),
    (payloads.map_ats_teamtailor,
     {"items": [
         {"id": "1", "url": " https://t/1 ", "title": "PMO", "date_published": "2026-07-04",
          "content_html": "<p>Un <b>texte</b></p>"},
         {"url": "", "title": "x"}]},
     ["1"], ("Emp", "", None, "https://t/1")),
    (payloads.map_ats_greenhouse,
     {"jobs": [
         {"id": 1, "title": "PMO", "absolute_url": "https://g/1", "updated_at": "2026-07-04",
          "location": {"name": "Remote - Nantes"}},
         {"id": 2, "title": "PMO", "absolute_url": "https://g/2", "location": {"name": "Paris"}}]},
     ["1"], ("Emp", "Remote - Nantes", 100, "https://g/1")),
    (payloads.map_ats_lever,
     [{"id": "1", "text": "PMO", "hostedUrl": "https://l/1", "createdAt": 1783123456789,
       "descriptionPlain": " d ", "description": "<p>", "lists": [{"a": 1}],
       "categories": {"location": "Nantes"}},
      {"id": "2", "text": "PMO", "hostedUrl": "https://l/2", "categories": {}}],
     ["1"], ("Emp", "Nantes", None, "https://l/1")),
])
def test_ats(spark, mapper, page, kept, want):
    row = (0, "Emp", "https://careers.example.com/Slug/jobs", json.dumps(page))
    got = rows(mapper(spark.createDataFrame([row], EMPLOYER_BODY)))
    assert [r.external_id for r in got] == kept
    a = got[0]
    assert (a.company, a.location, a.remote_pct, a.url) == want
    assert a.posted_at == dt.date(2026, 7, 4) and a.source == "careers_site"
    raw = json.loads(a.raw)
    assert not {"content_html", "lists"} & set(raw)
    if mapper is payloads.map_ats_teamtailor:
        assert a.description == "Un texte"


# --- pages ----------------------------------------------------------------------------------
LISTING = """<html><head><title>T</title></head><body>
<nav><a href="/">Accueil</a><a href="/offres/#top">Offres</a></nav>
<ul>
 <li><h3>Titre dans le bloc</h3><a href="/offres/1?x=1"><img src="i.png"></a> CDI
     publié le 5 août 2026
 <li><a href="offres/2#a">Lire la suite</a> cdd
 <li><a href="/offres/3-chef-de-projet">Postuler</a>
 <li><a href="/offres/4">Chef de <b>projet</b> data</a></li>
 <li><a href="https://ailleurs.org/offres/5">Responsable exploitation</a></li>
 <li><a href="/offres/4">Chef de projet bis</a></li>
</ul></body></html>"""


def flat(spark, html, url="https://x.org/offres/", pattern="/offres/", employer="Emp"):
    return pages.flat_pages(spark.createDataFrame(
        [(1, url, employer, pattern, html)],
        "page_seq long, url string, employer string, link_pattern string, html string"))


def test_generic_listing(spark):
    got = pages.harvest_links(flat(spark, LISTING, "https://x.org/offres/")).orderBy("ingest_seq")
    seen = {r.url: (r.title, r.contract_type, r.posted_at) for r in got.collect()}
    assert seen == {
        "https://x.org/offres/1": ("Titre dans le bloc", "CDI", dt.date(2026, 8, 5)),
        "https://x.org/offres/3-chef-de-projet": ("3 chef de projet", None, None),
        "https://x.org/offres/4": ("Chef deprojetdata", None, None),
        "https://ailleurs.org/offres/5": ("Responsable exploitation", None, None),
    }
    assert got.columns == POSTING_COLUMNS


def test_block_listing(spark):
    html = """<body><article><a href="https://m.org/fr/offres/a">Acheteur</a><span>CDI</span>
      <p>France</p><p>Ancenis 01</p><p>le 4 juillet 2026</p></article>
      <article><a href="https://m.org/fr/offres/b">Stage achats</a> Stage</article>
      <article><a href="https://m.org/fr/offres/b">Encore</a> CDI</article>
      <article><a href="https://m.org/fr/offres/">Toutes</a></article>
      <article><a href="https://m.org/fr/offres/c">PO</a></article></body>"""
    got = pages.harvest_links(flat(spark, html), pages.BLOCKS).orderBy("ingest_seq").collect()
    assert [(r.url[-1], r.title, r.contract_type, r.location, r.posted_at) for r in got] == [
        ("a", "Acheteur", "CDI", "Ancenis 01, France", dt.date(2026, 7, 4)),
        ("c", "PO", None, "France", None)]


def test_tiles(spark):
    html = """<ul><li><a href="emploi-1.aspx">PMO</a> cdi 04/07/2026</li>
      <li><a href="emploi-2.aspx">PMO</a> Alternance</li>
      <li><a href="emploi-3.html">PMO</a></li>
      <li><a href="emploi-4.aspx#x">Chef</a> 31/02/2026</li></ul>"""
    got = pages.harvest_links(flat(spark, html, "https://c.org/a/l.aspx"), pages.TILES)
    assert [(r.url, r.contract_type, r.posted_at, r.location)
            for r in got.orderBy("ingest_seq").collect()] == [
        ("https://c.org/a/emploi-1.aspx", "CDI", dt.date(2026, 7, 4), ""),
        ("https://c.org/a/emploi-4.aspx", None, None, "")]


def test_containers(spark):
    long = "x" * 700
    html = f"""<body><div><div>{long} France - Nantes</div>
      <div><h2>Chef de projet data</h2><div><p>France - Nantes Open-ended</p></div>
           <a href="/j/1">En savoir plus</a></div>
      <li>FRANCE - NANTES <a href="/j/2">Responsable support</a> fixed-term</li>
      <li>France - Nantes <a href="/j/3">Court</a></li>
      <li>France - Lyon <a href="/j/4">Responsable Lyon</a></li></div></body>"""
    got = pages.harvest_containers(flat(spark, html), "france - nantes", "Nantes, France")
    assert [(r.url[-1], r.title, r.contract_type, r.location)
            for r in got.orderBy("ingest_seq").collect()] == [
        ("1", "Chef de projet data", "CDI", "Nantes, France"),
        ("2", "Responsable support", "CDD", "Nantes, France")]


def test_diagnostics(spark):
    short = '<a href="/offres/1">a</a><a href="/offres/2"></a><p>France - Nantes</p>'
    none = '<a href="/b">b</a><a href="/a">a</a><a>c</a><a href="/a">a</a>'
    df = flat(spark, LISTING).unionByName(
        flat(spark, short).withColumn("page_seq", F.lit(2).cast("long"))).unionByName(
        flat(spark, none).withColumn("page_seq", F.lit(3).cast("long")))
    a, b, c = pages.harvest_diagnostics(df, marker="France - Nantes").orderBy("page_seq").collect()
    assert (a.kept, a.titles, a.hrefs) == (5, None, None)
    assert (b.matched, b.kept, b.titles, b.marker_hits) == (2, 0, ["a", "∅"], 1)
    assert (c.links, c.matched, c.titles, c.hrefs) == (4, 0, None, ["/a", "/b"])


@pytest.mark.parametrize("html, want", [
    ("<body><nav>n</nav><article>a <p>b<p>c</article><main>m<br>&amp; é</main></body>", "m & é"),
    ("<body><nav>n</nav><article> a <p>b<p>c</article>f</body>", "a b c"),
    ("<head><title>t</title></head><body>x<!-- no --><b>y</b></body>", "x y"),
    ("plain", "plain"),
    ("", None),
])
def test_page_text(spark, html, want):
    assert pages.page_text(flat(spark, html)).first().page_text == want


def test_page_text_limit(spark):
    df = flat(spark, f"<main>{'x' * 30000}</main>")
    assert len(pages.page_text(df, max_chars=20_000).first().page_text) == 20_000
    assert len(pages.page_text(df).first().page_text) > 20_000
    assert len(pages.page_text(df, None).first().page_text) == 30000


def test_job_ad(spark):
    body = {"jobAd": {"sections": {"a": {"text": "<p>Un</p>"}, "b": {"text": None}, "c": None,
                                   "d": {"text": "deux <b>trois</b>"}}}}
    df = spark.createDataFrame([("u", json.dumps(body)), ("v", "{}")], "url string, body string")
    assert {r.url: r.page_text for r in pages.job_ad_text(df).collect()} == {
        "u": "Un deux trois", "v": None}


def test_enrich(spark):
    postings = spark.createDataFrame(
        [("u", "", None, 1), ("v", "Lyon", "old", 2), ("w", "", "kept", 3)],
        "url string, location string, description string, ingest_seq long")
    texts = spark.createDataFrame(
        [(4, "u", "poste à Vertou"), (1, "u", "poste à Rezé"), (2, "v", "poste à Nantes"),
         (3, "w", None)],
        "page_seq long, url string, page_text string")
    got = pages.enrich_descriptions(postings, texts).orderBy("url").collect()
    assert [tuple(r) for r in got] == [
        ("u", "Rezé", "poste à Rezé", 1), ("v", "Lyon", "poste à Nantes", 2),
        ("w", "", "kept", 3)]


# --- dimensions and dispatch ----------------------------------------------------------------
def test_employer_file(spark, tmp_path):
    path = tmp_path / "employers.yaml"
    path.write_text(
        "employers:\n- {name: A, tier: 1, sector: s, aliases: [x, y]}\n"
        "- {name: B, tier: 3, sector: s, ats: ssr, link_pattern: /jobs/}\n", encoding="utf-8")
    a, b = dims.load_employers(spark, path).orderBy("ord").collect()
    assert (a.name, a.aliases, b.ord, b.aliases, b.link_pattern) == ("A", ["x", "y"], 1, [], "/jobs/")
    assert dims.load_employers(spark, tmp_path / "none.yaml").count() == 0
    path.write_text("employers: [", encoding="utf-8")
    assert dims.load_employers(spark, path).count() == 0
    path.write_text("employers: [{name: A, tier: 9}]", encoding="utf-8")
    with pytest.raises(ValueError):
        dims.load_employers(spark, path)


def test_target_file(tmp_path):
    path = tmp_path / "t.yaml"
    assert "chef de projet" in dims.load_targets(path)
    path.write_text("titles: [Chargé (H/F), 3]", encoding="utf-8")
    assert dims.load_targets(path) == ["charge"]
    path.write_text("titles: [", encoding="utf-8")
    assert dims.load_targets(path) == defaults.TARGET_TITLES


def test_dispatch(spark):
    lever = json.dumps([{"id": "1", "text": "PMO", "hostedUrl": "https://x.org/offres/4",
                         "categories": {"location": "Nantes"}}])
    landed = spark.createDataFrame(
        [(1, "L", "https://jobs.lever.co/slug", "lever", None, lever),
         (2, "S", "https://x.org/offres/", "ssr", "/offres/", LISTING),
         (3, "D", "https://tiles.org/l.aspx", None, None,
          '<li><a href="emploi-1.aspx">PMO</a></li>'),
         (4, "N", "https://unknown.org/", None, None, "x")],
        "page_seq long, employer string, careers_url string, ats string, link_pattern string, "
        "body string")
    postings, skipped = registry.dispatch_career_pages(landed, {"tiles.org": "cegid"})
    assert [r.employer for r in skipped.collect()] == ["N"]
    by_company = {}
    for r in postings.collect():
        by_company.setdefault(r.company, set()).add(r.url)
    assert by_company["L"] == {"https://x.org/offres/4"} and len(by_company["S"]) == 3
    assert by_company["D"] == {"https://tiles.org/emploi-1.aspx"}


def test_dispatch_by_usual_domains(spark):
    """Pages without a known ats are read by their host, block and card listings included."""
    link = '<a href="/{}">{} Nantes</a>'
    card = f'<div>{link.format("c1", "Data Engineer")} France - Nantes open-ended</div>'
    landed = spark.createDataFrame(
        [(1, "C", "https://www.inetum.com/jobs", None, None, f"<body>{card}</body>"),
         (2, "T", "https://recrutement.arkea.com/l", None, None,
          '<li><a href="emploi-1.aspx">PMO</a></li>'),
         (3, "G", "https://job-boards.eu.greenhouse.io/x", "?", None, json.dumps({"jobs": [
             {"id": "1", "title": "PMO", "absolute_url": "https://g/1",
              "location": {"name": "Nantes"}}]})),
         (4, "N", "https://unknown.org/", None, None, "x")],
        "page_seq long, employer string, careers_url string, ats string, link_pattern string, "
        "body string")
    postings, skipped = registry.dispatch_career_pages(landed)
    assert [r.employer for r in skipped.collect()] == ["N"]
    got = {r.company: (r.url, r.location, r.contract_type) for r in postings.collect()}
    assert got["C"] == ("https://www.inetum.com/c1", "Nantes, France", "CDI")
    assert got["T"][0] == "https://recrutement.arkea.com/emploi-1.aspx"
    assert got["G"][:2] == ("https://g/1", "Nantes")


def test_union_sources(spark):
    one = spark.createDataFrame([("a", 5)], "source string, ingest_seq long")
    bad = spark.createDataFrame([("x", 1)], "source string, ingest_seq long").select(
        F.raise_error(F.lit("boom")).alias("source"), "ingest_seq")
    union, errors = registry.union_sources({"apec": one, "jobspy": one})
    ranks = sorted(r.ingest_seq for r in union.collect())
    assert ranks == [5, (2 << order.SOURCE_BITS) + 5] and errors == {}
    union, errors = registry.union_sources({"apec": bad, "jobspy": one}, isolate=True)
    assert union.count() == 1 and "boom" in errors["apec"]
    with pytest.raises(ValueError):
        registry.union_sources({"nope": one})


def test_dispatch_keeps_the_first_page_over_all_mappers(spark):
    """HTML page 1 and JSON page 2 share a url: the first page's employer keeps it, and order
    numbers of different mappers never meet."""
    html = ('<body><li><h3>Data Engineer Nantes</h3><a href="https://g/1">Data Engineer CDI</a>'
            '</li></body>')
    jobs = json.dumps({"jobs": [{"id": "1", "title": "Data Engineer", "absolute_url": "https://g/1",
                                 "location": {"name": "Nantes"}},
                                {"id": "2", "title": "Data Analyst", "absolute_url": "https://g/2",
                                 "location": {"name": "Nantes"}}]})
    landed = spark.createDataFrame(
        [(1, "First", "https://g/list", "ssr", "/g/", html),
         (2, "Second", "https://boards/x", "greenhouse", None, jobs),
         (48, "Third", "https://boards/y", "greenhouse", None,
          jobs.replace("https://g", "https://h"))],
        "page_seq long, employer string, careers_url string, ats string, link_pattern string, "
        "body string")
    postings, _ = registry.dispatch_career_pages(landed)
    got = postings.orderBy("ingest_seq").collect()
    assert [(r.company, r.url) for r in got] == [
        ("First", "https://g/1"), ("Second", "https://g/2"), ("Third", "https://h/1"),
        ("Third", "https://h/2")]
    assert len({r.ingest_seq for r in got}) == 4


def test_order_numbers_that_do_not_fit_are_errors(spark):
    df = spark.createDataFrame([(1, 5)], "page long, pos int")
    number = order.page_order(F.col("page"), F.col("pos"))
    assert df.select(number).first()[0] == (1 << order.ITEM_BITS) + 5
    for page, pos in ((1 << 40, 0), (1, 1 << 20), (-1, 0)):
        with pytest.raises(Exception, match="out of order numbers"):
            df.select(order.page_order(F.lit(page), F.lit(pos))).collect()
    with pytest.raises(ValueError):
        order.source_order(8, F.lit(1))


def test_a_posting_without_title_is_kept(spark):
    from postwatch.operators import filters

    df = spark.createDataFrame([("CDI", None), (None, None), ("CDD", None)],
                               "contract_type string, title string")
    assert filters.exclude_contracts(df).count() == 2


def test_blocks_of_many_links_stay_linear(spark):
    """800 links in one list: one block text, not one per link and page size."""
    page = "<body><ul>" + "".join(f"<a href='/e/{i}'>Job number {i} CDI</a>" for i in range(800))
    df = flat(spark, page + "</ul></body>")
    rows_ = pages.page_links(df).count()
    assert rows_ == 800
    assert pages.page_links(df, "contains(n.href[i], '/e/7')").count() == 111


def test_texts_decode_only_the_four_entities_with_semicolons():
    """As the page-text SQL: &quot; &copy; &middot; &amp; in that order; "&amp" or "&lt;" stays."""
    from postwatch.sources.html import flatten

    *_, texts = flatten("<article><p>a&amp b&amp;c &lt;d&gt; &amp;quot; &copy;&middot;</p></article>")
    assert texts[-1] == 'a&amp b&c &lt;d&gt; &quot; ©·'
