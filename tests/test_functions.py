import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from postwatch.functions import dates, labels, numbers, places, text
from postwatch.operators.filters import is_excluded_contract
from postwatch.operators.score import score_location


@pytest.mark.parametrize("raw, want", [
    ("Ingénieur Réseau", "ingenieur reseau"),
    ("Service Delivery Manager H/F", "service delivery manager"),
    ("Chef de Projet (H/F)", "chef de projet"),
    ("Data Engineer F/H.", "data engineer"),
    ("PMO   transverse !", "pmo transverse"),
    ("staff/manager", "staf anager"),
    ("RH/Finance", "r inance"),
    ("Technicien H/F/X", "technicien /x"),
    ("Brand™ …", "brandTM"),
    ("한국어", text.normalize_py("한국어")),
])
def test_normalize(col, raw, want):
    assert col("s string", [(raw,)], text.normalize(F.col("s"))) == [want]
    assert text.normalize_py(raw) == want


def test_normalize_equals_python_on_random_unicode(col):
    rng = random.Random(7)
    blocks = [(32, 127), (160, 0x250), (0x250, 0x3400), (0xAC00, 0xD7A4), (0xF900, 0xFFFD),
              (0x1D400, 0x1D7FF)]
    words = ["".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(10))
             for _ in range(2000)]
    got = col("s string", [(w,) for w in words], text.normalize(F.col("s")))
    assert got == [text.normalize_py(w) for w in words]


def test_fingerprint(col):
    rows = [("ACME", "SDM H/F"), ("Acme", "SDM"), ("Globex", "SDM")]
    got = col("c string, t string", rows, text.fingerprint(F.col("c"), F.col("t")))
    assert got[0] == got[1] == hashlib.sha256(b"acme|sdm").hexdigest() != got[2]


def test_clean_employer(col):
    rows = [("Manitou Group (P1) — site officiel",), ("Sopra (p4)",), ("Orange (P3)",)]
    got = col("s string", rows, text.clean_employer(F.col("s")))
    assert got == ["manitou group", "sopra (p4)", "orange"]


def test_clean(col):
    rows = [(" a ",), ("",), (None,), ("NaN",), ("  \x1c",), ("NaT",)]
    assert col("s string", rows, text.clean(F.col("s"))) == ["a"] + [None] * 5


def test_round_exact_is_python_round(col):
    rng = random.Random(3)
    xs = [0.25 * rng.randrange(101) + 0.3 * (rng.randrange(1001) / 10) + 0.1 * rng.randrange(101)
          + 0.2 * rng.randrange(101) + 0.15 * rng.choice([50, 60, 80, 100]) for _ in range(20000)]
    got = col("x double", [(x,) for x in xs], numbers.round_exact(F.col("x"), 1))
    assert got == [round(x, 1) for x in xs]


def test_to_keur(col):
    rows = [("42500", "yearly"), ("43500", "Yearly"), ("2500", "monthly"), ("20", "hourly"),
            ("x", "yearly"), ("nan", "yearly"), (None, "yearly")]
    got = col("a string, i string", rows, numbers.to_keur(F.col("a"), F.col("i")))
    assert got == [42, 44, 30, None, None, None, None]


@pytest.mark.parametrize("label, want", [
    ("Annuel de 55000,00 Euros à 65000,00 Euros sur 12 mois", (55, 65)),
    ("Mensuel de 2500 Euros sur 12 mois", (30, None)),
    ("Horaire de 15 Euros", (None, None)),
    ("Annuel de 65 000 Euros à 55 000,50 Euros", (55, 65)),
    ("Annuel de 55 000 Euros", (55, None)),
    ("Annuel de 20000 à 30000 puis 10000 ou 90000", (20, 30)),
    ("Annuel", (None, None)),
])
def test_salary_from_label(col, label, want):
    got = col("s string", [(label,)], numbers.salary_from_label(F.col("s")))[0]
    assert (tuple(got) if got else (None, None)) == want


@pytest.mark.parametrize("label, want", [
    ("43 - 53 k€ brut annuel", (43, 53)),
    ("Selon profil", (None, None)),
    ("A partir de 45 k€", (45, None)),
    ("60 - 50 KEUR, prime 12", (50, 60)),
    ("44,5 k€", (44, None)),
])
def test_salary_from_keur_label(col, label, want):
    got = col("s string", [(label,)], numbers.salary_from_keur_label(F.col("s")))[0]
    assert (tuple(got) if got else (None, None)) == want


def test_dates(col):
    d = dt.date
    iso = [("2026-07-04T15:38:29.000+0000",), ("garbage",), (None,), ("2026-02-31",)]
    assert col("s string", iso, dates.iso_date(F.col("s"))) == [d(2026, 7, 4), None, None, None]
    french = [("Publié le 5 août 2026",), ("31 février 2026",), ("3 foo 2026 puis 5 mai 2026",),
              ("le 12 DÉCEMBRE 2025",), ("",)]
    assert col("s string", french, dates.french_date(F.col("s"))) == [
        d(2026, 8, 5), None, None, d(2025, 12, 12), None]
    slash = [("04/07/2026",), ("31/02/2026",), ("x",), ("du 01/12/2025 au 02/12/2025",)]
    assert col("s string", slash, dates.slash_date(F.col("s"))) == [
        d(2026, 7, 4), None, None, d(2025, 12, 1)]
    epoch = [("1783123456789",), (None,), ("x",)]
    assert col("s string", epoch, dates.epoch_ms_date(F.col("s"))) == [
        d(2026, 7, 4), d(1970, 1, 1), None]


@pytest.mark.parametrize("location, remote, source, want", [
    ("Paris", 100, "jobspy_indeed", 100),
    ("Nort-sur-Erdre", None, "france_travail", 100),
    ("44 - NANTES", None, "france_travail", 90),
    ("44 - ORVAULT", None, "france_travail", 90),
    ("Saint Herblain", None, "jobspy_google", 90),
    ("Ancenis, France", None, "careers_site", 75),
    ("44 - SAVENAY", None, "france_travail", 60),
    ("85 - Rocheservière", None, "france_travail", 75),
    ("Laillé, France", None, "careers_site", 75),
    ("Lyon", None, "jobspy_indeed", 50),
    ("33000", None, "careers_site", 30),
    ("44300", None, "careers_site", 60),
    ("Paris", 50, "jobspy_indeed", 70),
    ("", None, "apec_rss", 75),
    ("Blainville", None, "jobspy_indeed", 75),
    (None, None, "jobspy_indeed", 50),
])
def test_location(spark, location, remote, source, want):
    ddl = "location string, remote_pct int, source string"
    df = spark.createDataFrame([(location, remote, source)], ddl)
    assert [r.location_score for r in score_location(df).collect()] == [want]


@pytest.mark.parametrize("located, lat, lon, place, want", [
    (True, "47.36", "-1.18", "", True),
    (True, "47.47", "-0.55", "", False),
    (False, None, None, "Nantes - 44", True),
    (True, "x", "-1.18", "Nantes - 44", True),
    (None, "47.36", "-1.18", "Angers - 49", False),
    (False, None, None, None, False),
])
def test_radius(col, located, lat, lon, place, want):
    expr = places.in_radius(*map(F.col, "abcd"))
    row = [(located, lat, lon, place)]
    assert col("a boolean, b string, c string, d string", row, expr) == [want]


def test_distance(col):
    got = col("a double, b double", [(47.36, -1.18), (47.47, -0.55)],
              places.haversine_km(F.col("a"), F.col("b")))
    assert [round(x, 3) for x in got] == [32.279, 80.625]


def test_place_from_text(col):
    rows = [("poste à Rezé",), ("en Loire-Atlantique",), ("35000 Rennes",),
            ("35000 collaborateurs",), ("SAINT-HERBLAIN ou Nantes",)]
    assert col("s string", rows, places.place_from_text(F.col("s"), F.lower("s"))) == [
        "Rezé", "Loire-Atlantique", "35000", "", "Nantes"]


def test_labels(col):
    rows = [(40, 50), (40, None), (None, 50), (0, 50)]
    assert col("a int, b int", rows, labels.salary_label(F.col("a"), F.col("b"))) == [
        "40–50 k€", "40 k€+", "n.c.", "n.c."]
    today = dt.date(2026, 7, 6)
    days = [(None,), (today,), (dt.date(2026, 7, 1),), (dt.date(2026, 7, 9),)]
    assert col("d date", days, labels.age_label(F.col("d"), F.lit(today))) == [
        "récent", "1 jour", "5 jours", "1 jour"]
    sources = [("careers_site", "X"), ("apec_rss", "X"), ("jobspy_google", "X"), ("other", "X")]
    assert col("s string, c string", sources, labels.source_label(F.col("s"), F.col("c"))) == [
        "Site officiel X", "APEC", "Google Jobs", "other"]
    kinds = [("internship",), ("Temporary, contract",), ("contract",), ("fulltime",), (None,)]
    assert col("s string", kinds, labels.canonical_contract(F.col("s"))) == [
        "Stage", "Intérim", "Freelance", None, None]


def test_title_from_slug(col):
    rows = [("https://x.io/vacancy/1234-assistant-data-engineer",), ("https://x.io/a/",),
            ("https://x.io/ab12-cafe-chef_de-projet.html?q=1",), ("https://x.io",),
            ("https://x.io/caf%C3%A9-pr%C3%A8s+toi.aspx",)]
    assert col("s string", rows, labels.title_from_slug(F.col("s"))) == [
        "Assistant data engineer", "A", "Chef de projet", "", "Café près+toi"]


def test_match_reason(col):
    rows = [(1, "", 100, 100.0, 0), (None, "Nantes, France", 90, 80.0, 60),
            (None, "Lyon", 50, 20.0, 0), (2, "Lyon", 50, 100.0, 90)]
    expr = labels.match_reason(*map(F.col, "tlsmh"))
    assert col("t int, l string, s int, m double, h int", rows, expr) == [
        "P1 cible, , titre exact", "Nantes, skills forts", "hors-liste à valider",
        "P2 cible, titre exact"]


@pytest.mark.parametrize("contract, title, want", [
    ("CDD", "PMO", True),
    (None, "Stage PMO", True),
    (None, "PMO", False),
    ("fulltime contract", "PMO", True),
    ("CDI", "Chef de projet", False),
    ("INTÉRIM", "PMO", True),
    ("CDI", "Mission INTÉRIM", True),
    ("CDI", "Alternante communication", True),
    ("CDI", "Upstage engineer", False),
    ("", "PMO", False),
])
def test_contracts(col, contract, title, want):
    expr = is_excluded_contract(F.col("c"), F.col("t"))
    assert col("c string, t string", [(contract, title)], expr) == [want]
