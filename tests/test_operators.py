import datetime as dt
import itertools
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from conftest import SF
from postwatch.functions.text import fingerprint, normalize_py
from postwatch.operators import (
    dedup,
    filters,
    lexicon,
    match,
    membership,
    publish,
    score,
    skew,
    state,
    stats,
)
from postwatch.plans import defaults
from postwatch.schema import EMPLOYERS, POSTING_COLUMNS, POSTINGS
from postwatch.session import materialize

DAY = dt.date(2026, 7, 4)
EMPLOYER_ROWS = [
    (0, "Manitou Group", 1, "Industrie", None, ["Manitou"], None, None),
    (1, "Groupama (Loire-Bretagne)", 1, "Assurance", None, ["Groupama", "Gan"], None, None),
    (2, "Sopra Steria", 2, "ESN", None, ["Sopra"], None, None),
    (3, "Orange Business", 3, "Télécom", None, ["OBS"], None, None),
]


def posting(seq=0, **fields):
    row = dict(
        source="france_travail", external_id="1", title="Service Delivery Manager H/F",
        company="Acme", location="44 - NANTES", contract_type="CDI",
        url="https://example.com/1", ingest_seq=seq,
    )
    row.update(fields)
    return tuple(row.get(f) for f in POSTING_COLUMNS)


@pytest.fixture
def employers(spark):
    return spark.createDataFrame(EMPLOYER_ROWS, EMPLOYERS)


def plan(df):
    return df._jdf.queryExecution().toString()


# --- skew ---------------------------------------------------------------------------------
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}") for i in range(3000)]
    facts = spark.createDataFrame(rows, "id int, k string")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("zz", 4)], "k string, v int")
    got = skew.salted_join(facts, dim, ["k"], how, F.col("id"), parts=8)
    want = facts.join(dim, "k", how)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(
        map(str, want.collect()))


def test_salted_join_deals_null_and_hot_keys_evenly(spark):
    key = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 < 3, "hot").otherwise(
        F.col("id").cast("string"))
    facts = spark.range(16_000).select("id", key.alias("k"))
    dim = spark.createDataFrame([("hot", 1)], "k string, v int").hint("merge")
    joined = skew.salted_join(facts, dim, ["k"], "left", F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert joined.filter("v = 1").count() == 8000 and joined.count() == 16_000
    assert max(sizes) < 16_000 / 8 * 2


# --- dedup --------------------------------------------------------------------------------
def test_keep_first(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(40)}", i) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ingest_seq long").repartition(7)
    kept = dedup.keep_first(df, ["k"])
    want = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, i)
    assert {r.k: r.ingest_seq for r in kept.collect()} == want
    assert "WindowGroupLimit" in plan(kept)


def test_row_cap(spark):
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(1000, 1003)] + [("c", 9)] * 4
    df = spark.createDataFrame(rows, "k string, ingest_seq long").repartition(5)
    got = dedup.row_cap(df, ["k"], {"a": 20, "b": 5}, [F.desc("ingest_seq")]).collect()
    by = lambda k: sorted(r.ingest_seq for r in got if r.k == k)
    assert by("a") == list(range(480, 500))
    assert by("b") == [1000, 1001, 1002] and len(by("c")) == 4
    assert dedup.row_cap(df, ["k"], 2, [F.desc("ingest_seq")]).count() == 6


def greedy(rows):
    urls, pairs, out = set(), set(), []
    for url, a, b, seq in sorted(rows, key=lambda r: r[3]):
        if url in urls or (a, b) in pairs:
            continue
        urls.add(url)
        pairs.add((a, b))
        out.append(seq)
    return out


@pytest.mark.parametrize("rows", [
    [("u1", "p", "1", 0), ("u1", "p", "2", 1), ("u2", "p", "2", 2), ("u3", "p", "1", 3),
     ("u2", "p", "3", 4)],
    [],
    # chain: every row shares a key with the one before
    [(f"u{i // 2}", "p", str((i + 1) // 2), i) for i in range(9)],
])
def test_greedy_small(spark, rows):
    df = spark.createDataFrame(rows, "url string, a string, b string, ingest_seq long")
    got = dedup.greedy_or_dedup(df, "url", ["a", "b"]).collect()
    assert sorted(r.ingest_seq for r in got) == greedy(rows)


@pytest.mark.parametrize("seed, hot", [(1, 0.0), (2, 0.4), (3, 0.9)])
def test_greedy_random(spark, seed, hot):
    rng = random.Random(seed)
    rows = [
        (rng.choice([f"u{rng.randrange(150)}"] * 9 + [None]),
         "hot" if rng.random() < hot else f"c{rng.randrange(12)}", f"t{rng.randrange(9)}", i)
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "url string, a string, b string, ingest_seq long")
    got = dedup.greedy_or_dedup(df, "url", ["a", "b"]).collect()
    assert sorted(r.ingest_seq for r in got) == greedy(rows)


def test_greedy_long_chain_in_few_jumps(spark, monkeypatch):
    """100,000 rows, each of which shares a key with the one before: one round of log2 jumps."""
    rounds = []
    settled = dedup._settled
    monkeypatch.setattr(dedup, "_settled", lambda df: rounds.append(settled(df)) or rounds[-1])
    n = 100_000
    df = spark.range(n).selectExpr(
        "concat('u', id div 2) url", "'p' a", "cast((id + 1) div 2 as string) b", "id ingest_seq")
    got = dedup.greedy_or_dedup(df.repartition(8), "url", ["a", "b"]).select("ingest_seq").collect()
    assert sorted(r.ingest_seq for r in got) == list(range(0, n, 2))
    assert len(rounds) == 1 and rounds[0][1] <= 19


def test_employer_candidates_grow_linearly(spark):
    """Names made of ten common words meet only where one is a phrase of the other."""
    words = [f"w{i}" for i in range(10)]
    names = [" ".join(c) for c in itertools.product(words, repeat=3)]
    companies = spark.createDataFrame([(n,) for n in names], "company_norm string")
    dim = spark.createDataFrame(
        [(i, n, 1, "", None, [], None, None) for i, n in enumerate(names)], EMPLOYERS)
    index = match.phrase_index(companies.withColumnRenamed("company_norm", "name"))
    assert index.groupBy("phrase").count().filter("count > 300").count() == 0
    assert index.join(companies, index.phrase == companies.company_norm).count() == len(names)
    got = {r.company_norm: r.employer for r in match.employer_lookup(companies, dim).collect()}
    assert got == {n: n for n in names}


def test_phrases_stand_at_word_boundaries(col):
    names = ["a", "", "c++ (ltd", "a-b c", "x+ y", "я b", "..."]
    got = col("n string", [(n,) for n in names], match._phrases(match._tokens(F.col("n"))))
    for name, phrases in zip(names, got):
        cut = {name[i:j] for i in range(len(name)) for j in range(i + 1, len(name) + 1)}
        want = {p for p in cut if p == p.strip() and re.search(
            rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])", name)}
        assert set(phrases) == want, name


def test_long_employer_names(spark):
    """More tokens than a phrase of the index has: met on the rarest phrase, then compared."""
    common = " ".join(f"c{i}" for i in range(20))
    names = [f"{common} {i} {common}" for i in range(40)]
    companies = [f"sas {n} fils" for n in names] + [f"{common} x {common}", "c3 c4", "(" * 20]
    dim = spark.createDataFrame([(i, n, 2, "", None, ["[" * 12, f"le groupe {companies[3]}"], None,
                                  None) for i, n in enumerate(names)], EMPLOYERS)
    df = spark.createDataFrame([(c,) for c in companies], "company_norm string")
    got = {r.company_norm: r.employer for r in match.employer_lookup(df, dim).collect()}
    want = {c: n for c, n in zip(companies, names)} | {companies[3]: names[0], "c3 c4": names[0]}
    assert got == want


def test_employer_match_plan_is_small(spark):
    postings = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_orderkey").alias("ingest_seq"), F.col("o_orderpriority").alias("company"))
    dim = spark.createDataFrame(EMPLOYER_ROWS, EMPLOYERS)
    text = plan(match.match_employer(postings, dim))
    assert text.count("FileScan") + text.count("Scan parquet") <= 15
    assert text.count("Exchange") <= 12


# --- state --------------------------------------------------------------------------------
def prints(spark, rows):
    df = spark.createDataFrame([posting(i, **r) for i, r in enumerate(rows)], POSTINGS)
    return df.withColumn("fingerprint", fingerprint(df.company, df.title))


def test_new_postings_skip_the_shuffle(spark, tmp_path):
    """The filter kept beside the log lets through all that was seen and little else."""
    log = state.SeenLog(spark, str(tmp_path))
    for run in range(3):
        log.append(prints(spark, [{"title": f"t{i}"} for i in range(run * 40, run * 40 + 60)]), run,
                   dt.date(2026, 7, 1))
    batch = prints(spark, [{"title": f"t{i}"} for i in range(600)])
    found = log.seen_filter(2)
    passed = membership.maybe_in(batch, ["fingerprint"], found)
    assert 100 <= passed.count() < 120
    flags = {(r.title, r.is_known) for r in state.flag_known(
        batch, log.keys(2), filter_of_seen=found).collect()}
    assert flags == {(f"t{i}", i < 100) for i in range(600)}
    assert log.seen_filter(0).count() == 0


def test_seen_log(spark, tmp_path):
    log = state.SeenLog(spark, str(tmp_path / "seen"))
    first = prints(spark, [{}])
    new, known = state.split_new_known(first, log.keys(before=1))
    assert (new.count(), known.count()) == (1, 0)
    log.append(first, 1, dt.date(2026, 7, 1))
    repost = prints(spark, [{"external_id": "2", "title": "Service Delivery Manager (H/F)",
                             "url": "https://example.com/2"}])
    new, known = state.split_new_known(repost, log.keys(before=2))
    assert (new.count(), known.count()) == (0, 1)
    assert state.flag_known(repost, log.keys(before=2)).first().is_known
    for _ in range(2):  # a retried run leaves one copy
        log.append(repost, 2, dt.date(2026, 7, 3))
    for compacted in (False, True):
        rows = log.read().collect()
        assert len(rows) == 1
        assert (rows[0].first_seen, rows[0].last_seen) == (dt.date(2026, 7, 1), dt.date(2026, 7, 3))
        assert rows[0].url == "https://example.com/1"
        if not compacted:
            log.compact(2)
    # an older date overwrites last_seen unless the option says otherwise
    log.append(first, 3, dt.date(2026, 6, 1))
    assert log.read().first().last_seen == dt.date(2026, 6, 1)
    assert state.fold_sightings(log._rows(9), latest_date=True).first().last_seen == dt.date(
        2026, 7, 3)
    assert log.read(before=3).first().last_seen == dt.date(2026, 7, 3)


def test_twins_are_both_new_and_leave_one_row(spark, tmp_path):
    twins = prints(spark, [{"url": "a"}, {"url": "b"}])
    log = state.SeenLog(spark, str(tmp_path / "seen"))
    new, _ = state.split_new_known(twins, log.keys(before=1))
    assert new.count() == 2
    log.append(new, 1, DAY)
    assert [r.url for r in log.read().collect()] == ["a"]


def test_merge_seen_upserts(spark):
    empty = spark.createDataFrame([], state.SIGHTINGS)
    one = state.merge_seen(empty, prints(spark, [{}, {"company": "Globex"}]), 1, DAY)
    two = state.merge_seen(one, prints(spark, [{"url": "later"}]), 2, dt.date(2026, 7, 9))
    got = {r.company: (r.first_seen, r.last_seen, r.url) for r in state.as_seen(two).collect()}
    assert got == {
        "Acme": (DAY, dt.date(2026, 7, 9), "https://example.com/1"),
        "Globex": (DAY, DAY, "https://example.com/1"),
    }


# --- vocabulary scores ----------------------------------------------------------------------
HARD_TEXTS = [
    ("Pilotage ITIL, respect des SLA, delivery de services", 48),
    ("itil delivery infogérance sla kpi incident copil télécom b2b lte aws python etl airflow", 100),
    ("Développeur Java backend", 0),
    ("awsome slam", 0),
    ("émoa", 0),
]


def test_lexicon(spark):
    df = spark.createDataFrame(HARD_TEXTS, "t string, want int").withColumn(
        "id", F.monotonically_increasing_id())
    projected = df.withColumn("hard", lexicon.lexicon_score(F.col("t"), defaults.HARD_SKILLS))
    for scored in (projected, lexicon.score_lexicon(df, "t", defaults.HARD_SKILLS, "hard", "id")):
        assert all(r.hard == r.want for r in scored.collect())
    soft = df.limit(1).select(
        lexicon.lexicon_score(F.lit("Management international, anglais courant"),
                              defaults.SOFT_SKILLS))
    assert soft.first()[0] == 50


def test_lexicon_methods_agree(spark):
    rng = random.Random(4)
    words = ["sla", "itil", "agile", "sql", "power", "bi", "gestion", "de", "projet", "é", "x-sla"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(300)]
    df = spark.createDataFrame(texts, "id int, t string")
    a = {r.id: r.s for r in df.withColumn(
        "s", lexicon.lexicon_score(F.col("t"), defaults.HARD_SKILLS)).collect()}
    b = {r.id: r.s for r in lexicon.score_lexicon(
        df, "t", defaults.HARD_SKILLS, "s", "id").collect()}
    low = {i: min(100, sum(w for p, w in defaults.HARD_SKILLS.items() if re.search(p, t.lower())))
           for i, t in texts}
    assert a == b == low


def test_lexicon_of_5000_phrases(spark):
    """Phrases of one to four words next to any separators, without a regex per pattern."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)] + ["été", "œuvre", "a_b"]
    many = {}
    while len(many) < 5000:
        phrase = " ".join(rng.choices(words, k=rng.randrange(1, 5)))
        many[rf"\b{phrase}\b"] = rng.randrange(1, 9)
    between = [" ", " ", " ", "  ", ", ", "\n", " \n ", "-", "\xa0"]
    texts = [(i, "".join(rng.choice(words).upper() + rng.choice(between)
                         for _ in range(rng.randrange(15)))) for i in range(60)] + [(60, "")]
    df = spark.createDataFrame(texts, "id int, t string")
    scored = lexicon.score_lexicon(df, "t", many, "s", "id", cap=10**6)
    assert "rlike" not in plan(scored).lower()
    want = {i: sum(w for p, w in many.items() if re.search(p, t.lower())) for i, t in texts}
    assert {r.id: r.s for r in scored.collect()} == want


# --- employers and titles -------------------------------------------------------------------
def naive_match(company, rows):
    name = normalize_py(company)
    if not name:
        return None
    inside = lambda n, h: re.search(
        rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])", h) is not None
    for _, emp, tier, _, _, aliases, *_ in rows:
        names = [c for c in map(normalize_py, [emp, *(aliases or [])]) if c]
        if any(inside(c, name) or inside(name, c) for c in names):
            return (emp, tier)
    return None


def test_employers(spark):
    extra = [
        (4, "C++ (Ltd)", 2, "", None, None, None, None),
        (5, "Яндекс", 3, "", None, ["Yandex N.V."], None, None),
        (6, "...", 3, "", None, [], None, None),
    ]
    rows = EMPLOYER_ROWS + extra
    companies = [
        "MANITOU", "Manitou Group", "Morgan Stanley", "Boulangerie Dupont", "", "Sopra Steria",
        "Groupe Gan Assurances", "group", "business", "Orange", "c++", "c", "Яндекс Go", "ООО",
        "Ltd", "manitou-group sas", "Loire-Bretagne", "OBS.", "JOBS", None, "n.v", "yandex n v",
    ]
    df = spark.createDataFrame(
        [(i, c) for i, c in enumerate(companies)], "ingest_seq int, company string")
    got = match.match_employer(
        df, spark.createDataFrame(rows, EMPLOYERS)).collect()
    assert len(got) == len(companies)
    for r in got:
        want = naive_match(r.company or "", rows)
        assert (want or (None, None)) == (r.employer, r.employer_tier), r.company
    dim = spark.createDataFrame(rows, EMPLOYERS)
    text = plan(match.match_employer(df, dim))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_employers_random(spark):
    rng = random.Random(9)
    words = ["group", "sa", "a1", "ab", "x", "gan", "or", "é"]
    name = lambda: rng.choice(" -./").join(rng.choices(words, k=rng.randrange(1, 4)))
    rows = [(i, name(), rng.randrange(1, 4), "", None, [name(), name()], None, None)
            for i in range(25)]
    companies = [(i, name()) for i in range(400)]
    got = match.match_employer(
        spark.createDataFrame(companies, "ingest_seq int, company string"),
        spark.createDataFrame(rows, EMPLOYERS)).collect()
    for r in got:
        assert (r.employer, r.employer_tier) == (
            naive_match(r.company, rows) or (None, None)), r.company


def test_tier_score(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "t int")
    assert [r[0] for r in df.select(match.tier_score(F.col("t"))).collect()] == [100, 80, 60, 50]


def test_titles(spark):
    titles = ["Service Delivery Manager H/F", "Responsable des Opérations Services",
              "Cheffe de projets IT", "Comptable fournisseurs", "", "PMO"] * 3
    df = spark.createDataFrame(list(enumerate(titles)), "ingest_seq int, title string")
    got = {r.title: r.title_match for r in match.match_titles(
        df, [*defaults.TARGET_TITLES, " . "]).collect()}
    assert got["Service Delivery Manager H/F"] == 100 and got["PMO"] == 100
    assert got["Responsable des Opérations Services"] == 100
    assert got["Cheffe de projets IT"] == 82.4 and got["Comptable fournisseurs"] == 52.8
    assert got[""] == 0
    for title, value in got.items():
        norm = normalize_py(title)
        if not any(t in norm for t in defaults.TARGET_TITLES):
            best = max(SequenceMatcher(None, norm, t).ratio() for t in defaults.TARGET_TITLES)
            assert value == round(best * 100, 1)
    lookup = match.title_lookup(
        df.select(match.normalize(F.col("title")).alias("title_norm")), defaults.TARGET_TITLES)
    assert lookup.count() == len(got)


def test_matched_characters_by_definition():
    rng = random.Random(12)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab ce", k=rng.randrange(14))) for _ in range(2))
        ratio = 2 * match.matched_characters(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert ratio == SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)


def test_few_title_pairs_are_compared_twice(spark):
    """The bound by shared characters never excludes the best target, and leaves few others."""
    rng = random.Random(6)
    words = ["data", "chef", "projet", "service", "manager", "delivery", "ops", "qualité", "web"]
    name = lambda n: " ".join(rng.choices(words, k=n))
    targets = match.clean_targets([name(rng.randrange(1, 5)) for _ in range(60)])
    titles = sorted({normalize_py(name(rng.randrange(1, 7)) + rng.choice(["", " x", " 12"]))
                     for _ in range(300)})
    df = spark.createDataFrame([(t,) for t in titles], "title_norm string")
    pairs = match.fuzzy_pairs(df, targets).collect()
    assert sum(len(r.others) for r in pairs) < 0.3 * len(titles) * len(targets)
    got = {r.title_norm: r.fuzzy for r in match.fuzzy_lookup(df, targets).collect()}
    want = {t: round(max(SequenceMatcher(None, t, w, autojunk=False).ratio() for w in targets) * 100, 1)
            for t in titles if not any(w in t for w in targets)}
    assert got == want
    text = plan(match.fuzzy_lookup(df, targets))
    assert text.count("Exchange") <= 2 * text.count("Exchange hashpartitioning")


# --- scoring ------------------------------------------------------------------------------
def test_score(spark, employers):
    rows = [
        posting(1, description="Pilotage delivery, SLA, ITIL, management d'équipe, anglais courant"),
        posting(2, title="Responsable des Opérations Services", company="Manitou Group",
                location="Ancenis, France", source="careers_site",
                description="Encadrement des opérations de service après-vente"),
        posting(3, company="ESN Quelconque"),
    ]
    df = spark.createDataFrame(rows, POSTINGS)
    scored = score.score_postings(df, employers)
    a, b, c = sorted(scored.collect(), key=lambda r: r.ingest_seq)
    parts = lambda r: (r.hard_skills, r.title_match, r.soft_skills,
                       r.location_score, r.tier_score, r.score)
    assert parts(a) == (58, 100, 35, 90, 50, 73.5) and "titre exact" in a.match_reason
    assert parts(b) == (0, 100, 10, 75, 100, 61.0) and b.match_reason.startswith("P1 cible")
    assert c.score == 59.2
    kept = lambda *t: {r.ingest_seq for r in score.retain(scored, *t).collect()}
    assert kept(65, 50) == {1, 2} and kept(65, 65) == {1} and kept(50, 65) == {1, 3}
    assert [r.ingest_seq for r in score.top(scored, 2).collect()] == [1, 2]
    keyed = scored.withColumn("k", score.rank_key()).orderBy("k").collect()
    assert [r.ingest_seq for r in keyed] == [r.ingest_seq for r in score.rank(scored).collect()]


def test_filters(spark):
    rows = [posting(1, posted_at=DAY), posting(2, posted_at=dt.date(2026, 6, 1), source="apec_rss"),
            posting(3, source="careers_site", title="PMO", description=""),
            posting(4, source="careers_site", description="x")]
    df = spark.createDataFrame(rows, POSTINGS)
    ids = lambda d: sorted(r.ingest_seq for r in d.collect())
    now = dt.datetime(2026, 7, 6, 12)
    assert ids(filters.recency_filter(df, now, days=3)) == [1]
    assert ids(filters.search_filter(df, ["pmo", "zzz"])) == [3]
    assert ids(filters.search_filter(df, [], isin={"source": ["apec_rss"]})) == [2]
    assert ids(filters.select_sources(df, ["apec", "careers_sites"])) == [2, 3, 4]
    with pytest.raises(ValueError):
        filters.select_sources(df, ["nope"])
    assert ids(filters.needs_enrichment(df)) == [3]
    with pytest.raises(ValueError):
        filters.zone_filter(df, "nope")


# --- publishing -----------------------------------------------------------------------------
def scored_rows(spark, rows):
    df = spark.createDataFrame([posting(i, **r) for i, r in enumerate(rows)], POSTINGS)
    return df.withColumns({
        "score": F.lit(70.5), "employer_tier": F.lit(None).cast("int"),
        "employer": F.lit(None).cast("string"), "match_reason": F.lit("titre exact")})


def test_offer_row(spark):
    df = scored_rows(spark, [{"salary_min": 40, "salary_max": 50, "contract_type": None,
                              "location": "", "posted_at": dt.date(2026, 6, 29)}])
    df = df.withColumn("employer_tier", F.lit(2))
    assert tuple(publish.offer_rows(df, DAY).first()) == (
        "04/07/2026", "Acme (P2)", "Service Delivery Manager H/F", "n.c.", "n.c.", "40–50 k€",
        "5 jours", "https://example.com/1", "France Travail", "titre exact", "Nouvelle", 0.7)


def test_append_is_idempotent(spark, tmp_path):
    table = publish.OfferTable(spark, str(tmp_path / "offers"))
    batch = scored_rows(spark, [
        {"url": "u1", "company": "A", "title": "x"}, {"url": "u1", "company": "B", "title": "x"},
        {"url": "u2", "company": "a (P1) — site", "title": "X (h/f)"},
        {"url": "u3", "company": "C", "title": "x"}])
    for _ in range(2):
        assert sorted(r.url for r in table.append(batch, 1, DAY).collect()) == ["u1", "u3"]
    assert table.append(batch.filter("company <> 'B'"), 2, DAY).count() == 0
    assert table.read().count() == 2


def test_best_score_is_published_first(spark, tmp_path):
    batch = scored_rows(spark, [{"url": "u1", "company": "A"}, {"url": "u1", "company": "B"}])
    batch = batch.withColumn("score", F.when(F.col("company") == "B", 90.1).otherwise(70.0))
    table = publish.OfferTable(spark, str(tmp_path / "offers"))
    assert [r.employer for r in table.append(batch, 1, DAY).collect()] == ["B"]


def test_employer_status(spark, employers):
    rows = [(0, "Manitou Group (P1)", ""), (1, "Groupama", "À cibler"), (2, "Sopra", "Entretien"),
            (3, "Orange Business", ""), (4, "Inconnu", ""), (5, "manitou", None)]
    tracker = spark.createDataFrame(
        [(*r, "avant", "après") for r in rows],
        "row_id int, employer string, status string, last_action string, next_action string")
    touched = spark.createDataFrame(
        [("Manitou Group",), ("Groupama (Loire-Bretagne)",), ("Sopra Steria",)], "employer string")
    got = publish.update_employer_status(tracker, touched, employers, DAY).orderBy("row_id")
    rows = got.collect()
    assert [r.changed for r in rows] == [True, True, False, False, False, True]
    assert rows[0].status == "Offre repérée" and rows[0].employer == "Manitou Group (P1)"
    assert rows[0].last_action == "Offre détectée le 04/07/2026"
    assert (rows[2].status, rows[2].last_action) == ("Entretien", "avant")
    counts = {r.label: r.n for r in stats.status_counts(got).collect()}
    assert counts["Offre repérée"] == 3 and counts["Entretien"] == 1
    assert counts["Refus"] == 0 and counts["Total cibles"] == 6


def test_sources(spark):
    df = spark.createDataFrame(
        [("jobspy_indeed",), ("jobspy_google",), ("apec_rss",)], "source string")
    run = stats.source_stats(df, ["jobspy", "apec", "careers_sites"], errored=["careers_sites"])
    assert [(r.source, r.n, r.ok) for r in run.orderBy("ord").collect()] == [
        ("jobspy", 2, True), ("apec", 1, True), ("careers_sites", 0, False)]
    previous = spark.createDataFrame(
        [("France Travail", "7", "OK", "01/07/2026"), ("Sites carrières", "3", "OK", "02/07/2026")],
        "label string, n string, ok_label string, last_ok string")
    board = publish.source_status(previous, run, DAY).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in board] == [
        ("jobspy (Indeed / Google)", "2", "OK", "04/07/2026"),
        ("France Travail", "7", "OK", "01/07/2026"),
        ("APEC (RSS)", "1", "OK", "04/07/2026"),
        ("Sites carrières", "0", "NOK", "02/07/2026")]


def test_report(spark, employers):
    df = spark.createDataFrame([posting(i) for i in range(5)], POSTINGS)
    scored = score.score_postings(df, employers)
    flags = scored.select(F.lit(False).alias("is_known"), F.lit(True).alias("is_retained"),
                          F.lit(False).alias("is_appended"))
    row = stats.daily_report(stats.funnel(flags), scored).first()
    assert (row.collected, row.new, row.retained, row.others, len(row.top)) == (5, 5, 5, 2, 3)
    assert row.top[0].startswith("[ 59.2] Service Delivery Manager H/F — Acme (44 - NANTES)")
    head = stats.sample_head(df.withColumn("description", F.lit("x" * 200))).collect()
    assert [len(r.description) for r in head] == [151] * 3


# --- session --------------------------------------------------------------------------------
def test_scratch_folder_is_the_one_the_session_names(spark):
    from types import SimpleNamespace

    from postwatch import session

    def fake(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder),
                               sparkContext=SimpleNamespace(master=master))

    assert session.scratch_root(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        session.scratch_root(fake("yarn", None))
    assert session.scratch_root(spark) == session.scratch_root(spark)
    kept = session.materialize(spark.range(5).toDF("x"), "t")
    assert kept.count() == 5 and session.scratch_root(spark) in kept.inputFiles()[0]


def test_small_input_is_dealt_out_and_large_left_alone(spark, tmp_path):
    from postwatch.session import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 9, 1, 1), "id").rdd.getNumPartitions() == cores
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, cores).write.parquet(path)
    large = spark.read.parquet(path)
    assert spread(large, "id") is large
