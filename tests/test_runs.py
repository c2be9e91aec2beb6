import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from postwatch.functions.text import normalize_py
from postwatch.operators import publish, state
from postwatch.plans.daily import daily_run
from postwatch.schema import EMPLOYERS, POSTINGS, names
from postwatch.streaming import runs, seen
from test_operators import EMPLOYER_ROWS, posting

DAY = dt.date(2026, 7, 4)


def feed(seed=0):
    """Three days of postings with reposts, twins and excluded contracts."""
    rng = random.Random(seed)
    days = []
    for day in range(3):
        days.append([
            posting(
                day * 100 + i,
                title=rng.choice(["PMO", "PMO H/F", "Data Engineer", "Comptable", "Stage PMO"]),
                company=rng.choice(["Manitou", "Acme", "Gan", "X"]),
                location=rng.choice(["Nantes", "Lyon", ""]),
                url=f"https://x/{rng.randrange(25)}",
                source=rng.choice(["jobspy_indeed", "careers_site"]),
                contract_type=rng.choice(["CDI", "CDI", "CDI", "CDD", None]),
            )
            for i in range(30)
        ])
    return days


def expected(days):
    """Brute force of the funnel, without scores: collected, known, new per day."""
    seen, out = set(), []
    for rows in days:
        kept = [r for r in rows if r[5] != "CDD" and "Stage" not in r[2]]
        prints = [(normalize_py(r[3]), normalize_py(r[2])) for r in kept]
        known = sum(p in seen for p in prints)
        out.append((len(kept), known, len(kept) - known))
        seen |= set(prints)
    return out, seen


def test_daily_run(spark, tmp_path):
    seen = state.SeenLog(spark, str(tmp_path / "seen"))
    offers = publish.OfferTable(spark, str(tmp_path / "offers"))
    employers = spark.createDataFrame(EMPLOYER_ROWS, EMPLOYERS)
    texts = spark.createDataFrame([("https://x/1", "delivery ITIL à Rezé")],
                                  "url string, page_text string")
    days = feed()
    want, prints = expected(days)
    urls, pairs = set(), set()
    for run, rows in enumerate(days):
        args = (spark.createDataFrame(rows, POSTINGS), employers, seen, offers, run, DAY, texts)
        if run == 0:
            dry = daily_run(*args, dry_run=True)
            assert dry.published is None and seen.read().count() == 0
        for _ in range(2 if run == 1 else 1):  # a repeated run changes nothing
            result = daily_run(*args)
            report = result.report.first()
            assert (report.collected, report.already_seen, report.new) == want[run]
            fresh = [(r.url, normalize_py(r.employer.split(" (P")[0]), normalize_py(r.title))
                     for r in result.published.collect()]
        assert (report.appended or 0) == len(fresh) <= report.retained
        for url, *pair in fresh:
            assert url not in urls and tuple(pair) not in pairs
            urls.add(url)
            pairs.add(tuple(pair))
        assert {r.n for r in result.stats.collect() if r.source == "apec"} == {0}
    assert seen.read().count() == len(prints)


def test_failed_publication_loses_nothing(spark, tmp_path):
    seen = state.SeenLog(spark, str(tmp_path / "seen"))
    offers = publish.OfferTable(spark, str(tmp_path / "offers"))
    employers = spark.createDataFrame(EMPLOYER_ROWS, EMPLOYERS)
    args = (spark.createDataFrame([posting(1)], POSTINGS), employers, seen)

    class Broken(publish.OfferTable):
        def append(self, *_):
            raise OSError("down")

    with pytest.raises(OSError):
        daily_run(*args, Broken(spark, offers.root), 1, DAY, min_score=0)
    assert seen.read().count() == 0
    assert daily_run(*args, offers, 2, DAY, min_score=0).report.first().appended == 1
    assert daily_run(*args, offers, 3, DAY, min_score=0).report.first().already_seen == 1


def test_status_tables_and_alerts(spark, tmp_path):
    """Tables of a run count once it is committed; failures are alerts and change nothing."""
    log = state.SeenLog(spark, str(tmp_path / "seen"))
    offers = publish.OfferTable(spark, str(tmp_path / "offers"))
    tables = publish.StatusTables(spark, str(tmp_path / "status"))
    employers = spark.createDataFrame(EMPLOYER_ROWS, EMPLOYERS)
    tracker = [(1, "Manitou (P1)", "", "a", "b"), (2, "Gan", "Entretien", "a", "b")]
    tables.write("employers", spark.createDataFrame(tracker, publish.TRACKER_DDL), 0)
    tables.write("sources", spark.createDataFrame([], publish.SOURCES_DDL), 0)
    tables.commit(0)
    batch = spark.createDataFrame([posting(1, company="Manitou"), posting(2, company="Gan")], POSTINGS)

    def read():
        rows = tables.read("employers", publish.TRACKER_DDL).collect()
        return {r.row_id: r.status for r in rows}, tables.last_run()

    for broken in ("write", "update", "commit"):
        class Broken(publish.StatusTables):
            pass

        def fail(*_):
            raise OSError("down")

        setattr(Broken, broken, fail)
        args = (batch, employers, log, offers, 1, DAY)
        try:
            result = daily_run(*args, min_score=0, min_score_tier1=0, publication_may_fail=True,
                               status=Broken(spark, tables.root), errored={"apec": "délai"})
            alerts = result.report.first().alerts
            assert alerts[0] == "apec : collecte échouée — délai" and "down" in alerts[1]
            assert log.read().count() == 0
        except OSError:
            assert broken == "commit"
        assert read() == ({1: "", 2: "Entretien"}, 0)
    result = daily_run(batch, employers, log, offers, 1, DAY, status=tables, min_score=0,
                       min_score_tier1=0)
    assert result.report.first().alerts == []
    assert read() == ({1: "Offre repérée", 2: "Entretien"}, 1)
    counts = spark.read.parquet(f"{tables.root}/counts/run_seq=1")
    assert {r.label: r.n for r in counts.collect() if r.n} == {
        "Offre repérée": 1, "Entretien": 1, "Total cibles": 2}
    sources = {r.label: r.ok_label for r in tables.read("sources", publish.SOURCES_DDL).collect()}
    assert len(sources) == 4


def test_stream_equals_batches(spark, tmp_path):
    employers = spark.createDataFrame(EMPLOYER_ROWS, EMPLOYERS)
    landing = str(tmp_path / "landing")
    days = feed(3)
    for rows in days:
        spark.createDataFrame(rows, POSTINGS).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(POSTINGS).option("maxFilesPerTrigger", 1).parquet(landing)
    stores = {}
    for kind in ("stream", "batch"):
        stores[kind] = (state.SeenLog(spark, str(tmp_path / kind / "seen")),
                        publish.OfferTable(spark, str(tmp_path / kind / "offers")))
    runs.stream_new_postings(
        stream, employers, *stores["stream"], str(tmp_path / "cp"), lambda df, i: DAY
    ).awaitTermination()
    for run, rows in enumerate(days):
        daily_run(spark.createDataFrame(rows, POSTINGS), employers, *stores["batch"], run, DAY)
    for i in range(2):
        a, b = (sorted(map(str, stores[kind][i].read().collect())) for kind in stores)
        assert a == b and a


def sightings_of(spark, rows):
    df = spark.createDataFrame(rows, "fingerprint string, run long, seq long, day date")
    return df.selectExpr(
        "fingerprint", "run as first_run", "seq as first_seq", "day as first_seen",
        "run as last_run", "day as last_seen", "'s' as source", "'u' || seq as url",
        "'t' as title", "'c' as company").select(names(state.SIGHTINGS))


def test_stream_seen_state_over_a_restart(spark, tmp_path):
    """Flags and state of a stream that is stopped and started again equal those of plain loops."""
    rng = random.Random(2)
    rows = [(rng.choice([None, *(f"f{k}" for k in range(25))]), i // 40, i,
             None if i // 40 == 3 else dt.date(2026, 7, 1 + i // 40)) for i in range(240)]
    rows += [("hot", 5, 1000 + i, dt.date(2026, 7, 6)) for i in range(500)]
    sightings = sightings_of(spark, rows)
    landing, out, check = (str(tmp_path / name) for name in ("in", "out", "cp"))
    stream = lambda: spark.readStream.schema(state.SIGHTINGS).option(
        "maxFilesPerTrigger", 1).parquet(landing)
    for some in (range(0, 3), range(3, 7)):
        for part in some:
            # Runs come in order but for the last file, which is late; run 5 spans two files.
            wanted = sightings.filter(
                {5: "first_run = 5 and first_seq % 2 = 0", 6: "first_run = 5 and first_seq % 2 = 1"}
                .get(part, f"first_run = {part}"))
            wanted.coalesce(1).write.mode("append").parquet(landing)
        seen.stream_seen_state(stream(), out, check).awaitTermination()
    first = {}
    for fingerprint, run, *_ in rows:
        first[fingerprint] = min(run, first.get(fingerprint, run))
    got = {r.ingest_seq: r.is_known for r in seen.read_flags(spark, out).collect()}
    assert got == {seq: first[fingerprint] < run for fingerprint, run, seq, _ in rows}
    folded = seen.read_streamed_state(spark, check)
    want = state.fold_sightings(sightings)
    assert sorted(map(str, folded.collect())) == sorted(map(str, want.collect()))


def test_late_runs_fold_like_a_batch():
    rng = random.Random(3)
    rows = [dict(first_run=rng.randrange(5), first_seq=i, first_seen=i, last_seen=i, source=i,
                 url=i, title=i, company=i) for i in range(60)]
    for row in rows:
        row["last_run"] = row["first_run"]
    merged = None
    for row in rows:
        merged = seen.merge(merged, row)
    least = min(rows, key=lambda r: (r["first_run"], r["first_seq"]))
    assert merged["url"] == least["url"] and merged["first_seen"] == least["first_seen"]
    assert merged["last_run"] == max(r["last_run"] for r in rows)


def test_stream_forgets_after_the_ttl(spark, tmp_path):
    landing, out, check = (str(tmp_path / name) for name in ("in", "out", "cp"))
    for part in range(2):
        sightings_of(spark, [("f", part, part, DAY)]).write.mode("append").parquet(landing)
        if part:
            time.sleep(2)
        stream = spark.readStream.schema(state.SIGHTINGS).parquet(landing)
        seen.stream_seen_state(stream, out, check, dt.timedelta(seconds=1)).awaitTermination()
    assert {r.is_known for r in seen.read_flags(spark, out).collect()} == {False}


def test_seen_stream_code_unpickles_without_the_package(tmp_path):
    """The state operator's Python worker need not have this package on its path."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    blob = cloudpickle.dumps((seen.SeenProcessor(), seen.fold_locally, seen.merge))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", "import pickle, sys; pickle.loads(sys.stdin.buffer.read())"],
        input=blob, cwd=tmp_path, env=env, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()[-500:]


def test_seen_stream_runs_on_a_session_with_the_default_state_store(spark, tmp_path):
    """transformWithState needs RocksDB: the stream takes it whatever store the session names."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.unset(provider)
    try:
        landing, out, check = (str(tmp_path / name) for name in ("in", "out", "cp"))
        sightings_of(spark, [("f", 0, 0, DAY), ("f", 1, 1, DAY)]).write.parquet(landing)
        stream = spark.readStream.schema(state.SIGHTINGS).parquet(landing)
        seen.stream_seen_state(stream, out, check).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    assert sorted((r.ingest_seq, r.is_known) for r in seen.read_flags(spark, out).collect()) == [
        (0, False), (1, True)]
