"""Stream jobs: same result for any order and any cut into micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lendframe.plans import registry
from lendframe.streaming.circulation import circulation_stream
from lendframe.sources.table_store import TableStore
from lendframe.streaming.inventory import inventory_stream
from lendframe.streaming.ledger import keep_loans
from lendframe.streaming.runner import FEED, open_feed, run_available
from tests import serial
from tests.builders import DAY, dicts, library

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events():
    """240 events; book 1 gets about a third of them."""
    rnd = random.Random(9)
    rows = []
    for i in range(240):
        book = 1 if rnd.random() < 0.35 else rnd.randint(2, 5)
        action = rnd.choice(["issue", "issue", "return", "renew", "renew", "renew"])
        rows.append({"event_id": i, "ts": START + timedelta(hours=9 * i), "book_id": book,
                     "member_id": rnd.randint(1, 7), "action": action})
    return rows


def write_files(spark, events, folder, cuts):
    """One parquet file per slice; the file source takes files in order of their time stamps."""
    bounds = [0, *cuts, len(events)]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        rows = [tuple(e[f.name] for f in FEED) for e in events[a:b]]
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return f"{folder}/*"


@pytest.mark.parametrize("cuts, shuffled", [([], False), ([50, 51, 180], False), ([80, 160], True)])
def test_inventory_stream(spark, events, tmp_path, cuts, shuffled):
    sent = events + events[20:60]
    if shuffled:
        random.Random(1).shuffle(sent)
    feed = open_feed(spark, write_files(spark, sent, str(tmp_path / "feed"), cuts), files_per_batch=1)
    emitted = run_available(inventory_stream(feed, "365 days"), str(tmp_path / "run"), "update")
    last = emitted.groupBy("book_id").agg(F.max_by("copies_on_loan", "batch").alias("n")).collect()
    expected = {}
    for e in events:
        step = {"issue": 1, "return": -1}.get(e["action"])
        if step:
            expected[e["book_id"]] = expected.get(e["book_id"], 0) + step
    assert {r.book_id: r.n for r in last} == expected


def test_inventory_stream_counts_late_and_repeated_events(spark, events, tmp_path):
    """Files in turned order: most events are months behind the newest when they arrive, and some come again."""
    sent = events[160:] + events[80:160] + events[:80] + events[100:200]
    feed = open_feed(spark, write_files(spark, sent, str(tmp_path / "feed"), [80, 160, 240]), files_per_batch=1)
    emitted = run_available(inventory_stream(feed), str(tmp_path / "run"), "update")
    last = emitted.groupBy("book_id").agg(F.max_by("copies_on_loan", "batch").alias("n")).collect()
    steps = {"issue": 1, "return": -1}
    books = {e["book_id"] for e in events}
    assert {r.book_id: r.n for r in last} == {
        b: sum(steps.get(e["action"], 0) for e in events if e["book_id"] == b) for b in books
    }


@pytest.mark.parametrize("cuts, started", [([], False), ([40, 41, 150], True)])
def test_circulation_stream_equals_serial_desk(spark, events, tmp_path, cuts, started):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    small = library(
        spark,
        books=[{"total_copies": 3, "available_copies": n} for n in (3, 1, 2, 1)],
        members=[{"status": s, "membership_type": t} for s, t in [
            ("active", "standard"), ("active", "student"), ("active", "premium"), ("suspended", "standard"),
            ("active", "standard"), ("active", "student")]],
        loans=[{"book_id": 1, "member_id": 2, "renewed_count": 1}, {"book_id": 2, "member_id": 4},
               {"book_id": 1, "member_id": 3, "return_date": DAY}],
    )
    loans = small.loans if started else None
    feed = open_feed(spark, write_files(spark, events, str(tmp_path / "feed"), cuts), files_per_batch=1)
    decided = run_available(
        circulation_stream(feed, small.books, small.members, loans), str(tmp_path / "run"), "append"
    )
    rows = decided.collect()
    expected = serial.desk(
        dicts(small.books), dicts(small.members), events, dicts(small.loans) if started else ()
    )
    assert {r.event_id: (r.reason, r.due_date, r.fine) for r in rows} == expected
    assert all(r.accepted == (r.reason is None) for r in rows) and len(rows) == len(events)
    assert len({r.reason for r in rows}) == 7
    assert any(r.fine for r in rows)


@pytest.fixture
def ledger_store(spark, tmp_path):
    small = library(spark, books=[{}, {}, {}], members=[{"membership_type": t} for t in ("standard", "student", "premium")])
    store = TableStore(spark, str(tmp_path / "store"), rows_per_file=5)
    store.commit(**dict(small.items()))
    return store


def ledger_events(spark, rows):
    made = [(loan, START + timedelta(days=day), 1 + loan % 3, member, action) for loan, day, member, action in rows]
    return spark.createDataFrame(made, "loan_id long, ts timestamp, book_id long, member_id long, action string")


def test_ledger_counts_every_event_once(spark, ledger_store):
    """Batches are repeated after they were committed, and one arrives in full after a writer was lost on the way."""
    batches = [
        [(1, 0, 1, "issue"), (2, 0, 2, "issue"), (3, 1, 3, "issue"), (1, 4, 1, "renew"), (9, 4, 1, "return")],
        [(2, 9, 2, "return"), (3, 9, 3, "renew"), (3, 10, 3, "renew"), (4, 10, 7, "issue"), (5, 11, 1, "issue")],
        [(5, 12, 1, "return"), (5, 14, 1, "return"), (1, 20, 1, "renew")],
    ]
    sink = keep_loans(ledger_store, "run")
    for number, rows in enumerate(batches):
        for _ in range(2):
            sink(ledger_events(spark, rows), number)
    sink(ledger_events(spark, batches[0]), 0)
    day = START.date()
    rows = {r.loan_id: ((r.due_date - day).days, r.return_date and (r.return_date - day).days, r.renewed_count)
            for r in ledger_store.tables().loans.collect()}
    assert rows == {1: (42, None, 2), 2: (21, 9, 0), 3: (91, None, 2), 5: (25, 12, 0)}
    keep_loans(ledger_store, "other")(ledger_events(spark, [(6, 1, 1, "issue")]), 0)
    assert ledger_store.tables().loans.count() == 5


def test_a_batch_that_failed_before_its_commit_is_applied_once(spark, ledger_store, monkeypatch):
    rows = ledger_events(spark, [(1, 0, 1, "issue"), (1, 3, 1, "renew")])
    append = TableStore._append
    monkeypatch.setattr(TableStore, "_append", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        keep_loans(ledger_store, "run")(rows, 0)
    monkeypatch.setattr(TableStore, "_append", append)
    assert ledger_store.tables().loans.count() == 0
    for _ in range(3):
        keep_loans(ledger_store, "run")(rows, 0)
    assert [r.renewed_count for r in ledger_store.tables().loans.collect()] == [1]


def test_the_state_store_of_the_inventory_stream_does_not_count_its_rows(spark, monkeypatch, tmp_path):
    """counting reads every event's state a second time. The session has its own settings again afterwards."""
    name = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    feed = spark.createDataFrame([(1, START, 1, 1, "issue")], FEED)
    monkeypatch.setattr(registry.requests, "circulation_feed", lambda lib: feed)
    monkeypatch.setattr(registry.star_views, "stored_library", lambda spark, sf_dir: None)
    monkeypatch.setattr(registry, "work_dir", lambda spark: str(tmp_path / "work"))
    seen = []
    monkeypatch.setattr(registry, "run_available", lambda stream, folder, mode: seen.append(spark.conf.get(name, None)))
    before = spark.conf.get(name, None)
    registry._run_arrivals(spark, "", inventory_stream, "update")
    assert seen == ["false"] * 3 and spark.conf.get(name, None) == before
