"""Snapshot, undo, checkpoint and clean-up of the table store."""

import os

import pytest
from pyspark.sql import functions as F

from lendframe.operators.circulation import issue_loans
from lendframe.operators.quality import inventory, maintained_inventory
from lendframe.operators.upkeep import delete_books
from lendframe.schema import UNDO_DEPTH, TableSet, conform
from lendframe.sources.table_store import Changes, Conflict, NothingToRestore, TableStore, difference
from tests.builders import DAY, dicts, library


@pytest.fixture
def store(spark, lib, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.commit(**dict(lib.items()))
    return store


def same_tables(actual, expected):
    for (name, a), (_, b) in zip(actual.items(), expected.items()):
        key = b.columns[0]
        assert sorted(dicts(a), key=lambda r: r[key]) == sorted(dicts(b), key=lambda r: r[key]), name


def without_first_book(lib):
    return delete_books(lib, lib.books.where("book_id = 1"))


def test_snapshot_then_undo_is_the_identity(store, lib):
    store.snapshot()
    changed = without_first_book(store.tables())
    store.commit(books=changed.books, loans=changed.loans, fines=changed.fines, reservations=changed.reservations)
    assert store.tables().books.count() == 14
    same_tables(store.undo(), lib)
    same_tables(store.tables(), lib)
    with pytest.raises(NothingToRestore):
        store.undo()


def test_checkpoint_is_repeatable(store, lib):
    with pytest.raises(NothingToRestore):
        store.restore_checkpoint()
    store.save_checkpoint()
    for _ in range(2):
        store.commit(books=store.tables().books.where("book_id > 5"))
        assert store.restore_checkpoint().books.count() == 15


def test_only_the_latest_snapshots_are_kept(store):
    for i in range(UNDO_DEPTH + 2):
        store.snapshot()
        if i in (0, 1):
            store.commit(books=store.tables().books.where(f"book_id > {i + 1}"))
    assert store.snapshots() == UNDO_DEPTH
    for _ in range(UNDO_DEPTH):
        oldest = store.undo()
    assert oldest.books.count() == 13


def test_vacuum_keeps_what_can_be_restored(store, lib):
    store.snapshot()
    store.commit(members=store.tables().members.where("member_id > 1"))
    store.commit(members=store.tables().members.where("member_id > 2"))
    assert store.vacuum() == 0 and store.vacuum(grace_seconds=0) > 0
    assert store.tables().members.count() == 6
    same_tables(store.undo(), lib)


def test_unchanged_tables_are_not_copied(store, tmp_path):
    store.snapshot()
    store.commit(books=store.tables().books)
    assert len(list((tmp_path / "data" / "loans").iterdir())) == 1
    assert len(list((tmp_path / "data" / "books").iterdir())) == 2


def test_the_slower_of_two_writers_changes_nothing(store, spark, tmp_path):
    """Both start from the same entry; what the first has committed stays."""
    slow = TableStore(spark, str(tmp_path))
    entry = slow._last()
    store.commit(loans=store.tables().loans.where("loan_id <= 10"))
    slow._last = lambda: entry
    with pytest.raises(Conflict):
        slow.commit(loans=store.tables().loans.where("loan_id <= 3"))
    assert store.tables().loans.count() == 10


def test_a_cut_off_log_file_is_passed_over(store, tmp_path):
    left = tmp_path / "log" / "0000000002.json"
    left.write_text('{"number": 2, "curr')
    with pytest.raises(Conflict):  # its writer may still be at work
        store.snapshot()
    os.utime(left, (0, 0))
    assert store.tables().books.count() == 15
    store.snapshot()
    assert store.snapshots() == 1


@pytest.fixture
def filed(spark, tmp_path):
    """A store of 40 loans of 10 books in files of four rows."""
    small = library(
        spark,
        books=[{"title": f"t{i}", "total_copies": 5} for i in range(1, 11)],
        loans=[{"book_id": 1 + i % 10, "return_date": DAY if i % 3 else None} for i in range(40)],
        fines=[{"loan_id": i} for i in range(1, 9)],
    )
    store = TableStore(spark, str(tmp_path), rows_per_file=4)
    store.commit(**dict(small.items()))
    return store, small


def loan_rows(store):
    return {r["loan_id"]: r for r in dicts(store.tables().loans)}


def test_a_change_set_rewrites_only_the_files_it_touches(filed):
    store, small = filed
    before = store.files("loans")
    ranges = [(r["first_key"], r["last_key"]) for r in store._manifest(store.version()["loans"]).orderBy("first_key").collect()]
    assert len(before) == 10 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    since = store.version()
    picked = small.loans.where("loan_id IN (2, 39)")
    store.apply(loans=Changes(picked.withColumn("renewed_count", F.lit(2).cast("short")), small.loans.where("loan_id = 3")))
    after = store.files("loans")
    assert len(before & after) in (7, 8) and 8 <= len(after) <= 10  # of ten files two, or three if 2 and 3 are apart
    rows = loan_rows(store)
    assert set(rows) == set(range(1, 41)) - {3}
    assert {i for i, r in rows.items() if r["renewed_count"] == 2} == {2, 39}
    feed = sorted((r["change"], (r["before"] or r["after"])["loan_id"]) for r in store.changes("loans", since).collect())
    assert feed == [("delete", 3), ("update", 2), ("update", 39)]
    assert not store.changes("books", since).collect()


def test_added_rows_leave_all_files_alone(filed):
    store, small = filed
    before, since = store.files("loans"), store.version()
    more = small.loans.where("loan_id <= 6").withColumn("loan_id", F.col("loan_id") + 100)
    store.apply(loans=Changes(more), fines=Changes(deletes=small.fines.where("fine_id > 99")))
    assert before < store.files("loans") and len(loan_rows(store)) == 46
    assert {r["change"] for r in store.changes("loans", since).collect()} == {"insert"}
    assert store.tables().fines.count() == 8


def test_undo_and_vacuum_after_change_sets(filed):
    store, small = filed
    store.snapshot()
    store.apply(loans=Changes(deletes=small.loans.where("loan_id BETWEEN 5 AND 20")), books=Changes(deletes=small.books))
    assert store.tables().books.count() == 0 and store.tables().loans.count() == 24
    assert store.vacuum(0) == 0 or store.tables().loans.count() == 24
    same_tables(store.undo(), small)
    store.vacuum(0)
    same_tables(store.tables(), small)


def test_lookup_reads_the_files_of_the_keys(filed, spark):
    store, _ = filed
    found = store.lookup("loans", spark.createDataFrame([(7,), (8,), (7,), (999,)], "loan_id long"))
    assert sorted(r.loan_id for r in found.collect()) == [7, 8] and len(found.inputFiles()) <= 2
    assert not store.lookup("loans", spark.createDataFrame([], "loan_id long")).collect()
    assert not store.lookup("loans", spark.createDataFrame([(0,), (5000,)], "loan_id long")).collect()


def test_difference_leads_from_one_state_to_the_other(filed, spark):
    store, small = filed
    after = delete_books(small, small.books.where("book_id IN (2, 3)"))
    issued = issue_loans(after, spark.createDataFrame([(1, 5, 1), (2, 2, 1)], "seq long, book_id long, member_id long"), DAY).state
    changes = {t: difference(t, df, new) for (t, df), (_, new) in zip(small.items(), issued.items())}
    same_tables(store.apply(**changes), TableSet(**{t: conform(df, t) for t, df in issued.items()}))


def test_inventory_follows_the_changes(filed, spark):
    store, small = filed
    kept = inventory(small.books, small.loans)
    for change in (
        {"loans": Changes(small.loans.where("loan_id < 9").withColumn("return_date", F.lit(DAY)))},
        {"loans": Changes(small.loans.where("loan_id < 6").withColumn("loan_id", F.col("loan_id") + 50))},
        {"books": Changes(small.books.where("book_id = 4").withColumn("total_copies", F.lit(9)))},
        {"books": Changes(deletes=small.books.where("book_id = 6")), "loans": Changes(deletes=small.loans.where("book_id = 6"))},
        {"books": Changes(small.books.where("book_id = 1").withColumn("book_id", F.lit(77).cast("long")))},
        {"loans": Changes(small.loans.where("loan_id = 7").withColumn("book_id", F.lit(77).cast("long")))},
        {"members": Changes()},
    ):
        since = store.version()
        store.apply(**change)
        kept = maintained_inventory(kept, store.changes("loans", since), store.changes("books", since))
        now = store.tables()
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, inventory(now.books, now.loans).collect())), change


def test_a_change_set_is_computed_once(filed, spark):
    """However many steps read it, each of its rows is made once."""
    store, small = filed
    made = spark.sparkContext.accumulator(0)

    def counting(rows):
        for row in rows:
            made.add(1)
            yield row

    doomed = small.loans.where("loan_id IN (3, 30)").select("loan_id")
    deletes = spark.createDataFrame(doomed.rdd.mapPartitions(counting), doomed.schema)
    store.apply(loans=Changes(deletes=deletes))
    assert made.value == 2 and store.tables().loans.count() == 38


def test_rows_of_some_keys_read_only_their_files(filed, spark):
    store, small = filed
    keys = spark.createDataFrame([(2,), (39,), (99,)], "loan_id long")
    files = store._holding("loans", store._manifest(store.version()["loans"]), keys)
    assert len(files) == 2 and files < store.files("loans")
    assert {r.loan_id for r in store.lookup("loans", keys).collect()} == {2, 39}
    assert store.lookup("loans", keys.where("loan_id = 99")).count() == 0
