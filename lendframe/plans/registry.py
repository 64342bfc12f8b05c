"""Every operator as a named query over the star-schema parquet tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.operators import catalogue, circulation, fines, loans, overview, people, quality, queueing, upkeep
from lendframe.operators import links, sketches, term_search, waitlist
from lendframe.operators.jobs import JobResult
from lendframe.schema import SCHEMAS, TableSet
from lendframe.sources import requests, star_views
from lendframe.sources.star_views import AS_OF
from lendframe.sources.table_store import TableStore, difference
from lendframe.sources.workspace import work_dir, written
from lendframe.streaming import ledger
from lendframe.streaming.inventory import inventory_stream
from lendframe.streaming.runner import open_feed, run_available

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the searches below: a genre, title patterns and search texts that occur in the given tables.
GENRE, TITLE_PATTERN, SEARCH_PATTERN = "PROMO", "%ring%", "%12%"

# A day of the year that members_joined_in_year asks for.
JOINED = date(1996, 6, 1)

# Books without a loan since this day count as not borrowed.
UNUSED_SINCE = date(2001, 6, 1)

# Days at which the circulation feed of the stream queries is cut into three arrivals.
FEED_CUTS = date(1998, 1, 1), date(2000, 1, 1)


class Inputs:
    """Library tables and request tables of one data folder, built on first use and shared by the queries below."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def lib(self) -> TableSet:
        return star_views.stored_library(self.spark, self.sf_dir)

    @cached_property
    def pair_requests(self) -> DataFrame:
        return requests.pair_requests(self.spark, self.sf_dir, self.lib)

    @cached_property
    def new_members(self) -> DataFrame:
        return requests.new_members(self.spark, self.sf_dir)


def _reports() -> dict[str, Callable[[TableSet], DataFrame]]:
    def fine_list(t: TableSet) -> DataFrame:
        return fines.fine_list(t.fines, t.members, t.loans, t.books)

    def loan_list(t: TableSet) -> DataFrame:
        return loans.loan_list(t.loans, t.members, t.books, AS_OF)

    def reservation_list(t: TableSet) -> DataFrame:
        return waitlist.reservation_list(t.reservations, t.members, t.books)

    return {
        "list_books": lambda t: catalogue.list_books(t.books),
        "active_members": lambda t: people.active_members(t.members, AS_OF),
        "books_by_genre_or_title": lambda t: catalogue.books_by_genre_or_title(t.books, GENRE, TITLE_PATTERN),
        "genre_counts": lambda t: catalogue.genre_counts(t.books),
        "members_joined_in_year": lambda t: people.members_joined_in_year(t.members, JOINED),
        "overdue_loans": lambda t: loans.overdue_loans(t.loans, t.members, t.books, AS_OF),
        "top_borrowed": lambda t: catalogue.top_borrowed(t.books, t.loans),
        "members_with_unpaid_fines": lambda t: people.members_with_unpaid_fines(t.members, t.fines),
        "never_borrowed": lambda t: catalogue.never_borrowed(t.books, t.loans, UNUSED_SINCE),
        "member_history": lambda t: loans.member_history(t.loans, t.books, t.fines, AS_OF),
        "return_time_by_genre": lambda t: loans.return_time_by_genre(t.loans, t.books),
        "monthly_loan_trend": lambda t: loans.monthly_loan_trend(t.loans, AS_OF),
        "trailing_borrowers": lambda t: sketches.trailing_borrowers(t.loans),
        "members_overdue_more_than": lambda t: people.members_overdue_more_than(t.loans, t.members, AS_OF),
        "fine_revenue_by_month": lambda t: fines.fine_revenue_by_month(t.fines),
        "availability": lambda t: catalogue.availability(t.books),
        "members_with_all_genres": lambda t: people.members_with_all_genres(t.members, t.loans, t.books),
        "shared_borrowers": lambda t: people.shared_borrowers(t.loans, t.members, t.books),
        "running_fines": lambda t: fines.running_fines(t.fines, t.members),
        "rank_members": lambda t: people.rank_members(t.members, t.loans),
        "moving_avg_loans": lambda t: loans.moving_avg_loans(t.loans),
        "first_last_book": lambda t: people.first_last_book(t.loans, t.members, t.books),
        "borrow_gaps": lambda t: people.borrow_gaps(t.loans, t.members, t.books),
        "fine_percentiles": lambda t: fines.fine_percentiles(t.fines, t.members),
        "reservation_chain": lambda t: waitlist.reservation_chain(t.reservations, t.members),
        "genre_by_quarter": lambda t: catalogue.genre_by_quarter(t.loans, t.books, AS_OF),
        "above_average_books": lambda t: catalogue.above_average_books(t.books, t.loans),
        "fine_forecast": lambda t: loans.fine_forecast(t.loans, t.members, t.books, AS_OF),
        "search": lambda t: overview.search(t.books, t.members, SEARCH_PATTERN),
        "cohort_retention": lambda t: people.cohort_retention(t.members, t.loans),
        "duplicate_isbns": lambda t: catalogue.duplicate_isbns(t.books),
        "rolling_fine_revenue": lambda t: fines.rolling_fine_revenue(t.fines),
        "consecutive_month_members": lambda t: people.consecutive_month_members(t.loans),
        "available_books": lambda t: catalogue.available_books(t.books),
        "loan_list": loan_list,
        "overdue_detail": lambda t: loans.overdue_detail(t.loans, t.members, t.books, AS_OF),
        "fine_list": fine_list,
        "unpaid_fine_list": lambda t: fines.unpaid_fine_list(t.fines, t.members, t.loans, t.books),
        "reservation_list": reservation_list,
        "member_list": lambda t: people.member_list(t.members),
        "rows_for_keys": lambda t: overview.rows_for_keys(t.loans, t.fines.where(~F.col("paid")), "loan_id"),
        "table_counts": overview.table_counts,
        "dashboard_stats": overview.dashboard_stats,
        "top_overdue": lambda t: loans.top_overdue(t.loans, t.members, t.books, AS_OF),
        "fine_totals": lambda t: fines.fine_totals(t.fines),
        "search_books": lambda t: overview.multi_column_search(
            catalogue.list_books(t.books), ["title", "author", "genre"], "Ring"
        ),
        "search_members": lambda t: overview.multi_column_search(
            people.member_list(t.members), ["full_name", "email", "membership_type"], "STUDENT"
        ),
        "search_loans": lambda t: overview.multi_column_search(
            loan_list(t), ["member_name", "book_title", "loan_status"], "overdue"
        ),
        "search_reservations": lambda t: overview.multi_column_search(
            reservation_list(t), ["member_name", "book_title"], "widget"
        ),
        "filter_fines": lambda t: fines.filter_fines(fine_list(t), "unpaid", "Bolt"),
        "filter_fines_paid": lambda t: fines.filter_fines(fine_list(t), "paid"),
        "filter_fines_all": lambda t: fines.filter_fines(fine_list(t), "all", "7"),
        "eligible_members": lambda t: people.eligible_members(t.members),
        "issuable_books": lambda t: catalogue.issuable_books(t.books),
        "inventory": lambda t: quality.inventory(t.books, t.loans),
        "check_domains": quality.check_domains,
        "check_unique": quality.check_unique,
        "check_references": quality.check_references,
        "check_inventory": lambda t: quality.check_inventory(t.books, t.loans),
        "check_domains_faulty": lambda t: quality.check_domains(requests.faulty(t)),
        "check_unique_faulty": lambda t: quality.check_unique(requests.faulty(t)),
        "check_references_faulty": lambda t: quality.check_references(requests.faulty(t)),
        "linked_reservations": lambda t: links.linked_reservations(t.reservations.where(F.col("reservation_id") % 7 != 0)),
        "follow_links": lambda t: links.follow_links(requests.book_links(t)),
        "one_members_history": lambda t: loans.member_history(
            t.loans, t.books, t.fines, AS_OF, t.members.where(F.col("membership_type") == "student")
        ),
    }


def _jobs() -> dict[str, Callable[[Inputs], JobResult]]:
    return {
        "issue_loans": lambda i: circulation.issue_loans(i.lib, i.pair_requests, AS_OF),
        "return_loans": lambda i: circulation.return_loans(i.lib, requests.return_requests(i.lib), AS_OF),
        "renew_loans": lambda i: circulation.renew_loans(i.lib, requests.renew_requests(i.lib)),
        "pay_fines": lambda i: circulation.pay_fines(i.lib, requests.pay_requests(i.lib), AS_OF),
        "create_reservations": lambda i: queueing.create_reservations(i.lib, i.pair_requests, AS_OF),
        "cancel_reservations": lambda i: queueing.cancel_reservations(i.lib, requests.cancel_requests(i.lib)),
        "notify_reservations": lambda i: queueing.notify_reservations(i.lib, requests.notify_requests(i.lib)),
        "add_books": lambda i: upkeep.add_books(i.lib, requests.new_books(i.lib), AS_OF),
        "add_members": lambda i: upkeep.add_members(i.lib, i.new_members, AS_OF),
        "update_books": lambda i: upkeep.update_books(i.lib, requests.book_updates(i.lib)),
        "update_members": lambda i: upkeep.update_members(i.lib, requests.member_updates(i.lib), AS_OF),
        "delete_members": lambda i: upkeep.delete_members(i.lib, _lapsed(i.lib)),
        "delete_members_guarded": lambda i: upkeep.delete_members(i.lib, _lapsed(i.lib), guard=True),
        "delete_members_settled": lambda i: upkeep.delete_members(requests.settled(i.lib), _lapsed(i.lib), guard=True),
        "update_emails": lambda i: upkeep.update_members(i.lib, requests.email_updates(i.lib), AS_OF),
    }


# The state tables each job is checked on, besides its outcomes.
JOB_TABLES = {
    "issue_loans": ["loans", "books"],
    "return_loans": ["loans", "fines", "books"],
    "renew_loans": ["loans"],
    "pay_fines": ["fines"],
    "create_reservations": ["reservations"],
    "cancel_reservations": ["reservations"],
    "notify_reservations": ["reservations"],
    "add_books": ["books"],
    "add_members": ["members"],
    "update_books": ["books"],
    "update_members": ["members"],
    "delete_members": ["members", "loans", "fines", "reservations"],
    "delete_members_guarded": ["members", "loans", "fines", "reservations"],
    "delete_members_settled": ["members", "loans", "fines", "reservations"],
    "update_emails": ["members"],
}


def _search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = star_views.stored_library(spark, sf_dir)
    return term_search.search_terms(lib.books, lib.members, requests.search_terms(spark, sf_dir, lib))


def _search_terms_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = star_views.stored_library(spark, sf_dir)
    terms = requests.search_terms(spark, sf_dir, lib)
    return term_search.rows_with_terms(catalogue.list_books(lib.books), "book_id", ["title", "author", "genre"], terms)


def _lapsed(lib: TableSet) -> DataFrame:
    return lib.members.where(F.col("status") == "expired").select("member_id")


def _without_author(lib: TableSet) -> TableSet:
    return upkeep.delete_books(lib, lib.books.where(F.col("author") == "Brand#13").select("book_id"))


def _undone_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the library, snapshot it, delete expired members, undo, and show the loans that are there."""
    lib = star_views.stored_library(spark, sf_dir)
    store = TableStore(spark, work_dir(spark))
    store.commit(**dict(lib.items()))
    store.snapshot()
    left = upkeep.delete_members(store.tables(), _lapsed(store.tables())).state
    store.commit(**{n: df for n, df in left.items() if n != "books"})
    return store.undo().loans


def _checkpoint_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the library without one author as checkpoint, go back to all books, restore it, show the loans."""
    lib = star_views.stored_library(spark, sf_dir)
    store = TableStore(spark, work_dir(spark))
    whole = store.commit(**dict(lib.items()))
    store.snapshot()
    store.commit(**{n: df for n, df in _without_author(whole).items() if n != "members"})
    store.save_checkpoint()
    store.undo()
    return store.restore_checkpoint().loans


def _all_rows(lib: TableSet) -> DataFrame:
    """(table_name, row_id, content) of every row of all tables, the content as text."""

    def rows(table: str, df: DataFrame) -> DataFrame:
        content = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in SCHEMAS[table].names])
        return df.select(F.lit(table).alias("table_name"), F.col(SCHEMAS[table][0].name).alias("row_id"), content.alias("content"))

    return reduce(DataFrame.unionByName, [rows(table, df) for table, df in lib.items()])


def _moved(store: TableStore, job: Callable[[TableSet], TableSet]) -> TableSet:
    """Bring a store to the state after a job by the change sets of its tables."""
    before = store.tables()
    now = dict(before.items())
    return store.apply(**{t: difference(t, now[t], df) for t, df in job(before).items()})


def _without_lapsed(lib: TableSet) -> TableSet:
    return upkeep.delete_members(lib, _lapsed(lib)).state


def _filled_store(spark: SparkSession, sf_dir: str) -> TableStore:
    lib = star_views.stored_library(spark, sf_dir)
    store = TableStore(spark, work_dir(spark), rows_per_file=100_000)
    store.commit(**dict(lib.items()))
    return store


def _undone_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deletions as change sets, the first one undone together with the second."""
    store = _filled_store(spark, sf_dir)
    store.snapshot()
    _moved(store, _without_lapsed)
    _moved(store, _without_author)
    return _all_rows(store.undo())


def _restored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library without one author as checkpoint, back from a later deletion of members."""
    store = _filled_store(spark, sf_dir)
    _moved(store, _without_author)
    store.save_checkpoint()
    _moved(store, _without_lapsed)
    return _all_rows(store.restore_checkpoint())


def _change_set_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables after loans were returned, of which only the changed rows were committed."""
    store = _filled_store(spark, sf_dir)
    return _all_rows(_moved(store, lambda t: circulation.return_loans(t, requests.return_requests(t), AS_OF).state))


def _inventory_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory carried on by the changes of two jobs, shown after each."""
    inputs = Inputs(spark, sf_dir)
    store = _filled_store(spark, sf_dir)
    kept, shown = quality.inventory(inputs.lib.books, inputs.lib.loans), []
    for step, job in (
        ("issue", lambda t: circulation.issue_loans(t, inputs.pair_requests, AS_OF).state),
        ("delete", _without_author),
    ):
        since = store.version()
        _moved(store, job)
        kept = quality.maintained_inventory(kept, store.changes("loans", since), store.changes("books", since))
        kept = written(kept, work_dir(spark))
        shown.append(kept.select(F.lit(step).alias("step"), "*"))
    return shown[0].unionByName(shown[1])


def _looked_up_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loans of all unpaid fines, from the files of a store that hold their ids."""
    store = _filled_store(spark, sf_dir)
    return store.lookup("loans", store.tables().fines.where(~F.col("paid")).select("loan_id"))


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the length of a stream run."""
    names = {key.replace("_", "."): value for key, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _run_arrivals(
    spark: SparkSession,
    sf_dir: str,
    job: Callable[[DataFrame], DataFrame],
    mode: str,
    arrivals: tuple[int, ...] = (0, 1, 2),
) -> DataFrame:
    """Let the circulation feed arrive in slices of time, in the order given, and take the stream up again after each.

    State is kept in at most one partition per core: unlike batch shuffles, state partitions are not merged when small. The
    store does not count its rows, which nobody asks for and which costs a second read for every event.
    """
    folder = work_dir(spark)
    feed = requests.circulation_feed(star_views.stored_library(spark, sf_dir))
    first, second = (F.lit(day).cast("timestamp") for day in FEED_CUTS)
    ts = F.col("ts")
    slices = ts < first, (ts >= first) & (ts < second), ts >= second
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with _settings(
        spark,
        spark_sql_shuffle_partitions=str(partitions),
        spark_sql_streaming_stateStore_providerClass=store,
        spark_sql_streaming_stateStore_rocksdb_trackTotalNumberOfRows="false",
    ):
        for number in arrivals:
            feed.where(slices[number]).write.mode("append").parquet(f"{folder}/feed")
            emitted = run_available(job(open_feed(spark, f"{folder}/feed")), f"{folder}/run", mode)
    return emitted


def _inventory_stream(spark: SparkSession, sf_dir: str, arrivals: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Copies on loan after the whole feed: the last value the stream emitted per book."""
    emitted = _run_arrivals(spark, sf_dir, inventory_stream, "update", arrivals)
    return emitted.groupBy("book_id").agg(F.max_by("copies_on_loan", "batch").alias("copies_on_loan"))


def _ledger_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loans of a store that began without any, after the feed came in three slices and its last batch twice."""
    lib = star_views.stored_library(spark, sf_dir)
    store = TableStore(spark, work_dir(spark))
    store.commit(**{t: df.limit(0) if t in ("loans", "fines", "reservations") else df for t, df in lib.items()})
    folder = work_dir(spark)
    feed = requests.circulation_feed(lib)
    first, second = (F.lit(day).cast("timestamp") for day in FEED_CUTS)
    ts = F.col("ts")
    for slice_ in (ts < first, (ts >= first) & (ts < second), ts >= second):
        feed.where(slice_).write.mode("append").parquet(f"{folder}/feed")
        arriving = open_feed(spark, f"{folder}/feed").withColumn("loan_id", F.expr("event_id div 3"))
        ledger.run_ledger(arriving, store, folder)
    again = feed.where(ts >= second).withColumn("loan_id", F.expr("event_id div 3"))
    ledger.keep_loans(store, "ledger")(again, 2)
    return store.tables().loans


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name, report in _reports().items():
        found[name] = lambda spark, sf_dir, report=report: report(star_views.stored_library(spark, sf_dir))
    for name, job in _jobs().items():
        found[f"{name}_outcomes"] = lambda spark, sf_dir, job=job: job(Inputs(spark, sf_dir)).outcomes
        for table in JOB_TABLES[name]:
            found[f"{name}_{table}"] = lambda spark, sf_dir, job=job, table=table: getattr(
                job(Inputs(spark, sf_dir)).state, table
            ).drop("added_at")
    for table in ("books", "loans", "fines", "reservations"):
        found[f"delete_books_{table}"] = lambda spark, sf_dir, table=table: getattr(
            _without_author(star_views.stored_library(spark, sf_dir)), table
        ).drop("added_at")
    found["search_terms"] = _search_terms
    found["search_terms_books"] = _search_terms_books
    found["snapshot_undo"] = _undone_loans
    found["checkpoint_restore"] = _checkpoint_loans
    found["undone_tables"] = _undone_tables
    found["restored_tables"] = _restored_tables
    found["change_set_tables"] = _change_set_tables
    found["inventory_maintained"] = _inventory_maintained
    found["looked_up_loans"] = _looked_up_loans
    found["add_books_dates"] = lambda spark, sf_dir: _jobs()["add_books"](Inputs(spark, sf_dir)).state.books.select(
        "book_id", F.col("added_at").cast("date").alias("added_on")
    )
    found["ledger_loans"] = _ledger_loans
    found["inventory_stream"] = _inventory_stream
    # The newest slice first, the others years behind it, and one of them a second time.
    found["inventory_stream_late"] = lambda spark, sf_dir: _inventory_stream(spark, sf_dir, (2, 0, 1, 0))
    return found
