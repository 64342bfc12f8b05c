"""Add, change and delete books and members, a whole request table at a time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.grouped import latest_per_key
from lendframe.operators import jobs
from lendframe.operators.jobs import JobResult, blank, decided, first_reason, numbered_after
from lendframe.schema import MEMBER_STATES, MEMBERSHIP_DAYS, MEMBERSHIP_TYPES, TableSet, conform


def _year() -> Column:
    """A form's year text as a number; blank or unreadable text gives NULL."""
    return F.trim("year_published").try_cast("short")


def _bad_year() -> Column:
    return ~blank("year_published") & (_year().isNull() | (_year() <= 0))


def _missing(*columns: str) -> Column:
    found = F.lit(False)
    for name in columns:
        found = found | F.col(name).isNull()
    return found


def _unique_additions(checked: DataFrame, key: str, existing: DataFrame, duplicate: str) -> DataFrame:
    """Extend `_reason` by a uniqueness check: taken already, or by an earlier valid request of the batch."""
    taken = existing.select(key).distinct().withColumn("_taken", F.lit(True))
    firsts = (
        checked.where(F.col("_reason").isNull()).groupBy(key).agg(F.min("seq").alias("_first"))
        .join(taken, key, "left")
    )
    clash = F.col("_taken") | (F.col("seq") != F.col("_first"))
    return (
        checked.join(firsts, key, "left")
        .withColumn("_reason", F.coalesce(F.col("_reason"), first_reason((clash, duplicate))))
        .drop("_first", "_taken")
    )


def add_books(lib: TableSet, requests: DataFrame, as_of: date) -> JobResult:
    """New books: requests (seq, isbn, title, author, genre, year_published text, total_copies)."""
    checked = requests.withColumn(
        "_reason",
        first_reason(
            (_bad_year(), jobs.BAD_NUMBER),
            (_missing("isbn", "title", "author", "genre"), jobs.MISSING_FIELD),
        ),
    )
    checked = _unique_additions(checked, "isbn", lib.books, jobs.DUPLICATE_ISBN)
    copies = F.coalesce("total_copies", F.lit(1))
    accepted = numbered_after(checked.where(F.col("_reason").isNull()), "seq", lib.books, "book_id").select(
        "book_id", "isbn", "title", "author", "genre",
        _year().alias("year_published"),
        copies.alias("total_copies"),
        copies.alias("available_copies"),
        F.lit(as_of).cast("timestamp_ntz").alias("added_at"),
    )
    state = lib.with_tables(books=lib.books.unionByName(conform(accepted, "books")))
    return JobResult(state, decided(checked, ["seq", "isbn"], F.col("_reason")))


def _expiry(as_of: date) -> Column:
    a_year_on = F.date_add(F.lit(as_of), MEMBERSHIP_DAYS)
    return F.when(blank("expiry_date"), a_year_on).otherwise(F.trim("expiry_date").try_cast("date"))


def _member_checks(as_of: date) -> Column:
    return first_reason(
        (_expiry(as_of).isNull(), jobs.BAD_DATE),
        (_missing("full_name", "email", "membership_type", "status"), jobs.MISSING_FIELD),
        (
            ~F.col("membership_type").isin(MEMBERSHIP_TYPES) | ~F.col("status").isin(MEMBER_STATES),
            jobs.BAD_DOMAIN,
        ),
    )


def add_members(lib: TableSet, requests: DataFrame, as_of: date) -> JobResult:
    """New members: requests (seq, full_name, email, phone, expiry_date text, membership_type, status)."""
    filled = requests.withColumns(
        {
            "membership_type": F.coalesce("membership_type", F.lit("standard")),
            "status": F.coalesce("status", F.lit("active")),
        }
    )
    checked = filled.withColumn("_reason", _member_checks(as_of))
    checked = _unique_additions(checked, "email", lib.members, jobs.DUPLICATE_EMAIL)
    accepted = numbered_after(checked.where(F.col("_reason").isNull()), "seq", lib.members, "member_id").select(
        "member_id", "full_name", "email", "phone",
        F.lit(as_of).alias("join_date"),
        _expiry(as_of).alias("expiry_date"),
        "membership_type",
        "status",
    )
    state = lib.with_tables(members=lib.members.unionByName(conform(accepted, "members")))
    return JobResult(state, decided(checked, ["seq", "email"], F.col("_reason")))


def update_books(lib: TableSet, requests: DataFrame) -> JobResult:
    """Overwrite books: requests (seq, book_id, title, author, genre, year_published text, total_copies).

    Total minus available, the copies on loan, is the same before and after an update. So a new total is acceptable
    when it covers them, whatever else is in the batch; the last accepted request of a book wins.
    """
    current = lib.books.select("book_id", (F.col("total_copies") - F.col("available_copies")).alias("_on_loan"))
    checked = requests.join(current, "book_id", "left").withColumn(
        "_reason",
        first_reason(
            (F.col("_on_loan").isNull(), jobs.BOOK_NOT_FOUND),
            (_bad_year(), jobs.BAD_NUMBER),
            (F.col("total_copies") < F.col("_on_loan"), jobs.TOO_FEW_COPIES),
            (_missing("title", "author", "genre"), jobs.MISSING_FIELD),
        ),
    )
    accepted = checked.where(F.col("_reason").isNull()).withColumn(
        "_texts", F.struct("title", "author", "genre", _year().alias("year_published"))
    )
    final = latest_per_key(
        accepted,
        "book_id",
        "seq",
        {"_new": ("_texts", F.lit(True)), "_total": ("total_copies", F.col("total_copies").isNotNull())},
    )
    hit = F.col("_new").isNotNull()
    total = F.coalesce("_total", "total_copies")
    updated = lib.books.join(final, "book_id", "left").select(
        "book_id",
        "isbn",
        *[F.when(hit, F.col(f"_new.{n}")).otherwise(F.col(n)).alias(n)
          for n in ("title", "author", "genre", "year_published")],
        total.alias("total_copies"),
        (F.col("available_copies") + total - F.col("total_copies")).alias("available_copies"),
        "added_at",
    )
    state = lib.with_tables(books=conform(updated, "books"))
    return JobResult(state, decided(checked, ["seq", "book_id"], F.col("_reason")))


def update_members(lib: TableSet, requests: DataFrame, as_of: date) -> JobResult:
    """Overwrite members: requests (seq, member_id, and the columns of `add_members`); the last accepted one wins.

    An unknown member is accepted without effect. An email is refused that another member had before the batch, or that an
    earlier acceptable request of the batch gives to another member; an address that a member gives up is free again from
    the next batch on.
    """
    checked = requests.withColumn("_reason", _member_checks(as_of))
    checked = checked.join(lib.members.select("member_id", F.lit(True).alias("_known")), "member_id", "left")
    held = lib.members.groupBy("email").agg(F.min("member_id").alias("_low"), F.max("member_id").alias("_high"))
    others = F.col("_known") & ((F.col("_low") != F.col("member_id")) | (F.col("_high") != F.col("member_id")))
    checked = checked.join(held, "email", "left").withColumn(
        "_reason", F.coalesce("_reason", first_reason((others, jobs.DUPLICATE_EMAIL)))
    )
    firsts = checked.where(F.col("_reason").isNull() & F.col("_known")).groupBy("email")
    firsts = firsts.agg(F.min_by("member_id", "seq").alias("_first"))
    claimed = F.col("_known") & (F.col("_first") != F.col("member_id"))
    checked = checked.join(firsts, "email", "left").withColumn(
        "_reason", F.coalesce("_reason", first_reason((claimed, jobs.DUPLICATE_EMAIL)))
    )
    fresh = F.struct("full_name", "email", "phone", _expiry(as_of).alias("expiry_date"), "membership_type", "status")
    final = (
        checked.where(F.col("_reason").isNull()).groupBy("member_id").agg(F.max_by(fresh, "seq").alias("_new"))
    )
    hit = F.col("_new").isNotNull()
    changed = ("full_name", "email", "phone", "expiry_date", "membership_type", "status")
    updated = lib.members.join(final, "member_id", "left").withColumns(
        {n: F.when(hit, F.col(f"_new.{n}")).otherwise(F.col(n)) for n in changed}
    )
    state = lib.with_tables(members=conform(updated, "members"))
    return JobResult(state, decided(checked, ["seq", "member_id"], F.col("_reason")))


def delete_books(lib: TableSet, keys: DataFrame) -> TableSet:
    """Delete books with their loans, the fines of those loans, and their reservations: keys (book_id)."""
    doomed = keys.select("book_id").distinct()
    lost_loans = lib.loans.select("loan_id", "book_id").join(doomed, "book_id", "left_semi").select("loan_id")
    return lib.with_tables(
        books=lib.books.join(doomed, "book_id", "left_anti"),
        loans=lib.loans.join(doomed, "book_id", "left_anti"),
        fines=lib.fines.join(lost_loans, "loan_id", "left_anti"),
        reservations=lib.reservations.join(doomed, "book_id", "left_anti"),
    )


def delete_members(lib: TableSet, keys: DataFrame, guard: bool = False) -> JobResult:
    """Delete members with all their rows: keys (member_id). Queues are not closed up.

    With `guard`, members with open loans or unpaid fines are kept and reported.
    """
    asked = keys.select("member_id").distinct()
    if guard:
        bound = (
            lib.loans.where(F.col("return_date").isNull()).select("member_id")
            .unionByName(lib.fines.where(~F.col("paid")).select("member_id"))
            .distinct()
            .withColumn("_bound", F.lit(True))
        )
        asked = asked.join(bound, "member_id", "left")
    else:
        asked = asked.withColumn("_bound", F.lit(None).cast("boolean"))
    outcomes = decided(asked, ["member_id"], first_reason((F.col("_bound"), jobs.HAS_OBLIGATIONS)))
    doomed = asked.where(F.col("_bound").isNull()).select("member_id")
    state = lib.with_tables(
        **{
            name: df.join(doomed, "member_id", "left_anti")
            for name, df in lib.items()
            if name in ("members", "loans", "fines", "reservations")
        }
    )
    return JobResult(state, outcomes)
