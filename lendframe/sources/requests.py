"""Request tables for the circulation jobs, derived from the given tables.

Each request carries `seq`, a unique number that fixes the order in which a front desk would have served it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.schema import TableSet
from lendframe.sources.star_views import AS_OF, read


def pair_requests(spark: SparkSession, sf_dir: str, lib: TableSet) -> DataFrame:
    """(seq, book_id, member_id): one per event. Signups are not members yet; a few books do not exist."""
    n_books = lib.books.agg(F.count(F.lit(1))).scalar()
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 7 % (n_books + 20)).alias("book_id"),
        F.when(F.col("event_type") == "signup", -1 - F.col("user_id")).otherwise(F.col("user_id")).alias("member_id"),
    )


def return_requests(lib: TableSet) -> DataFrame:
    """Every open loan once, every twice-renewed loan as well (repeats and already returned), unknown ids."""
    loan, renewed = F.col("loan_id"), F.col("renewed_count")
    open_loans = lib.loans.where(F.col("return_date").isNull())
    return (
        open_loans.select((loan * 4).alias("seq"), "loan_id")
        .unionByName(lib.loans.where(renewed == 2).select((loan * 4 + 1).alias("seq"), "loan_id"))
        .unionByName(open_loans.where(renewed == 1).select((loan * 4 + 2).alias("seq"), (-loan - 1).alias("loan_id")))
    )


def renew_requests(lib: TableSet) -> DataFrame:
    """Every open loan one to three times, twice-renewed closed loans, unknown ids."""
    loan, renewed = F.col("loan_id"), F.col("renewed_count")
    open_loans = lib.loans.where(F.col("return_date").isNull())
    times = F.explode(F.sequence(F.lit(1), (1 + loan % 3).cast("int")))
    closed = lib.loans.where(F.col("return_date").isNotNull() & (renewed == 2))
    return (
        open_loans.select("loan_id", times.alias("i"))
        .select((loan * 5 + F.col("i")).alias("seq"), "loan_id")
        .unionByName(closed.select((loan * 5).alias("seq"), "loan_id"))
        .unionByName(open_loans.where(renewed == 1).select((loan * 5 + 4).alias("seq"), (-loan - 1).alias("loan_id")))
    )


def pay_requests(lib: TableSet) -> DataFrame:
    """Every fine once, fines above 5.00 twice, unknown ids for the paid ones."""
    fine = F.col("fine_id")
    return (
        lib.fines.select((fine * 3).alias("seq"), "fine_id")
        .unionByName(lib.fines.where(F.col("amount") > 5).select((fine * 3 + 1).alias("seq"), "fine_id"))
        .unionByName(lib.fines.where("paid").select((fine * 3 + 2).alias("seq"), (-fine - 1).alias("fine_id")))
    )


def cancel_requests(lib: TableSet) -> DataFrame:
    """Reservations of members who are not active, the notified ones among them twice, unknown ids."""
    res = F.col("reservation_id")
    lapsed = lib.members.where(F.col("status") != "active").select("member_id")
    gone = lib.reservations.join(lapsed, "member_id", "left_semi")
    return (
        gone.select((res * 3).alias("seq"), "reservation_id")
        .unionByName(gone.where("notified").select((res * 3 + 1).alias("seq"), "reservation_id"))
        .unionByName(
            gone.where(~F.col("notified")).select((res * 3 + 2).alias("seq"), (-res - 1).alias("reservation_id"))
        )
    )


def notify_requests(lib: TableSet) -> DataFrame:
    """The head of every queue twice, unknown ids for the second in line."""
    res, place = F.col("reservation_id"), F.col("queue_position")
    return (
        lib.reservations.where(place == 1)
        .select(F.explode(F.array(res * 3, res * 3 + 1)).alias("seq"), "reservation_id")
        .unionByName(
            lib.reservations.where(place == 2).select((res * 3 + 2).alias("seq"), (-res - 1).alias("reservation_id"))
        )
    )


def new_books(lib: TableSet) -> DataFrame:
    """A new edition of every book as a form would send it: text years, missing copies, some known isbns."""
    year, book = F.col("year_published"), F.col("book_id")
    return lib.books.select(
        book.alias("seq"),
        F.when(year >= 1990, F.col("isbn")).otherwise(F.concat(F.lit("N"), book.cast("string"))).alias("isbn"),
        "title",
        "author",
        F.when(year != 1960, F.col("genre")).alias("genre"),
        F.when(year < 1955, " ").when(year >= 1960, year.cast("string")).alias("year_published"),
        F.when(year < 1980, F.col("total_copies")).alias("total_copies"),
    )


def new_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers asking for a membership; those in debt repeat a customer's address."""
    name, key, debt = F.col("s_name"), F.col("s_suppkey"), F.col("s_acctbal") < 0
    customer = F.concat(F.lit("customer#"), F.lpad(key.cast("string"), 9, "0"))
    return read(spark, sf_dir, "supplier").select(
        key.alias("seq"),
        name.alias("full_name"),
        F.concat(F.when(debt, customer).otherwise(F.lower(name)), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.when(F.col("s_nationkey") < 8, "").when(F.col("s_nationkey") < 16, "2003-05-06").alias("expiry_date"),
        F.when(F.col("s_acctbal") > 3000, "premium").when(F.col("s_acctbal") < -500, "gold").alias("membership_type"),
        F.when(F.col("s_acctbal") > 6000, "suspended").alias("status"),
    )


def book_updates(lib: TableSet) -> DataFrame:
    """Two updates per book: first the copies drop to the year's last digit, then the title changes alone."""
    book, year = F.col("book_id"), F.col("year_published")
    kept = ["book_id", "author", "genre"]
    first = lib.books.select(
        (book * 2).alias("seq"), *kept, "title",
        year.cast("string").alias("year_published"),
        (year % 10).cast("int").alias("total_copies"),
    )
    second = lib.books.select(
        (book * 2 + 1).alias("seq"), *kept,
        F.when(year != 1970, F.concat("title", F.lit(" (revised)"))).alias("title"),
        F.lit("").alias("year_published"),
        F.lit(None).cast("int").alias("total_copies"),
    )
    return first.unionByName(second)


def member_updates(lib: TableSet) -> DataFrame:
    """Status toggle of every member; students leave the expiry blank; unknown ids for expired members."""
    member, status = F.col("member_id"), F.col("status")
    toggled = lib.members.select(
        (member * 2).alias("seq"), "member_id", "full_name", "email", "phone",
        F.when(F.col("membership_type") == "student", " ")
        .otherwise(F.col("expiry_date").cast("string"))
        .alias("expiry_date"),
        "membership_type",
        F.when(status == "active", "suspended").otherwise("active").alias("status"),
    )
    unknown = lib.members.where(status == "expired").select(
        (member * 2 + 1).alias("seq"), (-member - 1).alias("member_id"), "full_name", "email", "phone",
        F.col("expiry_date").cast("string").alias("expiry_date"), "membership_type", "status",
    )
    return toggled.unionByName(unknown)


def email_updates(lib: TableSet) -> DataFrame:
    """New addresses: that of the next member for every fifth one, the same for every seventh, an own one for all others."""
    member = F.col("member_id")
    email = (
        F.when(member % 5 == 0, F.concat(F.lit("customer#"), F.lpad((member + 1).cast("string"), 9, "0"), F.lit("@example.com")))
        .when(member % 7 == 0, F.lit("shared@example.com"))
        .otherwise(F.concat(F.lit("m"), member.cast("string"), F.lit("@example.com")))
    )
    return lib.members.select(
        member.alias("seq"), "member_id", "full_name", email.alias("email"), "phone",
        F.col("expiry_date").cast("string").alias("expiry_date"), "membership_type", "status",
    )


def settled(lib: TableSet) -> TableSet:
    """The library after every third member has brought all books back and paid all fines."""
    free = F.col("member_id") % 3 == 0
    back = F.when(free & F.col("return_date").isNull(), F.lit(AS_OF)).otherwise(F.col("return_date"))
    return lib.with_tables(
        loans=lib.loans.withColumn("return_date", back), fines=lib.fines.withColumn("paid", F.col("paid") | free)
    )


def faulty(lib: TableSet) -> TableSet:
    """The library with faults of every kind that the audits look for."""
    book, member, loan = F.col("book_id"), F.col("member_id"), F.col("loan_id")

    def spoiled(df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns({name: new.cast(df.schema[name].dataType) for name, new in columns.items()})

    return lib.with_tables(
        books=spoiled(
            lib.books,
            year_published=F.when(book % 9 == 0, -F.col("year_published")).otherwise(F.col("year_published")),
            title=F.when(book % 11 != 0, F.col("title")),
            author=F.when(book % 8 == 0, F.repeat("author", F.lit(40))).otherwise(F.col("author")),
            isbn=F.when(book % 4 == 0, "978").otherwise(F.col("isbn")),
        ),
        members=spoiled(
            lib.members.unionByName(lib.members.where(member % 10 == 1)),
            email=F.when(member % 6 == 0, "one@example.com").otherwise(F.col("email")),
            membership_type=F.when(member % 8 == 0, "gold").otherwise(F.col("membership_type")),
            status=F.when(member % 9 == 0, None).when(member % 10 == 0, "asleep").otherwise(F.col("status")),
        ),
        loans=spoiled(
            lib.loans,
            book_id=F.when(loan % 17 == 0, -1 - book).otherwise(book),
            member_id=F.when(loan % 19 != 0, member),
        ),
        fines=spoiled(
            lib.fines,
            amount=F.when(loan % 5 == 0, -F.col("amount")).otherwise(F.col("amount")),
            loan_id=F.when(loan % 23 == 0, -1 - loan).otherwise(loan),
        ),
        reservations=spoiled(
            lib.reservations,
            queue_position=F.when(F.col("queue_position") == 2, 1).otherwise(F.col("queue_position")),
            member_id=F.when(member % 12 == 0, -member).otherwise(member),
        ),
    )


def book_links(lib: TableSet) -> DataFrame:
    """(node, target): four of five books point to another one, or to none that there is; some in a circle."""
    book, n = F.col("book_id"), lib.books.agg(F.count(F.lit(1))).scalar()
    return lib.books.where(book % 5 != 0).select(book.alias("node"), ((book * 7 + 3) % n).alias("target"))


def search_terms(spark: SparkSession, sf_dir: str, lib: TableSet) -> DataFrame:
    """(term): the first word of every title, four and two last digits of every supplier, three letters of every nation."""
    titles = lib.books.select(F.initcap(F.substring_index("title", " ", 1)).alias("term"))
    names = read(spark, sf_dir, "supplier").select(F.explode(F.array(F.right("s_name", F.lit(4)), F.right("s_name", F.lit(2)))).alias("term"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.substring("n_name", 2, 3).alias("term"))
    return titles.unionByName(names).unionByName(nations).distinct()


def circulation_feed(lib: TableSet) -> DataFrame:
    """One issue per loan, one renewal per renewed loan, one return per closed loan, as timestamped events."""
    loan = F.col("loan_id")

    def step(df: DataFrame, offset: int, day: str, action: str) -> DataFrame:
        return df.select(
            (loan * 3 + offset).alias("event_id"),
            F.col(day).cast("timestamp").alias("ts"),
            "book_id",
            "member_id",
            F.lit(action).alias("action"),
        )

    return (
        step(lib.loans, 0, "loan_date", "issue")
        .unionByName(step(lib.loans.where(F.col("renewed_count") > 0), 1, "due_date", "renew"))
        .unionByName(step(lib.loans.where(F.col("return_date").isNotNull()), 2, "return_date", "return"))
    )
