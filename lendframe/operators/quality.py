"""The declared constraints of the tables as audit jobs, since parquet enforces none of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.schema import MEMBER_STATES, MEMBERSHIP_TYPES, SCHEMAS, TEXT_LENGTHS, TableSet

UNIQUE_KEYS = [
    ("books", ["book_id"]),
    ("books", ["isbn"]),
    ("members", ["member_id"]),
    ("members", ["email"]),
    ("loans", ["loan_id"]),
    ("fines", ["fine_id"]),
    ("reservations", ["reservation_id"]),
    ("reservations", ["book_id", "queue_position"]),
]

REFERENCES = [
    ("loans", "book_id", "books"),
    ("loans", "member_id", "members"),
    ("fines", "loan_id", "loans"),
    ("fines", "member_id", "members"),
    ("reservations", "book_id", "books"),
    ("reservations", "member_id", "members"),
]


def _domain_rules(table: str) -> dict[str, Column]:
    """Violation conditions of a table by rule name: NOT NULL columns, text lengths, value domains."""
    rules = {f"{f.name} not null": F.col(f.name).isNull() for f in SCHEMAS[table] if not f.nullable}
    for name, longest in TEXT_LENGTHS.get(table, {}).items():
        rules[f"{name} length <= {longest}"] = F.length(name) > longest
    if table == "books":
        rules["year_published > 0"] = F.col("year_published") <= 0
    elif table == "members":
        rules["membership_type domain"] = ~F.col("membership_type").isin(MEMBERSHIP_TYPES)
        rules["status domain"] = ~F.col("status").isin(MEMBER_STATES)
    elif table == "fines":
        rules["amount > 0"] = F.col("amount") <= 0
    return rules


def check_domains(lib: TableSet) -> DataFrame:
    """Violations per table and rule, zero included; each table is read once for all its rules."""

    def audit(table: str, df: DataFrame) -> DataFrame:
        rules = _domain_rules(table)
        pairs = F.array(
            *[F.struct(F.lit(r).alias("rule"), F.count_if(cond).alias("violations")) for r, cond in rules.items()]
        )
        return df.agg(pairs.alias("found")).select(F.lit(table).alias("table_name"), F.inline("found"))

    return reduce(DataFrame.unionByName, [audit(table, df) for table, df in lib.items()])


def check_unique(lib: TableSet) -> DataFrame:
    """Per key: how many values occur more than once and how many rows are too many."""
    tables = dict(lib.items())

    def audit(table: str, key: list[str]) -> DataFrame:
        counts = tables[table].groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(
            F.lit(table).alias("table_name"),
            F.lit(", ".join(key)).alias("key_columns"),
            F.count_if(F.col("n") > 1).alias("duplicate_values"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
        )

    return reduce(DataFrame.unionByName, [audit(table, key) for table, key in UNIQUE_KEYS])


def check_references(lib: TableSet) -> DataFrame:
    """Rows per foreign key whose target does not exist. Keys are counted before they are looked up."""
    tables = dict(lib.items())

    def audit(table: str, column: str, target: str) -> DataFrame:
        used = tables[table].groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        orphans = used.join(tables[target].select(column), column, "left_anti")
        return orphans.agg(
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.lit(target).alias("target"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
        )

    return reduce(DataFrame.unionByName, [audit(*ref) for ref in REFERENCES])


def inventory(books: DataFrame, loans: DataFrame) -> DataFrame:
    """Copies on loan and available per book, from the loans themselves."""
    out = loans.where(F.col("return_date").isNull()).groupBy("book_id").agg(F.count(F.lit(1)).alias("out"))
    on_loan = F.coalesce("out", F.lit(0)).cast("int")
    return (
        books.select("book_id", "total_copies")
        .join(out, "book_id", "left")
        .select(
            "book_id",
            "total_copies",
            on_loan.alias("copies_on_loan"),
            (F.col("total_copies") - on_loan).alias("available_copies"),
        )
    )


def maintained_inventory(inventory: DataFrame, loan_changes: DataFrame, book_changes: DataFrame) -> DataFrame:
    """The inventory after some changes, from the one before and the changes alone: (change, before, after) of loans and of
    books, as the table store tells them. A loan counts while it has no return date."""
    stock = inventory.select("book_id", "total_copies", F.col("copies_on_loan").cast("long").alias("on_loan"))
    gone, come = (
        loan_changes.where(F.col(f"{side}.loan_id").isNotNull() & F.col(f"{side}.return_date").isNull()).select(
            F.col(f"{side}.book_id").alias("book_id"), F.lit(None).cast("int").alias("total_copies"), F.lit(step).cast("long").alias("on_loan")
        )
        for side, step in (("before", -1), ("after", 1))
    )
    totals = book_changes.where("change <> 'delete'").select("after.book_id", F.col("after.total_copies").alias("new_total"))
    deleted = book_changes.where("change = 'delete'").select("before.book_id")
    counted = stock.unionByName(gone).unionByName(come).groupBy("book_id").agg(
        F.max("total_copies").alias("old_total"), F.sum("on_loan").cast("int").alias("copies_on_loan")
    )
    counted = counted.join(deleted, "book_id", "left_anti").join(totals, "book_id", "full")
    total, on_loan = F.coalesce("new_total", "old_total"), F.coalesce("copies_on_loan", F.lit(0))
    return counted.where(total.isNotNull()).select(
        "book_id", total.alias("total_copies"), on_loan.alias("copies_on_loan"), (total - on_loan).alias("available_copies")
    )


def check_inventory(books: DataFrame, loans: DataFrame) -> DataFrame:
    """Books whose stored availability differs from what their open loans imply."""
    implied = inventory(books, loans).select("book_id", F.col("available_copies").alias("implied"))
    stored = books.select("book_id", F.col("available_copies").alias("stored"))
    return (
        stored.join(implied, "book_id")
        .where(F.col("stored") != F.col("implied"))
        .select("book_id", "stored", "implied", (F.col("stored") - F.col("implied")).alias("drift"))
        .orderBy("book_id")
    )
