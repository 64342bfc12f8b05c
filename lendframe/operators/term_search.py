"""Substring search for a whole table of terms at once, by an inverted index of trigrams.

The index has a row for every distinct trigram of a row's texts. Three end marks follow each text, so that every character
begins a trigram: a term of one or two characters is found by the trigrams it begins. A longer term goes to the list of its
rarest trigram and, where it has more than one, to that of the second rarest; what stands in both is compared with the texts.
So terms and rows meet by equality only, never all with all, and a frequent trigram is read only for terms that have no
rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lendframe.sources.workspace import work_dir, written

GRAM = 3
END = "\u0000"


def _plain(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _grams(chars: str, less: int) -> Column:
    """The distinct runs of GRAM characters that begin at any but the last `less` characters of a column of them.

    It is a column of its own, or every step along the text would split the text anew.
    """
    count = F.greatest(F.size(chars) - less, F.lit(0))
    run = F.transform(
        F.slice(F.col(chars), F.lit(1), count),
        lambda c, i: F.concat(c, *[F.get(F.col(chars), i + k) for k in range(1, GRAM)]),
    )
    return F.array_distinct(run)


class TermIndex:
    """Trigram index of some text columns of a table with a unique key, written below the shared folder.

    Case is ignored, a null text is an empty one.
    """

    def __init__(self, df: DataFrame, key: str, columns: list[str]):
        folder = work_dir(df.sparkSession)
        self.rows, self.key, self.columns = df, key, columns
        names = [f"chars_{i}" for i in range(len(columns))]
        marked = [F.split(F.concat(_plain(c), F.lit(END * GRAM)), "").alias(n) for c, n in zip(columns, names, strict=True)]
        # Grams are many times the size of the texts: a table of few files is dealt out before they are made, to a stated
        # number of parts, as adaptive execution would merge them by the size of the texts.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.select(*dict.fromkeys([key, *columns])).repartition(parts, key)
        texts = dealt.select(F.col(key).alias("key"), *marked)
        # The last GRAM - 1 marks begin nothing; the first one does, so that an empty text is in the index, too.
        grams = F.array_distinct(F.flatten(F.array(*[_grams(n, GRAM - 1) for n in names])))
        postings = texts.select("key", F.explode(grams).alias("gram"))
        self.postings = written(postings.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key"), f"{folder}/postings")
        self.lists = written(self.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")), f"{folder}/lists")

    def search(self, terms: DataFrame) -> DataFrame:
        """(term, key): which rows have which term in any of the columns. Terms (`term`) are plain text and told once each;
        a null term is in no row, an empty one in every row."""
        asked = terms.where("term IS NOT NULL").select("term").distinct().withColumn("needle", F.lower("term"))
        length = F.length("needle")
        wanted = asked.where(length >= GRAM).select("term", F.split("needle", "").alias("chars"))
        wanted = wanted.select("term", _grams("chars", GRAM - 1).alias("grams"))
        wanted = wanted.select("term", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(self.lists, "gram")
        of_term = W.partitionBy("term")  # as many rows as the term has characters
        wanted = wanted.withColumn("found", F.count(F.lit(1)).over(of_term)).where("found = n")
        wanted = wanted.withColumn("place", F.row_number().over(of_term.orderBy("rows", "gram"))).where("place <= 2")
        wanted = written(wanted.select("term", "n", "place", "gram"), work_dir(self.rows.sparkSession))
        first = self.postings.join(wanted.where("place = 1"), "gram").select("term", "key", "n")
        second = wanted.where("place = 2").select("term", F.col("gram").alias("gram"))
        both = first.where("n > 1").join(second, "term").join(self.postings, ["gram", "key"], "left_semi")
        long = both.select("term", "key").unionByName(first.where("n = 1").select("term", "key"))

        heads = F.array(*[F.substring("gram", 1, k) if k else F.lit("") for k in range(GRAM)])
        begun = self.lists.select("gram", F.explode(heads).alias("needle"))
        short = asked.where(length < GRAM).join(begun, "needle").select("term", "gram")
        short = self.postings.join(short, "gram").select("term", "key").distinct()

        texts = self.rows.select(F.col(self.key).alias("key"), *[_plain(c).alias(c) for c in self.columns])
        found = F.lit(False)
        for name in self.columns:
            found = found | F.contains(F.col(name), F.lower("term"))
        return long.unionByName(short).join(texts, "key").where(found).select("term", "key")


def search_terms(books: DataFrame, members: DataFrame, terms: DataFrame) -> DataFrame:
    """term, result_type, id, name, detail: `overview.search` for every term of a table, as plain text."""

    def matching(df: DataFrame, kind: str, key: str, name: str, detail: str) -> DataFrame:
        hits = TermIndex(df, key, [name, detail]).search(terms)
        rows = df.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(detail).alias("detail"))
        return hits.join(rows, "key").select("term", F.lit(kind).alias("result_type"), F.col("key").alias("id"), "name", "detail")

    return matching(books, "book", "book_id", "title", "author").unionByName(
        matching(members, "member", "member_id", "full_name", "email")
    )


def rows_with_terms(df: DataFrame, key: str, columns: list[str], terms: DataFrame) -> DataFrame:
    """The rows of a table, with the term, for every term of a table that any of the columns has."""
    hits = TermIndex(df, key, columns).search(terms).withColumnRenamed("key", key)
    return hits.join(df, key).select("term", *df.columns)
