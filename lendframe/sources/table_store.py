"""Versioned table sets on parquet: snapshot, undo and a named checkpoint without copying data.

Data files are written once, under names of their own, and never changed. A table's version is a list of files with the
range of keys in each; a library state is a map from table to such a list, so keeping a snapshot means keeping a map: it
costs the same for 52 rows and for 100 TB. A change set replaces only the files that hold one of its keys; the versions
before and after share all others, and their difference is read from the files they don't share. Each operation adds one
small log file with the whole store state after it, by a create that fails if the file is there. An operation whose file is
missing or incomplete has not happened; of two writers with the same starting point one fails and has changed nothing.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from functools import partial
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.schema import SCHEMAS, UNDO_DEPTH, TableSet
from lendframe.sources.workspace import work_dir, written

# Column each table is sorted by inside its files, so that row-group statistics serve the reports' filters.
_LAYOUT = {
    "books": "genre",
    "members": "expiry_date",
    "loans": "due_date",
    "fines": "issued_date",
    "reservations": "book_id",
}


# An incomplete log file of this age has lost its writer.
LEFT_OVER_SECONDS = 60


class NothingToRestore(RuntimeError):
    """There is no snapshot or checkpoint to go back to."""


class Conflict(RuntimeError):
    """Another writer was faster; nothing has changed."""


ROWS_PER_FILE = 1_000_000


def key_of(table: str) -> str:
    return SCHEMAS[table][0].name


@dataclass(frozen=True)
class Changes:
    """Rows to put in place of those of equal key, or to add, and keys of rows to delete."""

    upserts: DataFrame | None = None
    deletes: DataFrame | None = None
    stored: bool = False  # both are tables that were read, cheap to read again


def difference(table: str, before: DataFrame, after: DataFrame) -> Changes:
    """The change set that leads from one state of a table to another."""
    key = key_of(table)
    both = written(_outer(table, before, after), work_dir(before.sparkSession))
    return Changes(
        both.where("change <> 'delete'").select("after.*"),
        both.where("change = 'delete'").select(F.col("before")[key].alias(key)),
        stored=True,
    )


def _outer(table: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, before, after) of the rows that differ, as structs; change is insert, update or delete."""
    key, names = key_of(table), SCHEMAS[table].names
    old, new = (df.select(F.col(key).alias("key"), F.struct(*names).alias(side)) for df, side in ((before, "before"), (after, "after")))
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    both = old.join(new, "key", "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.select(change.alias("change"), "before", "after")


class TableStore:
    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark = spark
        self.path = path.rstrip("/")
        self.rows_per_file = rows_per_file

    def commit(self, **changed: DataFrame) -> TableSet:
        """Write the changed tables as new files and make them current; the others stay as they are."""
        entry = self._last()
        current = dict(entry["current"])
        for table, df in changed.items():
            current[table] = self._list(table, self._written(table, df, -(-df.count() // self.rows_per_file)))
        self._append(entry, current=current)
        return self._open(current)

    def apply(self, batch: tuple[str, int] | None = None, **changed: Changes) -> TableSet:
        """Apply a change set per table. Only files that hold one of its keys are written anew; added rows get files of
        their own, so that key ranges stay narrow.

        `batch` names a batch of a stream run. The batches of a run come in order, and the log remembers the last one with
        the state it led to: one that is delivered again changes nothing, also after an undo of what it did.
        """
        entry = self._last()
        current = dict(entry["current"])
        batches = dict(entry.get("batches", {}))
        if batch and batches.get(batch[0], -1) >= batch[1]:
            return self._open(current)
        for table, changes in changed.items():
            current[table] = self._changed(table, current[table], changes if changes.stored else self._kept(table, changes))
        if batch:
            batches[batch[0]] = batch[1]
        self._append(entry, current=current, batches=batches)
        return self._open(current)

    def version(self) -> dict[str, str]:
        """The current state, to ask for the changes since then later."""
        return dict(self._last()["current"])

    def changes(self, table: str, since: dict[str, str]) -> DataFrame:
        """(change, before, after) of the rows that differ between an earlier state and now, read from the files that only
        one of them has. Change is insert, update or delete."""
        now = self.version()
        old, new = self._files(since[table]), self._files(now[table])
        return _outer(table, self._read_files(table, old - new), self._read_files(table, new - old))

    def tables(self) -> TableSet:
        return self._open(self._last()["current"])

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from the files whose range of keys holds one of them."""
        key = key_of(table)
        files = self._holding(table, self._manifest(self.version()[table]), keys.select(key))
        return self._read_files(table, files).join(keys.select(key), key, "left_semi")

    def files(self, table: str) -> set[str]:
        """The files of the current version of a table."""
        return self._files(self.version()[table])

    def _written(self, table: str, df: DataFrame, files: int) -> str:
        """A new folder of files that share no keys' range, sorted inside by the column that reports filter on."""
        folder = f"{self.path}/data/{table}/{uuid4().hex}"
        dealt = df.select(*SCHEMAS[table].names).repartitionByRange(max(1, files), key_of(table))
        dealt.sortWithinPartitions(_LAYOUT[table]).write.parquet(folder)
        return folder

    def _listed(self, table: str, folder: str) -> DataFrame:
        """(file, first_key, last_key, rows) of a folder; only the keys are read."""
        key = key_of(table)
        rows = self.spark.read.schema(SCHEMAS[table]).parquet(folder).select("_metadata.file_path", key)
        ends = F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("rows")
        return rows.groupBy(F.col("file_path").alias("file")).agg(*ends)

    def _list(self, table: str, folder: str, kept: DataFrame | None = None) -> str:
        """Write the list of a table's files: those of a new folder and those kept from an older list."""
        uri = f"{self.path}/lists/{table}/{uuid4().hex}"
        listed = self._listed(table, folder)
        (listed.unionByName(kept) if kept is not None else listed).coalesce(1).write.parquet(uri)
        return uri

    def _manifest(self, uri: str) -> DataFrame:
        return self.spark.read.schema("file string, first_key long, last_key long, rows long").parquet(uri)

    def _files(self, uri: str) -> set[str]:
        return {row["file"] for row in self._manifest(uri).select("file").collect()}

    def _read_files(self, table: str, files: set[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*sorted(files))

    def _holding(self, table: str, manifest: DataFrame, keys: DataFrame) -> set[str]:
        """Files that hold one of the keys, from those whose range meets theirs. Only the key column is read."""
        key = key_of(table)
        first, last = keys.agg(F.min(key), F.max(key)).first()
        if first is None:
            return set()
        near = manifest.where((F.col("last_key") >= first) & (F.col("first_key") <= last))
        # Rows carry a number in place of their file's name, which is many times longer.
        names = near.select(F.xxhash64("file").alias("number"), "file").collect()
        if not names:
            return set()
        rows = self._read_files(table, {row["file"] for row in names})
        found = rows.select(key, F.xxhash64("_metadata.file_path").alias("number")).join(keys, key, "left_semi")
        numbers = {row["number"] for row in found.select("number").distinct().collect()}
        return {row["file"] for row in names if row["number"] in numbers}

    def _kept(self, table: str, changes: Changes) -> Changes:
        """The change set, written once for all the steps that read it."""
        folder = work_dir(self.spark)
        sides = {"upserts": (changes.upserts, SCHEMAS[table].names), "deletes": (changes.deletes, [key_of(table)])}
        return Changes(**{
            side: df if df is None else written(df.select(*names), f"{folder}/{side}") for side, (df, names) in sides.items()
        }, stored=True)

    def _changed(self, table: str, uri: str, changes: Changes) -> str:
        """The list of files of a table after a change set."""
        key = key_of(table)
        none = self.spark.createDataFrame([], SCHEMAS[table])
        upserts = changes.upserts if changes.upserts is not None else none
        keys = upserts.select(key)
        if changes.deletes is not None:
            keys = keys.unionByName(changes.deletes.select(key))
        manifest = self._manifest(uri)
        touched = self._holding(table, manifest, keys)
        old = self._read_files(table, touched)
        known = upserts.join(old.select(key), key, "left_semi")
        rewritten = old.join(keys, key, "left_anti").unionByName(known.select(*old.columns))
        parts = [self._written(table, rewritten, len(touched))] if touched else []
        added = upserts.join(old.select(key), key, "left_anti")
        if n := added.count():
            parts.append(self._written(table, added, -(-n // self.rows_per_file)))
        kept = manifest.where(~F.col("file").isin(sorted(touched))) if touched else manifest
        for folder in parts:
            kept = kept.unionByName(self._listed(table, folder))
        out = f"{self.path}/lists/{table}/{uuid4().hex}"
        kept.coalesce(1).write.parquet(out)
        return out

    def snapshot(self) -> None:
        """Remember the current state for `undo`; only the latest UNDO_DEPTH snapshots are kept."""
        entry = self._last()
        self._append(entry, undo=[*entry["undo"], entry["current"]][-UNDO_DEPTH:])

    def undo(self) -> TableSet:
        """Go back to the newest snapshot and forget it."""
        entry = self._last()
        if not entry["undo"]:
            raise NothingToRestore("No actions left to undo.")
        *older, newest = entry["undo"]
        self._append(entry, current=newest, undo=older)
        return self._open(newest)

    def save_checkpoint(self) -> None:
        entry = self._last()
        self._append(entry, saved=entry["current"])

    def restore_checkpoint(self) -> TableSet:
        """Go back to the saved checkpoint, which stays in place."""
        entry = self._last()
        if not entry["saved"]:
            raise NothingToRestore("No saved checkpoint found.")
        self._append(entry, current=entry["saved"])
        return self._open(entry["saved"])

    def snapshots(self) -> int:
        return len(self._last()["undo"])

    def vacuum(self, grace_seconds: float = 86_400) -> int:
        """Delete data folders that no state, snapshot or checkpoint refers to, unused lists and older log files.

        What is younger than the grace time stays: it may belong to a commit that is under way.
        """
        entry = self._last()
        states = [entry["current"], *entry["undo"], entry["saved"] or {}]
        lists = {uri for state in states for uri in state.values()}
        kept = {uri.rsplit("/", 1)[1] for uri in lists} | {file.rsplit("/", 2)[1] for uri in lists for file in self._files(uri)}
        kept |= {f"{n:010d}.json" for n in range(entry["number"], self._newest() + 1)}
        folders = [f"{self.path}/log", *(f"{self.path}/{kind}/{table}" for kind in ("data", "lists") for table in _LAYOUT)]
        before = (time.time() - grace_seconds) * 1000
        unused = [p for f in folders for p, changed in self._children(f) if p.getName() not in kept and changed <= before]
        for path in unused:
            self._fs(self.path).delete(path, True)
        return len(unused)

    def _newest(self) -> int:
        """The highest number of a log file, complete or not."""
        return max((int(p.getName().split(".")[0]) for p, _ in self._children(f"{self.path}/log")), default=0)

    def _log(self, number: int):
        return self._hadoop_path(f"{self.path}/log/{number:010d}.json")

    def _read(self, number: int) -> dict | None:
        """A log entry, or None where its file is missing or its writer was lost on the way."""
        fs, path = self._fs(self.path), self._log(number)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _last(self) -> dict:
        """The newest complete log entry; only its own small file is read."""
        entries = (self._read(number) for number in range(self._newest(), 0, -1))
        nothing = {"number": 0, "current": {}, "undo": [], "saved": None}
        return next((entry for entry in entries if entry is not None), nothing)

    def _append(self, entry: dict, **changes: object) -> None:
        """Create the log file that follows the entry. One that is there belongs to another writer, unless it was left
        incomplete some time ago: then the next number is taken."""
        fs, number = self._fs(self.path), entry["number"] + 1
        while fs.exists(self._log(number)):
            age = time.time() - fs.getFileStatus(self._log(number)).getModificationTime() / 1000
            if self._read(number) is not None or age < LEFT_OVER_SECONDS:
                raise Conflict("the store has changed meanwhile")
            number += 1
        try:
            stream = fs.create(self._log(number), False)
        except Exception as error:
            raise Conflict("the store has changed meanwhile") from error
        try:
            stream.write(bytearray(json.dumps({**entry, **changes, "number": number}).encode()))
        finally:
            stream.close()

    def _open(self, lists: dict[str, str]) -> TableSet:
        def table(name: str) -> DataFrame:
            return self._read_files(name, self._files(lists[name]))

        return TableSet(**{name: partial(table, name) for name in SCHEMAS})

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._hadoop_path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, folder: str) -> list[tuple]:
        """(path, time of the last change) of what is in a folder."""
        fs, path = self._fs(folder), self._hadoop_path(folder)
        if not fs.exists(path):
            return []
        return [(status.getPath(), status.getModificationTime()) for status in fs.listStatus(path)]
