"""Tables written to the folder that all executors share, which also cut the lineage of what was computed."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path
from uuid import uuid4

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lendframe
from lendframe.sources.workspace import work_dir, written

_sent: set[str] = set()


def send_code(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    root = Path(lendframe.__file__).parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.writestr(str(path.relative_to(root.parent)), path.read_text())
    folder = work_dir(spark)
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/lendframe.zip", compression=None) as stream:
        stream.write(content.getvalue())
    context.addPyFile(f"{folder}/lendframe.zip")


class Store:
    """A new folder below the shared one; `keep` writes a frame there and reads it back."""

    def __init__(self, spark: SparkSession):
        send_code(spark)
        self.folder, self.count = work_dir(spark), 0
        self.folders: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        kept = written(df, f"{self.folder}/{self.count}")
        self.folders[id(kept)] = f"{self.folder}/{self.count}"
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete what `keep` wrote, once everything made from it is written itself."""
        system, path = pafs.FileSystem.from_uri(self.folders.pop(id(kept)))
        system.delete_dir(path)

    def keep_dealt(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """As `keep`, dealt into buckets by a key: a later join on the key moves the other side only.

        Buckets are known to the catalogue only, so the frame is a table of an own name there; its files are in the folder.
        """
        self.count += 1
        name = f"kept_{uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", f"{self.folder}/{self.count}").saveAsTable(name)
        return df.sparkSession.table(name)


def sampled_texts(docs: DataFrame, looks: Column, rows: int, chars: int) -> list[str]:
    """At most `rows` different texts of at most `chars` characters that meet a condition, those of the lowest hashes.

    A cut in the range of hashes leaves about twice as many before they are put in order, so what is sent to the driver
    depends on `rows` and not on the number of tasks.
    """
    send_code(docs.sparkSession)
    fit = docs.where(looks & (F.length("text") <= chars)).select("text", F.xxhash64("text").alias("hash"))
    share = min(1.0, 2 * rows / max(1, fit.count()))
    cut = min(2**63 - 1, int(share * 2**64) - 2**63)
    lowest = fit.where(F.col("hash") <= F.lit(cut)).distinct()
    return [row["text"] for row in lowest.orderBy("hash", "text").limit(rows).collect()]
