"""Exact dedup against a persistent index of digests, bucketed and sorted by hash.

The index is a folder of Parquet files, clustered by digest into a fixed number of buckets and sorted by it within each
file. New rows are reduced to one representative a digest (before and after the shuffle, so a text that a third of all
rows share is one row a task), dealt to the same buckets, and sort-merge anti-joined with the index, which is read where
it lies: no exchange of it, however large it has grown. What the index doesn't have is appended. After that the index
has every digest, and its row tells which document stays.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quillstone.llm import common

#: Digests that a bucket is meant for, and the least and most buckets of an index whose number isn't given.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 8, 100_000
#: ASCII white space, which doesn't count.
BLANK = b" \t\n\x0b\x0c\r"
#: The file in the folder that holds the index's settings; Spark's readers skip names that begin so.
SETTINGS = "_index.json"


def digests(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, n_chars (code points of the text) and digest (SHA-256 of the text without ASCII white space) of each row; written once."""
    one = docs.select(F.col(id_).alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(x.translate(None, BLANK)).digest() for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_chars"), pa.array(found, pa.binary())], ["id", "n_chars", "digest"])

    schema = StructType([one.schema["id"], StructField("n_chars", LongType()), StructField("digest", BinaryType())])
    return common.kept(one, run, schema)


class DigestIndex:
    """An index in a folder that driver and executors share. One writer at a time; readers see whole appends.

    A folder without an index gets one with `buckets` buckets, which stay as they are; the ids' type is that of the first
    rows added. A folder with one is opened, in another session too.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.buckets, self.name = spark, folder, buckets, "digests_" + hashlib.md5(folder.encode()).hexdigest()
        fs, path = common.open_fs(f"{folder}/{SETTINGS}")
        if fs.get_file_info(path).is_file:
            self._register(**json.loads(common.read_file(folder, SETTINGS)))

    def _register(self, buckets: int, id_type: str) -> None:
        self.buckets = buckets
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder}'")

    def table(self) -> DataFrame:
        """digest, keep_id: one row a digest. Files that another session has added since are seen."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def fresh(self, found: DataFrame) -> DataFrame:
        """Rows of found (one a digest) whose digest the index lacks: a sort-merge anti-join, bucket by bucket."""
        return found.repartition(self.buckets, "digest").join(self.table().hint("merge"), "digest", "left_anti")

    def add(self, docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
        """Append the texts that the index lacks; per row of docs: id, keep_id, group_size, kept, text_sha256, known.

        Texts are equal when they are so without ASCII white space; a null text counts as empty, and empty ones are equal.
        A text that the index has keeps the document recorded there (known is true). Of rows with a new text the one with
        most code points stays, then the one of smallest id, null last; where all are null, keep_id is null and all of
        them are kept. group_size counts rows of this call, repeated ones too; rows that repeat the id that stays are
        kept with it. So adding the same rows again, as after a lost driver, tells the same, but for known. Other columns
        are ignored; an empty table gives no rows and appends none.
        """
        rows = digests(docs, id_, text)
        best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("last"), "id")).alias("best")
        found = common.kept(rows.groupBy("digest").agg(best, F.count("*").alias("n")).select("digest", F.col("best.id").alias("keep_id"), "n"))
        if not self.spark.catalog.tableExists(self.name):
            most = min(MOST_BUCKETS, -(-found.count() // BUCKET_ROWS))
            settings = {"buckets": self.buckets or max(LEAST_BUCKETS, most), "id_type": rows.schema["id"].dataType.simpleString()}
            common.write_file(self.folder, SETTINGS, iter([json.dumps(settings).encode()]), "new")
            self._register(**settings)
        new = common.kept(self.fresh(found))
        new.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.name)
        said = self.table().hint("merge").join(found.drop("keep_id").repartition(self.buckets, "digest"), "digest")
        said = common.kept(said.join(new.select("digest", F.lit(False).alias("known")), "digest", "left").withColumn("known", F.coalesce("known", F.lit(True))))
        total = said.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        told = common.join_spread(rows, said, ["digest"], "n", total, ["id", "n_chars"])
        return told.select(F.col("id").alias(id_), "keep_id", F.col("n").alias("group_size"), F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known")
