"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest, made before the first batch comes. A batch is reduced to one
row per digest, the digests that the index has are removed by a sort-merge anti-join, which reads the index
without shuffling it, and the rest is appended. Texts never leave the scan: only digests and ids are shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, fresh, looked_up, one_row_each, salt_of, written
from graphloom.operators.scratch import named, path_for

#: Digests that a bucket is made for (some 100 bytes each), and the fewest buckets of an index.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 16


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256): SHA-256 of the text after lower-casing A-Z; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("text_sha256"))


def _digest(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


class DigestIndex:
    """A table (digest, keep_id, group_size, batch), bucketed and sorted by digest, that outlives the session's jobs.

    name: a catalog table; path: its folder, in storage that all executors share; rows: the digests that it is
    made for, from which the number of buckets follows unless it is given; id_type: Spark's type of ids. A digest
    that is already in the index keeps its first keep_id; of a batch's rows, the one with the largest id stays.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, rows: int = 0, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.name, self.path, self.id_type = spark, name, path, id_type
        self.buckets = buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
        self._made()

    @classmethod
    def temporary(cls, spark: SparkSession, rows: int = 0, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
        """An index that lasts until sweep() or the driver's end."""
        index = cls(spark, f"graphloom_index_{uuid.uuid4().hex}", path_for(spark, "index"), rows, id_type, buckets)
        named(index.name)
        return index

    def _made(self) -> None:
        """Finds the table in the catalog or by its folder, or makes it; its number of buckets never changes."""
        jvm = self.spark._jvm
        note = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets")  # holds an empty folder, named by the number of buckets
        files = note.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(note):
            self.buckets = int(files.listStatus(note)[0].getPath().getName())
        else:
            files.mkdirs(jvm.org.apache.hadoop.fs.Path(note, str(self.buckets)))
        if not self.spark.catalog.tableExists(self.name):
            columns = f"digest STRING, keep_id {self.id_type}, group_size BIGINT, batch STRING"
            self.spark.sql(f"CREATE TABLE `{self.name}` ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups (one per digest) whose digest the index has not."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        rows = rows.select("digest", "keep_id", "group_size", "batch")
        writer = rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def ingest(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """Appends the new digests of (doc_id, text_sha256) rows; returns the batch's verdicts, one row per row.

        Columns: doc_id, keep_id, group_size (rows of the batch that founded the group), kept, text_sha256. One row
        of a new digest is kept, that of the largest id; rows that repeat id and digest differ in nothing else
        here, and one of them is kept. A digest that an earlier batch has brought is kept no more, under whatever
        id. A null id is smaller than any other. An empty batch gives no rows.

        name: names the batch. A batch that is ingested again under its name, after a failure, appends nothing
        twice and gets the verdicts that it would have got.
        """
        name = name or uuid.uuid4().hex
        rows = batch.select("doc_id", F.col("text_sha256").alias("digest")).withColumn("row", F.monotonically_increasing_id())
        cells = written(rows.withColumn("salt", salt_of(F.col("row"))), "batch")
        parts = cells.groupBy("digest", "salt").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
        groups = written(parts.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("group_size")), "groups")
        self.append(self.unseen(groups.select("digest", F.col("top.doc_id").alias("keep_id"), "group_size", F.lit(name).alias("batch"))))
        held = groups.select("digest", "top").join(self.read().hint("merge"), "digest")
        verdicts = held.select("digest", "keep_id", "group_size", F.when(F.col("batch") == name, F.col("top.row")).alias("kept_row"))
        out = looked_up(cells.drop("salt"), "digest", "row", verdicts)
        kept = F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Verdicts of all rows of docs (doc_id, text) against an index, a temporary one by default.

    Null texts count as empty, and empty texts are equal to each other; long texts are digested whole where they
    lie; other columns, whatever their names, are ignored. Ties and repeated rows: as DigestIndex.ingest() says.
    """
    found = written(digests(docs), "digests")
    if index is None:
        index = DigestIndex.temporary(docs.sparkSession, found.count(), found.schema["doc_id"].dataType.simpleString())
    return index.ingest(found)


def keep_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all of docs' columns, whatever their names.

    One row of each digest stays. Of rows that repeat id and digest, that is the one that is least as JSON.
    """
    digest, kept_id, kept_digest = fresh(docs, "_digest", "_id", "_kept")
    verdicts = written(exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "verdicts")
    found = verdicts.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest))
    keyed = docs.withColumn(digest, _digest(docs["text"]))
    same = keyed["doc_id"].eqNullSafe(found[kept_id]) & (keyed[digest] == found[kept_digest])
    rows = keyed.join(found, same, "left_semi").drop(digest)
    # a kept row whose id and digest come again brings its repeats along
    again = verdicts.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("n > 1 and kept")
    return rows if again.isEmpty() else one_row_each(rows, [rows["doc_id"], _digest(rows["text"])])
