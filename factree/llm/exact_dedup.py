"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a table with one row per distinct text: its digest, the row that stays and how many rows had it.
It is bucketed and sorted by digest, so a new batch meets it in a sort-merge anti-join that does not move the
index. A batch is pre-aggregated per digest before any shuffle, so a group of copies costs one row per task
however large it is. Ids are handed back to the batch's rows in two ways: the few digests that hold more than a
thousandth of the rows (at most a thousand of them) by broadcast, the others by a shuffled join.

Defined results: a null text counts as empty; ids that are null come after all others; of rows that are equal in
id and text one is kept; an empty batch gives no rows; columns other than the id and the text are not looked at, and
deduplicated() hands them on whatever they are called.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_folder
from .base import SPACE, release, rows_kept, scratch, with_lookup

#: Rows of an index that one bucket is made for.
ROWS_OF_BUCKET = 1_000_000


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A table `name` of (digest, isnull, doc_id, rid, batch, rows), bucketed and sorted by digest.

    path: where it lives; a later session finds an index again by its path. Without one it lies in this application's part of the
    shared folder and goes with it. The number of buckets is set when the index is made: for `expected` rows in all,
    ROWS_OF_BUCKET to a bucket, unless given."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None, expected: int = 0):
        self.spark, self.name = spark, name
        self.path = path or f"{shared_folder(spark)}/{name}"
        self.buckets = buckets or max(16, -(-expected // ROWS_OF_BUCKET))
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} (digest BINARY, isnull BOOLEAN, doc_id BIGINT, rid BIGINT, batch STRING, rows BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Table and files, for an index of one run; results of deduplicate() do not read it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)

    def append(self, rows: DataFrame) -> None:
        """Groups (digest, isnull, doc_id, rid, batch, rows) that the index lacks are added to it: the index is read bucket by
        bucket as it lies, only the new groups are shuffled."""
        new = rows.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        writer = new.select("digest", "isnull", "doc_id", "rid", "batch", "rows").repartition(self.buckets, "digest").write
        writer = writer.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def deduplicate(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", deliveries: int = 1) -> DataFrame:
        """Adds the batch to the index; one row per row of docs: doc_id, rid, digest, keep_id, kept, group_size.

        group_size counts the rows of the batch with that text. A row is kept if it is the one the index holds,
        which a row of an earlier batch may be. deliveries: the batch is appended in so many parts, in order of its ids, so
        that one append has that much less to sort; the results are the same."""
        batch = scratch(
            self.spark,
            docs.select(
                F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), digest(F.col(text)).alias("digest")
            ),
            "digests",
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("isnull"), "doc_id", "rid")).alias("first")
        own, parts = uuid.uuid4().hex, []
        for part in _by_id(batch, deliveries):
            groups = part.groupBy("digest").agg(first, F.count("*").alias("rows"))
            parts.append(scratch(self.spark, groups.select("digest", "first.*", F.lit(own).alias("batch"), "rows"), "groups"))
            self.append(parts[-1])
        groups = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.sum("rows").alias("group_size"))
        known = self.table().select("digest", F.col("doc_id").alias("keep_id"), F.when(F.col("batch") == own, F.col("rid")).alias("keep_rid"))
        held = scratch(self.spark, groups.join(known.hint("merge"), "digest"), "held")
        release(*parts)
        both = with_lookup(batch, held, "digest", "group_size")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("rid").eqNullSafe(F.col("keep_rid"))
        return both.select("doc_id", "rid", "digest", "keep_id", kept.alias("kept"), "group_size")


def _by_id(batch: DataFrame, parts: int) -> list[DataFrame]:
    """batch in parts of about equal size; ids rise from part to part, null ids are in the last."""
    if parts < 2:
        return [batch]
    cuts = batch.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)])).first()[0]
    if not cuts:
        return [batch]
    at = sum((F.col("doc_id") > c).cast("int") for c in cuts)
    at = F.when(F.col("doc_id").isNull(), F.lit(parts - 1)).otherwise(at)
    return [batch.filter(at == k) for k in range(parts)]


def deduplicated(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    own = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", expected=docs.count())
    decided = scratch(spark, own.deduplicate(docs).select("doc_id", "digest", F.col("kept").alias("keep")), "decided")
    if index is None:
        own.drop()
    return rows_kept(spark, docs, decided, digest(F.col("text")))
