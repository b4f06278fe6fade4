"""What the operators share: table reading, shared scratch tables, word rules, Arrow helpers.

Columns that the operators add to a table that they give back have names from fresh(), so a table's own columns, whatever they
are called, come back as they were."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import release, scratch

#: Characters that part words in most operators: space and \t to \r.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows of a batch that goes to Python.
ROWS = 1000

#: bytes.translate table: A-Z to lower case, every ASCII character that is neither letter nor digit to a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches of ROWS rows: texts are long, and a worker holds a batch several times over.

    The setting is the session's; one that was set to another value than Spark's own stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return df.mapInArrow(function, schema)


def larger(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def bitmap(hashes: DataFrame, column: str, log2: int = 27) -> np.ndarray:
    """2^log2 bits (16 MB), those set that the low bits of a column of hashes name: a filter of fixed size without false negatives."""
    place = F.col(column).bitwiseAND(2**log2 - 1) + 1
    parts = hashes.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part")
    out = np.zeros(2**log2 // 8, dtype=np.uint8)
    for r in parts.agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = (r["part"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def likely(rows: DataFrame, column, wanted: DataFrame, hashed: str, how: str = "left_semi", most: int = 2**20) -> DataFrame:
    """The rows whose hash is a wanted one, as far as a broadcast of at most `most` numbers tells (left_anti: surely none), so that an
    exact join moves less. Up to `most` wanted rows their hashes are sent, beyond that the buckets that they fall into: where
    they fill all buckets, the exact join does all the work."""
    name, buckets = fresh("bucket", rows), 2**62 if wanted.count() <= most else most
    few = wanted.select(F.pmod(F.col(hashed), F.lit(buckets)).alias(name)).distinct()
    return rows.join(F.broadcast(few), F.pmod(column, F.lit(buckets)) == few[name], how)


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with as many underscores in front as it takes to be no column of the frames (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """docs as a written table with a column of distinct longs: whatever reads it sees the same numbers."""
    return scratch(spark, docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str, weight: str, most: int = 1000) -> DataFrame:
    """rows left-joined with lookup, which has one row per key and in `weight` how many rows have it.

    Keys that hold more than one in `most` of all rows are at most `most` keys: they go by broadcast, so no task gets
    all rows of a hot key; the others are joined by shuffle. rows and lookup should be cheap to read twice."""
    found = lookup.agg(F.sum(weight), F.max(weight)).first()
    least = max(64, -(-(found[0] or 0) // most))
    if (found[1] or 0) <= least:
        return rows.join(lookup.hint("merge"), key, "left")
    hot = F.broadcast(lookup.filter(F.col(weight) > least))
    tried = rows.join(hot, key, "left")
    rest = tried.filter(F.col(weight).isNull()).select(rows.columns).join(lookup.filter(F.col(weight) <= least).hint("merge"), key, "left")
    return tried.filter(F.col(weight).isNotNull()).unionByName(rest.select(tried.columns))


def text_digest(text):
    """Of the text as it is; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def row_key(doc_id, digest):
    """One binary value for an id (null is one too) and a digest of 32 bytes."""
    return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")).cast("binary"), digest)


def rows_kept(spark: SparkSession, docs: DataFrame, decided: DataFrame, digest) -> DataFrame:
    """The rows of docs that decided (doc_id, digest, keep; a row for each row of docs) keeps, with all their columns; of rows
    equal in doc_id and digest one at most, the least by its columns as JSON.

    Only keys that lose a row are looked up. All other rows pass without a shuffle, but for those that fall into a bucket
    with such a key (see likely)."""
    key, gone = fresh("key", docs), fresh("keep", docs)
    keys = decided.select(row_key(F.col("doc_id"), F.col("digest")).alias(key), "keep").groupBy(key).agg(F.max("keep").alias(gone), F.count("*").alias("rows_of_key"))
    weight = fresh("rows_of_key", docs)
    keys = scratch(spark, keys.filter(f"NOT `{gone}` OR rows_of_key > 1").withColumnRenamed("rows_of_key", weight), "keys")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), digest))
    hashed = keys.withColumn(fresh("hash", docs), F.xxhash64(key))
    sure = likely(keyed, F.xxhash64(key), hashed, hashed.columns[-1], "left_anti").select(docs.columns)
    maybe = likely(keyed, F.xxhash64(key), hashed, hashed.columns[-1])
    found = with_lookup(maybe, keys, key, weight)
    out = sure.unionByName(found.filter(F.col(weight).isNull()).select(docs.columns))
    if keys.filter(F.col(gone)).isEmpty():
        return out
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = found.filter(F.col(gone)).groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(gone))
    return out.unionByName(one.select(f"`{gone}`.*").select(docs.columns))
