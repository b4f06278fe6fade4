"""Substring dedup: words covered by a window of consecutive words that also occurs elsewhere are removed.

remove_known() streams documents over suffix automata of a reference that is sent to the tasks in shards of bounded
size, one after the other: at every word the matching statistic (the longest match that ends there) tells the maximal spans.

For a corpus against itself the reference is the corpus, whose automata neither fit a broadcast nor could be streamed
shard by shard (that is quadratic), so repeated() finds the same spans by digests. Each window is anchored at its
least hashed SEED words; consecutive windows with the same anchor are one run, so equal windows always lie in runs
with equal anchors, and there is about one run per fourteen windows. Runs of equal content repeat whole; only where runs
share an anchor but differ are single windows compared, by a digest of their words. What is shuffled are
digests, counted with map-side combine, so a passage that a third of all documents share costs a row per task; texts
move only for documents that lose some of their words, but not all.

Defined results: a null or blank text has no words and keeps the empty string; equal rows are each other's copies;
ids only pass through; an empty table gives no rows. Digests have 64 bits. repeated() looks at no other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .base import SPACE, binaries, bitmap, by_batches, fresh, in_bitmap, likely, numbered, release, scratch, with_lookup

WINDOW, SEED = 35, 8
MULTIPLIER = 0x9E3779B97F4A7C15
ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[2]
    x = (x ^ (x >> np.uint64(29))) * ODD[0]
    return x ^ (x >> np.uint64(32))


class Words:
    """Digests of word ranges of one text."""

    powers = np.ones(1, dtype=np.uint64)
    inverses = np.ones(1, dtype=np.uint64)

    def __init__(self, text: bytes):
        words = text.split()
        self.n = n = len(words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
        if len(Words.powers) <= n + 1:
            Words.powers, Words.inverses = powers(MULTIPLIER, 2 * n + 2), powers(pow(MULTIPLIER, -1, 2**64), 2 * n + 2)
        # prefix sums of hash times power: the sums of equal ranges differ by a power only
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * Words.powers[:n], out=self.sums[1:])

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words start to end (exclusive): the power of the start is divided out."""
        return mixed((self.sums[end] - self.sums[start]) * Words.inverses[start] + (end - start).astype(np.uint64) * ODD[1])


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ..., modulo 2 to the 64."""
    table = np.full(n, base, dtype=np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def runs(words: Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """anchor, run, first window, windows: runs of consecutive windows with one anchor place."""
    count = words.n - window + 1
    if count < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    starts = np.arange(words.n - seed + 1)
    seeds = words.digest(starts, starts + seed)
    span = window - seed + 1
    places = np.lib.stride_tricks.sliding_window_view(seeds, span).argmin(axis=1) + np.arange(count)
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    last = np.concatenate([first[1:], [count]])
    place = places[first]
    run = mixed(words.digest(first, last + window - 1) + (place - first).astype(np.uint64) * ODD[0])
    return seeds[place].view(np.int64), run.view(np.int64), first, last - first


def _normalised(text):
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def repeated(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for docs (doc_id, text)."""
    seed = min(seed, window)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _normalised(F.col("text")).alias("words"))
    flat = flat.withColumn("tid", F.xxhash64("words"))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.translate("words", " ", "")) + 1).cast("long")
    rows = scratch(spark, flat.select("doc_id", "tid", n_words.alias("n_words"), F.unhex(F.sha2("words", 256)).alias("sha")), "documents")
    every = found = scratch(spark, _runs(flat.select("tid", "words"), window, seed), "runs")
    # anchors that stand once are most of all and can't repeat: a bitmap of the others spares the joins nearly all of them
    anchors = scratch(spark, found.groupBy("anchor").agg(F.count("*").alias("total")).filter("total > 1"), "anchors")
    found = _in(found, "anchor", bitmap(anchors, "anchor"))
    may = scratch(spark, found, "likely")
    release(every)
    found = scratch(spark, with_lookup(may, anchors, "anchor", "total").filter("total IS NOT NULL").drop("total"), "candidates")
    release(may, anchors)
    groups = found.groupBy("run").agg(F.first("anchor").alias("anchor"), F.count("*").alias("c"), F.min("tid").alias("least"))
    groups = scratch(spark, groups, "groups")
    unlike = scratch(spark, groups.groupBy("anchor").agg(F.count("*").alias("d")), "unlike")
    shared = scratch(spark, with_lookup(groups, unlike, "anchor", "d").select("run", "c", "d", "least"), "shared")
    placed = with_lookup(found.select("run", "tid", "first", "windows"), shared, "run", "c")
    # copies of a text have the same runs: once is enough from here on
    placed = scratch(spark, placed.dropDuplicates(["tid", "first"]), "placed")
    release(found, groups, unlike, shared)

    whole = placed.filter("c > 1").select("tid", F.col("first").alias("a"), (F.col("first") + F.col("windows") + window - 1).alias("b"))
    unsure = placed.filter("d > 1 AND (c = 1 OR tid = least)").select("tid", "first", "windows", (F.col("c") == 1).alias("open"))
    spans = F.collect_list(F.struct("a", "b")).alias("spans")
    whole = whole.groupBy("tid").agg(spans)
    unsure = unsure.groupBy("tid").agg(F.collect_list(F.struct("first", "windows", "open")).alias("unsure"))
    distinct = rows.groupBy("tid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("isnull"), "doc_id")).alias("one"), F.first("n_words").alias("n_words"))
    touched = whole.join(unsure, "tid", "full_outer").join(distinct, "tid").withColumn("gone", covered(F.col("spans")))
    touched = scratch(spark, touched.select("tid", "spans", "unsure", "gone", "n_words", F.col("one.doc_id").alias("__id")), "touched")
    part = touched.filter("gone < n_words OR unsure IS NOT NULL").withColumnRenamed("tid", "__tid")
    flat = likely(flat, F.col("tid"), part, "__tid")
    texts = flat.join(part.hint("merge"), flat["doc_id"].eqNullSafe(part["__id"]) & (flat["tid"] == part["__tid"]))
    texts = scratch(spark, texts.select("tid", "words", "spans", "unsure", "gone", "n_words").dropDuplicates(["tid"]), "texts")
    release(placed)

    windows = scratch(spark, _windows(texts.filter("unsure IS NOT NULL").select("tid", "words", "unsure"), window), "windows")
    twice = windows.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1")
    again = with_lookup(windows, scratch(spark, twice, "repeated"), "digest", "k").filter("open AND k IS NOT NULL")
    more = again.groupBy("tid").agg(F.collect_list("first").alias("starts"))
    cut = _cut(texts.filter("gone < n_words").join(more, "tid", "left").select("tid", "words", "spans", "starts"), window)
    empty = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    done = cut.unionByName(touched.filter("gone = n_words").select("tid", F.col("gone").alias("n_removed"), empty.alias("kept")))
    copies = rows.groupBy("tid").agg(F.count("*").alias("copies"))
    done = scratch(spark, done.join(copies, "tid"), "removed")
    out = with_lookup(rows, done, "tid", "copies")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256")
    )


def covered(spans):
    """Words in the union of spans (a, b); 0 for null."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    add = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["b"]).alias("upto")
    )
    return F.coalesce(F.aggregate(F.array_sort(spans), first, add, lambda acc: acc["n"]), F.lit(0).cast("long"))


def _runs(flat: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for tid, text in zip(batch.column("tid").to_pylist(), binaries(batch.column("words")), strict=True):
                found = runs(Words(text), window, seed)
                if len(found[0]):
                    for k, x in enumerate((np.full(len(found[0]), tid, dtype=np.int64), *found)):
                        out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["tid", "anchor", "run", "first", "windows"])

    return by_batches(flat, run, "tid long, anchor long, run long, first long, windows long")


def _in(found: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    sent = found.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(sent.value, batch.column(column).to_numpy())))

    return found.mapInArrow(run, found.schema)


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """tid, first, open, digest of each window in the runs listed in unsure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for tid, text, found in zip(batch.column("tid").to_pylist(), binaries(batch.column("words")), batch.column("unsure").to_pylist(), strict=True):
                words = Words(text)
                first = np.concatenate([np.arange(r["first"], r["first"] + r["windows"]) for r in found])
                own = np.concatenate([np.full(r["windows"], r["open"]) for r in found])
                for k, x in enumerate((np.full(len(first), tid, dtype=np.int64), first, own, words.digest(first, first + window).view(np.int64))):
                    out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["tid", "first", "open", "digest"])

    return by_batches(texts, run, "tid long, first long, open boolean, digest long")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, spans, starts in zip(binaries(batch.column("words")), batch.column("spans").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for x in spans or ():
                    gone[x["a"]] += 1
                    gone[x["b"]] -= 1
                for a in starts or ():
                    gone[a] += 1
                    gone[a + window] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                removed.append(int(len(words) - stays.sum()))
                kept.append(hashlib.sha256(b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["tid", "n_removed", "kept"])

    return by_batches(texts, run, "tid long, n_removed long, kept binary")


def known_spans(words: list[bytes], shard: tuple[SuffixAutomaton, dict[bytes, int]], least: int) -> list[tuple[int, int]]:
    """Maximal spans of words that a shard's texts contain, of `least` words or more, by matching statistics."""
    automaton, vocabulary = shard
    out: list[tuple[int, int]] = []
    for end, _ in automaton.matches([vocabulary.get(w, -1) for w in words], least):
        if out and end - least <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((end - least, end))
    return out


def automaton_of(texts: list[bytes]) -> tuple[SuffixAutomaton, dict[bytes, int]]:
    vocabulary: dict[bytes, int] = {}
    automaton = SuffixAutomaton()
    for text in texts:
        automaton.add([vocabulary.setdefault(w, len(vocabulary)) for w in text.split()])
    return automaton, vocabulary


def remove_known(spark: SparkSession, docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = 200_000) -> DataFrame:
    """docs, with the text's maximal spans of `window` words or more that a text of reference contains removed.

    The reference is cut into pieces that overlap by a window less one word and dealt to shards of about shard_words words. One
    shard at a time is fetched and sent; a task builds its automaton once. Spans are judged on the text as it is before
    any shard: all shards' spans are joined first. Columns of docs come back as they were, whatever they are called."""
    place, row = docs.columns.index("text"), fresh("row", docs)
    parts = scratch(spark, _pieces(reference, window, max(2 * window, shard_words // 4)), "pieces")
    total = parts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return docs
    count = -(-total // shard_words)
    rows, found = numbered(spark, docs, row), []
    for k in range(count):
        shard = sorted(bytes(r["words"]) for r in parts.filter(F.pmod(F.xxhash64("words"), F.lit(count)) == k).select("words").collect())
        sent = spark.sparkContext.broadcast(shard)
        found.append(scratch(spark, _known(rows.select(F.col(row).alias("rid"), "text"), sent, window), "spans"))
        sent.destroy()
    spans = found[0]
    for other in found[1:]:
        spans = spans.unionByName(other)
    key, gone = fresh("rid", rows), fresh("spans", rows)
    spans = scratch(spark, spans.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias(gone)).withColumnRenamed("rid", key), "spans")
    own = [F.col(f"`{c}`") for c in docs.columns]
    clean = rows.join(spans, rows[row] == spans[key], "left_anti").select(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cut in zip(binaries(batch.column(place)), batch.column(gone).to_pylist(), strict=True):
                places = {j for a, b in cut for j in range(a, b)}
                texts.append(b" ".join(w for j, w in enumerate(text.split()) if j not in places))
            columns = list(batch.columns)[:-1]
            columns[place] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return clean.unionByName(by_batches(rows.join(spans, rows[row] == spans[key]).select(*own, gone), run, docs.schema))


def _pieces(reference: DataFrame, window: int, most: int) -> DataFrame:
    """words (joined by a space), n: the texts of a window or more in pieces of at most `most` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, most - window + 1)
        for batch in batches:
            texts = [t.split() for t in binaries(batch.column("text"))]
            found = [w[a : a + step + window - 1] for w in texts for a in range(0, len(w) - window + 1, step)]
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(w) for w in found], pa.binary()), pa.array([len(w) for w in found], pa.int64())], names=["words", "n"])

    return by_batches(reference.select("text"), run, "words binary, n long").distinct()


def _known(docs: DataFrame, shard, window: int) -> DataFrame:
    """rid and spans (pairs of words, end exclusive) of the texts that share a window with the shard's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shard.value)
        for batch in batches:
            found = [known_spans(t.split(), automaton, window) for t in binaries(batch.column("text"))]
            hit = pa.array([bool(f) for f in found])
            spans = pa.array([[list(x) for x in f] for f in found], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), spans], names=["rid", "spans"]).filter(hit)

    return by_batches(docs, run, "rid long, spans array<array<long>>")
