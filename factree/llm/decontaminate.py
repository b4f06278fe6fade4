"""Benchmark decontamination: training words are streamed over a generalised suffix automaton of the test items.

The items' words (A-Z lower-cased, runs of letters, digits and non-ASCII characters) are numbered and built into
automata, one per shard. Items are cut into pieces that overlap by a window less one word, so every window lies in a piece
whole; pieces are dealt to shards by a hash, about SHARD_WORDS words each. One shard at a time is fetched, sent, scanned with and dropped,
so neither the driver nor a task ever holds more than one, whatever the number of items. With one shard, documents are read once. With more, a Bloom
filter over the windows of all items (of fixed size, without false negatives) first picks the documents that may hold one,
and only these meet the shards. A word that no item has breaks every match, so only runs of known words that are at least
as long as the shortest window reach the automaton. The longest match that ends at each word decides: a window is WINDOW
words of an item, or a whole item that has fewer.

Defined results: null texts and items have no words, and an item without words has no window; items are told apart by
their ids as text, so rows that share an id are one item, and an item without id counts for hits but not as an item; repeated
documents are scored one by one; an empty table of documents gives no rows, an empty benchmark no hits. report() looks at no other
columns; cleaned() hands them on, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .base import FOLD, binaries, bitmap, by_batches, fresh, in_bitmap, numbered, scratch
from .substrings import Words

WINDOW = 10
#: Words of items per automaton: some 100 MB in a Python worker.
SHARD_WORDS = 200_000
#: Bits that a window sets in the Bloom filter.
HASHES = 4
#: A document of which more than this share is hit is dropped, others lose the spans that are hit.
MOST_COVERED = 0.5

FOLDED_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Matcher:
    """Items (id, text) of one shard, ready to mark the words of documents."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.automaton, self.window = SuffixAutomaton(), window
        self.whole: dict[int, dict[int, set[int]]] = {}  # length of short items -> state -> items
        self.ids = [i for i, _ in items]
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)] for _, t in items]
        for t in texts:
            self.automaton.add(t)
        self.long = False
        for k, t in enumerate(texts):
            if len(t) >= window:
                self.automaton.mark(k, t)
                self.long = True
        for k, t in enumerate(texts):
            if 0 < len(t) < window:
                at = 0
                for token in t:
                    at = self.automaton.next[at][token]
                self.whole.setdefault(len(t), {}).setdefault(at, set()).add(k)
        self.least = min([*self.whole, window])

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (start, end), merged and in order, and the items whose windows occur."""
        known = self.vocabulary
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        ids = [known.get(w, -1) for w in found]
        least, start, n = self.least, 0, len(ids)
        while start <= n - least:
            try:
                end = ids.index(-1, start)
            except ValueError:
                end = n
            if end - start >= least:
                run = ids[start:end]
                if self.long:
                    for at, state in self.automaton.matches(run, self.window):
                        if owners := self.automaton.owners[state]:
                            spans.append((start + at - self.window, start + at))
                            items |= owners
                for size, states in self.whole.items():
                    for at, state in self.automaton.matches(run, size):
                        if state in states and self.automaton.length[self.automaton.link[state]] < size:
                            spans.append((start + at - size, start + at))
                            items |= states[state]
            start = end + 1
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """item, words (joined by a space), n, whole: items in pieces of at most `most` words; whole marks items that are one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), binaries(batch.column("text")), strict=True):
                found = words(text)
                step = max(1, most - window + 1)
                for a in range(0, max(1, len(found) - window + 1) if found else 0, step):
                    part = found[a : a + step + window - 1]
                    rows.append((item, b" ".join(part), len(part), len(found) < window))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "words", "n", "whole"])

    return by_batches(items.select(F.col("item_id").cast("string").alias("item"), "text"), run, "item string, words binary, n long, whole boolean").distinct()


def _digests(found: list[bytes], size: int) -> np.ndarray:
    """HASHES hashes of each run of `size` words, in rows."""
    counted = Words(b" ".join(found))
    starts = np.arange(max(0, counted.n - size + 1))
    one = counted.digest(starts, starts + size)
    with np.errstate(over="ignore"):
        return np.stack([one ^ (one >> np.uint64(31 + k)) * np.uint64(2 * k + 1) for k in range(HASHES)]).view(np.int64)


def _may_hit(spark: SparkSession, rows: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """The rows (rid, doc_id, text) that may hold a window; text stays null in the others, and all have n_words."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digests(t.split(b" "), n if w else window).ravel() for t, n, w in zip(binaries(batch.column("words")), batch.column("n").to_pylist(), batch.column("whole").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, dtype=np.int64)]))], names=["hash"])

    sizes = sorted(r[0] for r in parts.select(F.when(F.col("whole"), F.col("n")).otherwise(window).alias("size")).distinct().collect())
    bits = spark.sparkContext.broadcast(bitmap(by_batches(parts.select("words", "n", "whole"), marks, "hash long"), "hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts = [], []
            for text in binaries(batch.column("text")):
                found = words(text)
                counts.append(len(found))
                texts.append(text if any(in_bitmap(bits.value, _digests(found, n)).all(axis=0).any() for n in sizes if n <= len(found)) else None)
            columns = [batch.column("rid"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "n_words", "text"])

    return by_batches(rows, run, "rid long, doc_id long, n_words long, text string")


def scan(spark: SparkSession, docs: DataFrame, shard: list[tuple[str, bytes]], window: int = WINDOW) -> DataFrame:
    """rid, doc_id, n_words, starts and ends of hit spans (in words), items (of this shard whose windows occur) for docs (rid, doc_id, text)."""
    sent = spark.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, window)
        for batch in batches:
            counts, starts, ends, items = [], [], [], []
            for text in binaries(batch.column("text")):
                found = words(text)
                spans, owners = matcher.hits(found)
                counts.append(len(found))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                items.append(sorted({matcher.ids[k] for k in owners} - {None}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                    pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
                ],
                names=["rid", "doc_id", "n_words", "starts", "ends", "items"],
            )

    out = by_batches(docs, run, "rid long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>")
    out._sent = sent
    return out


def found_in(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int, shard_words: int) -> DataFrame:
    """What scan() gives, over all shards; docs: rid, doc_id, text."""
    parts = scratch(spark, pieces(items, window, max(2 * window, shard_words // 4)), "pieces")
    total = parts.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // shard_words))
    number = F.pmod(F.xxhash64("words"), F.lit(count))

    def shard(k: int) -> list[tuple[str, bytes]]:
        return sorted(((r["item"], bytes(r["words"])) for r in parts.filter(number == k).select("item", "words").collect()), key=lambda x: (x[0] is None, x))

    if count == 1:
        return scan(spark, docs, shard(0), window)
    rows = scratch(spark, _may_hit(spark, docs, parts, window), "maybe")
    maybe, hits = rows.filter("text IS NOT NULL").select("rid", "doc_id", "text"), []
    for k in range(count):
        found = scan(spark, maybe, shard(k), window)
        hits.append(scratch(spark, found.filter(F.size("starts") > 0).select("rid", "starts", "ends", "items"), "hits"))
        found._sent.destroy()
    joined = hits[0]
    for other in hits[1:]:
        joined = joined.unionByName(other)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    joined = joined.groupBy("rid").agg(flat("starts"), flat("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>" if c == "items" else "array<bigint>")).alias(c)
    return rows.drop("text").join(joined, "rid", "left").select("rid", "doc_id", "n_words", none("starts"), none("ends"), none("items"))


def n_hit(starts, ends):
    """Words in the union of the spans."""
    spans = F.array_sort(F.arrays_zip(starts.alias("a"), ends.alias("b")))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    add = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["b"]).alias("upto")
    )
    return F.aggregate(spans, first, add, lambda acc: acc["n"])


def report(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = found_in(spark, docs, items, window, shard_words).withColumn("n_hit", n_hit(F.col("starts"), F.col("ends")))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cleaned(
    spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, most_covered: float = MOST_COVERED, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """docs without the spans that are hit; documents whose hit share is above most_covered are dropped.

    Spans are judged on the input, over all shards. A removed span goes with the characters between its words; clean documents
    stay as they are."""
    place, row = docs.columns.index("text"), fresh("row", docs)
    rows = numbered(spark, docs, row)
    hit, count, places = (fresh(c, rows) for c in ("hit", "n_words", "spans"))
    found = found_in(spark, rows.select(F.col(row).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window, shard_words)
    spans = found.filter(F.size("starts") > 0).select(F.col("rid").alias(hit), F.col("n_words").alias(count), F.arrays_zip("starts", "ends").alias(places))
    spans = scratch(spark, spans, "spans")
    own = [F.col(f"`{c}`") for c in docs.columns]
    clean = rows.join(spans, rows[row] == spans[hit], "left_anti").select(own)
    touched = rows.join(spans, rows[row] == spans[hit]).select(*own, count, places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, n, found in zip(binaries(batch.column(place)), batch.column(count).to_pylist(), batch.column(places).to_pylist(), strict=True):
                gone = merged([(x["starts"], x["ends"]) for x in found])
                keep.append(sum(b - a for a, b in gone) <= most_covered * n)
                texts.append(without(text, gone))
            columns = list(batch.columns)[:-2]
            columns[place] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    return clean.unionByName(by_batches(touched, run, docs.schema))


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [m.span() for m in FOLDED_WORD.finditer(text.translate(FOLD))]
    out, upto = [], 0
    for a, b in spans:
        out.append(text[upto : at[a][0]])
        upto = at[b - 1][1]
    return b"".join([*out, text[upto:]])

