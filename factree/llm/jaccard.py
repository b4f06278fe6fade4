"""N-gram Jaccard join with skipping by set relations.

A document's set is its distinct word shingles. Documents with equal sets are one node. Nodes are looked up in index
lists: a set's hashed shingles, in order of hash, are cut into blocks by position in hash space, and each block's
digest is a list's key. The number of blocks exceeds the largest difference that two linked sets of that size level
can have, so linked sets agree in a block and meet in its list, while sets that share a common passage only do
not: whole blocks of shingles are skipped unless they agree. A set below the next size level is indexed on its
own level and on the one below, which covers all sizes that can link.

Answers are derived from those of similar sets: each node is compared first with one hub, the most central node of the
lists that it shares most of; what links falls into one component, and all pairs inside a component are skipped from
then on. Lists that lie in one component are done. In the lists left, every pair across components counts, so no link
is lost; within a list, sizes that can't link are skipped as a block, and so are pairs whose parity sketches differ in
more bits than linked sets can differ in shingles (each differing shingle flips one bit, so a sketch never skips a link). The sketches
that lists carry have SKETCH bits, which large sets fill whether they are alike or not; all pairs are held against
sketches that grow with the sets before any text moves. Comparisons of what is left are exact, on the shingles of whole texts; hashes have 64 bits.

What lies on disk at once follows the documents, not the pairs: lists, pairs and texts are brought together in rounds of
bounded size, as many as it takes, and the shuffle files of a round go when it ends.

Defined results: a null or blank text has the empty set and links with nothing; fewer words than a shingle make one
shingle of the whole sequence; equal ids are separate rows with their own texts; a component is named by its least
non-null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import binaries, by_batches, larger, likely, release, rows_kept, scratch, text_digest, with_lookup
from .components import components

#: Members that are compared with one hub in one task.
CHUNK = 200
#: Bits of a parity sketch, at least.
SKETCH = 512
#: A round brings together about so many rows of lists, pairs with their sketches, and bytes of text.
ROUND_ROWS, ROUND_PAIRS, ROUND_BYTES = 20_000_000, 2_000_000, 1 << 30
#: Nodes of a list, or of a part of a longer one, that are paired in one task.
LIST = 5000
#: Pairs of a list that are looked at together.
TILE = 1 << 18
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    x = h[:n]
    for k in range(1, size):
        x = mixed(x) + h[k : k + n]
    return np.unique(mixed(x))


def signature(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=2)


def sketch(tokens: np.ndarray, size: int = SKETCH) -> bytes:
    """size bits, a power of two; a bit tells whether an odd number of tokens falls on it."""
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def sketch_size(n: int, percent: int) -> int:
    """Bits of a sketch that tells sets of n shingles apart: at least four times what two that link can differ in."""
    return max(SKETCH, 1 << (8 * n * (100 - percent) // (100 + percent)).bit_length())


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; a larger one is folded to the size of the other."""
    small, large = sorted((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)), key=len)
    return int(np.bitwise_count(small ^ np.bitwise_xor.reduce(large.reshape(-1, len(small)))).sum())


class Levels:
    """Size levels and their numbers of blocks, for a threshold of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.bounds = percent, [1]

    def of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * 100 // self.percent)))
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def blocks(self, level: int) -> tuple[int, int]:
        """Blocks, and how many may be empty before empty ones must be indexed. (0, 0): only equal sets can link."""
        while len(self.bounds) < level + 2:
            self.of(self.bounds[-1])
        most = self.bounds[level + 1] - 1
        both = most + most * 100 // self.percent
        differ = both * (100 - self.percent) // (100 + self.percent)
        spare = 1 + differ // 16
        return (differ + 1 + spare, spare) if differ else (0, 0)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        out = []
        level = self.of(n) if n else -1
        for at in (level, level - 1):
            blocks, spare = self.blocks(at) if at >= 0 else (0, 0)
            if not blocks:
                continue
            block = ((tokens >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            digest = mixed(np.add.reduceat(mixed(tokens + ODD[0]), first))
            own = np.uint64(at * int(ODD[2]) % 2**64)
            keys = digest + block[first] * ODD[1] + own
            if blocks - len(first) > spare:
                empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[first])
                keys = np.concatenate([keys, empty * ODD[1] + own])
            out.append(mixed(keys))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, digest (of the text), bytes (of the text), n, sig, sketch, wide (a larger sketch, for large sets only); sig is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binaries(batch.column("text"))
            rows = [shingles(t, size) for t in texts]
            n = pa.array([len(t) for t in rows], pa.int64())
            sig = np.array([signature(t) for t in rows], dtype=np.uint64)
            sig = pa.array(signed(sig), mask=np.array([not len(t) for t in rows], dtype=bool))
            marks = pa.array([sketch(t) for t in rows], pa.binary())
            wide = pa.array([sketch(t, bits) if (bits := sketch_size(len(t), percent)) > SKETCH else None for t in rows], pa.binary())
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(map(len, texts), pa.int64()), n, sig, marks, wide]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "bytes", "n", "sig", "sketch", "wide"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), "text")
    return by_batches(rows, run, "doc_id long, digest binary, bytes long, n long, sig long, sketch binary, wide binary")


def lists(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key, sig: the lists that hold two or more different sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = Levels(percent), set()
        for batch in batches:
            keys, sigs, counts, held = [], [], [], 0
            for text in binaries(batch.column("text")):
                tokens = shingles(text, size)
                if (sig := signature(tokens)) in seen:
                    continue  # an equal set of this task is indexed already
                if len(seen) < 1_000_000:
                    seen.add(sig)
                own = levels.keys(tokens)
                keys.append(own)
                sigs.append(sig)
                counts.append(len(own))
                held += len(own)
                if held > 500_000:
                    yield _batch(["key", "sig"], signed(np.concatenate(keys)), np.repeat(signed(np.array(sigs, dtype=np.uint64)), counts))
                    keys, sigs, counts, held = [], [], [], 0
            if held:
                yield _batch(["key", "sig"], signed(np.concatenate(keys)), np.repeat(signed(np.array(sigs, dtype=np.uint64)), counts))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of key and sig, one for each that shares its key with another; only the last row waits for the next batch."""
        last, paired = np.zeros((2, 0), dtype=np.int64), False
        for batch in larger(batches, 50_000):
            rows = np.concatenate([last, np.stack([batch.column(c).to_numpy() for c in ("key", "sig")])], axis=1)
            rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])]
            same = rows[0, 1:] == rows[0, :-1]
            before = np.concatenate([[paired], same])
            keep = before[:-1] | same
            if keep.any():
                yield _batch(["key", "sig"], *rows[:, :-1][:, keep])
            last, paired = rows[:, -1:], bool(before[-1])
        if paired:
            yield _batch(["key", "sig"], *last)

    rows = by_batches(docs.select("text"), emit, "key long, sig long")
    return by_batches(rows.repartition("key").sortWithinPartitions("key", "sig"), shared, "key long, sig long")


def first_pairs(spark: SparkSession, found: DataFrame) -> DataFrame:
    """hub, sig, as a written table: each node with the hub that it shares most lists with. A list's hub is its most central node, the one
    with the most other nodes in all its lists; hubs of hubs are more central yet, so there are no cycles."""
    sizes = scratch(spark, found.groupBy("key").agg(F.count("*").alias("members")), "sizes")
    central = with_lookup(found, sizes, "key", "members").groupBy("sig").agg(F.sum("members").alias("central"))
    hubs = found.join(central, "sig").groupBy("key").agg(F.max(F.struct("central", "sig")).alias("top"), F.count("*").alias("members"))
    hubs = scratch(spark, hubs.select("key", F.col("top.sig").alias("hub"), "members"), "hubs")
    pairs = with_lookup(found, hubs, "key", "members").filter("sig <> hub").groupBy("hub", "sig").agg(F.count("*").alias("lists"))
    pairs = pairs.groupBy("sig").agg(F.max(F.struct("lists", "hub")).alias("best")).select(F.col("best.hub").alias("hub"), "sig")
    pairs = scratch(spark, pairs, "pairs")
    release(sizes, hubs)
    return pairs


def cross_pairs(spark: SparkSession, found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """hub, sig, as a written table: pairs that share a list, lie in different components and may link by sizes and sketches. nodes: sig, n, root, sketch.

    Lists that lie in one component are left out before anything is copied. A longer list than LIST nodes is dealt into parts of
    about that size, and each two parts meet in a group of their own; a task holds one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, sig, n, root, marks in _groups(batches):
            for a, b in _near(n, root, marks, percent, part):
                held.append(np.stack([np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b])]))
                size += len(a)
                if size > 500_000:
                    held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                    if (size := held[0].shape[1]) > 250_000:
                        yield _batch(["hub", "sig"], *held[0])
                        held, size = [], 0
        if size:
            yield _batch(["hub", "sig"], *np.unique(np.concatenate(held, axis=1), axis=1))

    apart = found.join(nodes.select("sig", "root"), "sig").groupBy("key")
    apart = apart.agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("members"))
    apart = scratch(spark, apart.filter("least <> most").select("key", "members"), "apart")
    total = apart.agg(F.sum(F.col("members") * F.ceil(F.col("members") / LIST))).first()[0]
    pairs, rounds = [], _rounds(total, ROUND_ROWS)
    for k in range(rounds):
        here = F.pmod("key", F.lit(rounds)) == k
        rows = with_lookup(found.filter(here), apart.filter(here), "key", "members").filter("members IS NOT NULL").join(nodes, "sig")
        rows = rows.withColumn("parts", F.ceil(F.col("members") / LIST).cast("int"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "sig", "n", "root", "sketch")
        rows = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "n")
        pairs.append(scratch(spark, by_batches(rows, run, "hub long, sig long").distinct(), "pairs"))
    release(apart)
    if rounds == 1:
        return pairs[0]
    out = scratch(spark, reduce(DataFrame.unionByName, pairs).distinct(), "pairs")
    release(*pairs)
    return out


def _rounds(total: int | None, most: int) -> int:
    return max(1, -(-int(total or 0) // most))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray | None, ...]]:
    """part (null for a list in one piece), sig, n, root and sketch of the rows of each (key, one, two), from rows in that order; rows of
    the last group of a batch wait for the next."""
    names = ("key", "one", "two", "part", "sig", "n", "root")
    waiting: list[list[np.ndarray]] = []
    for batch in larger(batches):
        rows = [*(batch.column(c).to_numpy() for c in names), _words(batch.column("sketch"))]
        new = np.zeros(batch.num_rows, dtype=bool)
        for x in rows[:3]:
            new[1:] |= x[1:] != x[:-1]
        new[0] = bool(waiting) and any(w[-1] != x[0] for w, x in zip(waiting[-1][:3], rows[:3], strict=True))
        start = 0
        for end in np.flatnonzero(new):
            if end > start:
                waiting.append([x[start:end] for x in rows])
            yield _group(waiting)
            waiting, start = [], end
        waiting.append([x[start:] for x in rows])
    if waiting:
        yield _group(waiting)


def _group(rows: list[list[np.ndarray]]) -> tuple[np.ndarray | None, ...]:
    _, one, two, part, *rest = (np.concatenate(x) for x in zip(*rows, strict=True)) if len(rows) > 1 else rows[0]
    return part if one[0] != two[0] else None, *rest


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), SKETCH // 64)


def _near(n: np.ndarray, root: np.ndarray, marks: np.ndarray, percent: int, part: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one list, sorted by n, in tiles: sizes rise along the list, so those too large for a row are a block at its end.

    With part, only pairs of different parts."""
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    at = 0
    while at < len(n) - 1:
        upto = at + max(1, min(len(n) - 1 - at, TILE // max(1, int(ends[at]) - at)))
        a, b = np.arange(at, upto), np.arange(at + 1, int(ends[upto - 1]))
        may = (b[None] > a[:, None]) & (b[None] < ends[a][:, None]) & (root[b][None] != root[a][:, None])
        if part is not None:
            may &= part[b][None] != part[a][:, None]
        x, y = np.nonzero(may)
        if len(x):
            x, y = a[x], b[y]
            differ = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64)
            ok = differ * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
            if ok.any():
                yield x[ok], y[ok]
        at = upto


def may_link(spark: SparkSession, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """hub, sig, bytes (of sig's text), as a written table: the pairs of pairs (hub, sig; a written table) that may link by sizes and whole sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("hub_n", "n", "hub_marks", "marks")), strict=True)
            keep = [100 * min(n, m) >= percent * max(n, m) and bits_apart(x, y) * (100 + percent) <= (n + m) * (100 - percent) for n, m, x, y in rows]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["hub", "sig", "bytes"])

    marks = classes.select("sig", "n", "bytes", F.coalesce("wide", "sketch").alias("marks"))
    degree = pairs.groupBy("hub").agg(F.count("*").alias("degree"))
    hubs = marks.select(F.col("sig").alias("hub"), F.col("n").alias("hub_n"), F.col("marks").alias("hub_marks"))
    hubs = scratch(spark, degree.join(hubs, "hub"), "hubs")
    close, rounds = [], _rounds(pairs.count(), ROUND_PAIRS)
    for k in range(rounds):
        part = pairs.filter(F.pmod(F.xxhash64("hub", "sig"), F.lit(rounds)) == k)
        rows = with_lookup(part, hubs, "hub", "degree").join(marks.hint("merge"), "sig")
        rows = rows.select("hub", "sig", "bytes", "hub_n", "n", "hub_marks", "marks")
        close.append(scratch(spark, by_batches(rows, run, "hub long, sig long, bytes long"), "close"))
    release(hubs)
    if rounds == 1:
        return close[0]
    out = scratch(spark, reduce(DataFrame.unionByName, close), "close")
    release(*close)
    return out


def texts_of(spark: SparkSession, pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """sig, text, as a written table, of the sets in pairs."""
    sigs = pairs.select("sig").unionByName(pairs.select(F.col("hub").alias("sig"))).distinct()
    wanted = sigs.join(classes, "sig").select("sig", F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
    wanted = scratch(spark, wanted.withColumn("__hash", F.xxhash64("__digest")), "wanted")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", text_digest(F.col("text")))
    keyed = likely(keyed, F.xxhash64("digest"), wanted, "__hash")
    same = keyed["doc_id"].eqNullSafe(wanted["__id"]) & (keyed["digest"] == wanted["__digest"])
    texts = scratch(spark, keyed.join(wanted.hint("merge"), same).select("sig", "text").dropDuplicates(["sig"]), "texts")
    release(wanted)
    return texts


def linked(spark: SparkSession, pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of pairs (hub, sig; a written table) that link, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub_set = None, None
        for batch in batches:
            hubs, chunks, kind, sigs = (batch.column(c).to_pylist() for c in ("hub", "chunk", "member", "sig"))
            a, b = [], []
            for hub, chunk, member, sig, text in zip(hubs, chunks, kind, sigs, binaries(batch.column("text")), strict=True):
                if not member:
                    now, hub_set = (hub, chunk), shingles(text, size)
                elif now == (hub, chunk):
                    own = shingles(text, size)
                    both = len(np.intersect1d(hub_set, own, assume_unique=True))
                    if 100 * both >= percent * (len(hub_set) + len(own) - both):
                        a.append(hub)
                        b.append(sig)
            yield _batch(["a", "b"], np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))

    close = may_link(spark, pairs, classes, percent)
    texts = texts_of(spark, close, docs, classes)
    degree = scratch(spark, close.groupBy("hub").agg(F.count("*").alias("degree")), "degree")
    rounds = _rounds(close.agg(F.sum("bytes")).first()[0], ROUND_BYTES)
    chunked = with_lookup(close, degree, "hub", "degree")
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("sig"), F.ceil(F.col("degree") / CHUNK)))
    chunked = chunked.select("hub", "chunk", "sig", F.pmod(F.xxhash64("hub", "chunk"), F.lit(rounds)).alias("round"))
    chunked = scratch(spark, chunked, "pairs")
    release(close, degree)
    found = []
    for k in range(rounds):
        part, needed = chunked.filter(F.col("round") == k).select("hub", "chunk", "sig"), texts
        if rounds > 1:
            sigs = part.select("sig").unionByName(part.select(F.col("hub").alias("sig"))).distinct()
            sigs = scratch(spark, sigs.select(F.xxhash64("sig").alias("__hash")), "needed")
            needed = likely(texts, F.xxhash64("sig"), sigs, "__hash")
        members = part.join(needed.hint("merge"), "sig").select("hub", "chunk", F.lit(True).alias("member"), "sig", "text")
        hubs = part.select("hub", "chunk").distinct().join(needed.withColumnRenamed("sig", "hub").hint("merge"), "hub")
        rows = members.unionByName(hubs.select("hub", "chunk", F.lit(False).alias("member"), F.col("hub").alias("sig"), "text"))
        rows = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "member")
        found.append(scratch(spark, by_batches(rows, run, "a long, b long"), "links"))
        if rounds > 1:
            release(sigs)
    release(chunked, texts)
    return reduce(DataFrame.unionByName, found)


def near_classes(spark: SparkSession, docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, digest, n, component_id and keep (one row per component), one row per row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = scratch(spark, sets(docs, size, percent), "sets")
    own = F.struct(F.col("doc_id").isNull().alias("isnull"), "doc_id", "digest")
    one = [F.first(c).alias(c) for c in ("n", "sketch", "wide")]
    classes = rows.filter("sig IS NOT NULL").groupBy("sig").agg(F.min(own).alias("first"), *one, F.max("bytes").alias("bytes"), F.count("*").alias("copies"))
    classes = scratch(spark, classes, "classes")
    found = scratch(spark, lists(docs, size, percent), "lists")

    first = first_pairs(spark, found)
    up = trees(spark, linked(spark, first, docs, classes, size, percent))
    release(first)
    nodes = found.select("sig").distinct().join(classes.select("sig", "n", "sketch"), "sig").join(up, F.col("sig") == F.col("node"), "left")
    nodes = scratch(spark, nodes.select("sig", "n", "sketch", F.coalesce("root", "sig").alias("root")), "nodes")
    second = cross_pairs(spark, found, nodes, percent)
    release(found, nodes)
    roots = up
    if not second.isEmpty():
        more = linked(spark, second, docs, classes, size, percent)
        over = lambda c, name: more.join(up.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
        more = scratch(spark, over("a", "ra"), "links")
        release(second)
        more = scratch(spark, over("b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct(), "links")
        joined = components(spark, more)
        tops = up.unionByName(up.select(F.col("root").alias("node"), "root")).unionByName(joined.select("node", F.col("node").alias("root"))).distinct()
        top = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = scratch(spark, tops.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        roots = roots.groupBy("node").agg(F.min("root").alias("root"))
    else:
        roots = up.unionByName(up.select(F.col("root").alias("node"), "root").distinct())
    out = _named(spark, rows, classes, roots)
    release(classes)
    return out


def trees(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (a, b), at most one for each b and without cycles -> node, root for every b, by doubling the steps up."""
    up = scratch(spark, links.select(F.col("b").alias("node"), F.col("a").alias("root")), "trees")
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = scratch(spark, up.join(above.hint("merge"), "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "trees")
        up = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return up


def _named(spark: SparkSession, rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each row with its component's first document."""
    nodes = classes.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "first", "copies", F.coalesce("root", "sig").alias("root"))
    nodes = scratch(spark, nodes, "nodes")
    heads = scratch(spark, nodes.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("members")), "heads")
    named = scratch(spark, with_lookup(nodes.select("sig", "root", "copies"), heads, "root", "members").select("sig", "head", "copies"), "named")
    release(nodes, heads)
    out = with_lookup(rows.select("doc_id", "digest", "n", "sig"), named, "sig", "copies")
    alone = F.col("head").isNull()
    keep = alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("digest") == F.col("head.digest")))
    component: Column = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return out.select("doc_id", "digest", "n", component.alias("component_id"), keep.alias("keep"))


def without_near_copies(spark: SparkSession, docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs, one of each component; rows without words stay."""
    decided = scratch(spark, near_classes(spark, docs, size, percent).select("doc_id", "digest", "keep"), "decided")
    return rows_kept(spark, docs, decided, text_digest(F.col("text")))
