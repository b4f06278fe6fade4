"""Language-model scores: words are mixed from corpus counts and a subword lattice over an existing vocabulary.

The probability of a word under the lattice is the sum over all its segmentations into pieces of the vocabulary, by
a forward recursion in log space, where each segmentation weighs the product of its pieces' probabilities. The
vocabulary's own scores rank the pieces; a piece of rank r weighs 1 / (r + 10), normalised. These weights keep the share OWN of every
piece's probability whatever the corpus is like; the rest is learned by `rounds` rounds of expected counts over all distinct
training words (forward and backward over the lattice), so a segmentation always weighs by the vocabulary's scores and by use.
The pieces are as many as the vocabulary has, so what a corpus tells about its words beyond them is kept in word counts that
grow with it: a training word is one more path through the lattice, with its count as weight. For N training tokens,
V of them distinct, and count c, a word has the probability (c + V * lattice) / (N + V); the lattice is the only path of a word
that is not among them. A document's probability is the product over its words and one end.

Counts of all words of all documents are summed per task before the shuffle. For scoring, the words that occur most, in training
rows or not, HEAD at most (long ones by their digest), go to the tasks by broadcast; all others, each rarer than
any of those, are summed per document and joined by shuffle, so no task and not the driver holds a vocabulary that grows with the
corpus, and no key of the join is hot.

Defined results: a null text is an empty one: one token, the end. Null ids are training rows (see crc_mod). Repeated
rows are scored one by one. An empty table gives no rows; without training rows every known count is 0. Words of any length
have their whole probability, without a floor. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import binaries, by_batches, crc_mod, larger, scratch

#: Words sent to the tasks with their probabilities at most, and the most bytes that one has there.
HEAD, HEAD_BYTES = 150_000, 64
#: Share of the vocabulary's own weights in the probabilities of the pieces.
OWN = 0.25
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Words of more characters take the plain recursion instead of the one over many words at once.
LONG = 40
#: Longer words go by this byte, which no text has, and their SHA-256.
DIGEST = b"\xff"
START = "▁"
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lattice:
    """pieces (START marks the begin of a word) and their log probabilities; a character that is no piece costs its bytes."""

    pieces: list[str]
    logp: np.ndarray
    log_byte: float

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.number = {p: k for k, p in enumerate(self.pieces)}
        keys = np.array([_key(np.array([[ord(c) for c in p]], dtype=np.uint64))[0] for p in self.pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same key")

    def __getstate__(self) -> tuple:
        return self.pieces, self.logp, self.log_byte

    def __setstate__(self, state: tuple) -> None:
        self.pieces, self.logp, self.log_byte = state
        self.__post_init__()

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the words' marginal probabilities."""
        out = np.zeros(len(words))
        for at, codes in grouped(words):
            out[at] = self._forward(codes)[0][:, -1] if codes is not None else self._single(words[at[0]].decode("utf-8", "replace"))
        return out

    def _arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, ids or -1, log weights) by end, for the words of equal length in codes."""
        n, length = codes.shape
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        key = np.zeros((n, length), dtype=np.uint64)
        for k in range(1, min(self.longest, length) + 1):
            width = length - k + 1
            key = key[:, :width] * MIX + codes[:, k - 1 : k - 1 + width] + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ids = np.where(self.keys[at] == key, self.order[at], -1)
            weight = np.where(ids >= 0, self.logp[ids], -np.inf)
            if k == 1:
                size = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
                weight = np.where(ids >= 0, weight, size * self.log_byte)
            for start in range(width):
                if k == 1 or (ids[:, start] >= 0).any():
                    found[start, start + k] = ids[:, start], weight[:, start]
        for start, end in sorted(found, key=lambda x: (x[1], x[0])):
            yield start, end, *found[start, end]

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        n, length = codes.shape
        forward = np.full((n, length + 1), -np.inf)
        forward[:, 0] = 0
        arcs = list(self._arcs(codes))
        for start, end, _, weight in arcs:
            forward[:, end] = np.logaddexp(forward[:, end], forward[:, start] + weight)
        return forward, arcs

    def _single(self, word: str) -> float:
        return self._forward_single(START + word)[-1]

    def _ending(self, text: str, end: int) -> Iterator[tuple[int, int, float]]:
        """(start, id or -1, log weight) of the arcs to end."""
        for start in range(max(0, end - self.longest), end):
            k = self.number.get(text[start:end])
            if k is not None:
                yield start, k, self.logp[k]
            elif end - start == 1:
                yield start, -1, len(text[start].encode()) * self.log_byte

    def _forward_single(self, text: str) -> list[float]:
        forward = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            terms = [forward[start] + weight for start, _, weight in self._ending(text, end)]
            most = max(terms)
            forward[end] = most + math.log(sum(math.exp(t - most) for t in terms)) if most > -math.inf else most
        return forward

    def _add_uses(self, word: str, total: np.ndarray) -> None:
        """Adds a long word's expected uses to total; an end's backward sum is whole once all later ends are done."""
        text = START + word
        forward = self._forward_single(text)
        backward = [-math.inf] * len(text) + [0.0]
        for end in range(len(text), 0, -1):
            for start, k, weight in self._ending(text, end):
                x, y = backward[start], backward[end] + weight
                backward[start] = max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y
                if k >= 0:
                    total[k] += math.exp(forward[start] + y - forward[-1])

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over the words, once each."""
        total = np.zeros(len(self.pieces))
        for at, codes in grouped(words):
            if codes is None:
                self._add_uses(words[at[0]].decode("utf-8", "replace"), total)
                continue
            forward, arcs = self._forward(codes)
            backward = np.full(forward.shape, -np.inf)
            backward[:, -1] = 0
            for start, end, _, weight in reversed(sorted(arcs, key=lambda a: (a[0], a[1]))):
                backward[:, start] = np.logaddexp(backward[:, start], backward[:, end] + weight)
            whole = forward[:, -1]
            for start, end, ids, weight in arcs:
                used = ids >= 0
                share = np.exp(forward[used, start] + weight[used] + backward[used, end] - whole[used])
                total += np.bincount(ids[used], weights=share, minlength=len(total))
        return total


def _key(codes: np.ndarray) -> np.ndarray:
    key = np.zeros(codes.shape[0], dtype=np.uint64)
    for k in range(codes.shape[1]):
        key = key * MIX + codes[:, k] + np.uint64(1)
    return key


def grouped(words: list[bytes], most: int = 20_000) -> Iterator[tuple[list[int], np.ndarray | None]]:
    """Places of words of equal length and their code points (with START in front); None for a long word by itself."""
    texts = [w.decode("utf-8", "replace") for w in words]
    by_length: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        if len(t) > LONG:
            yield [k], None
        else:
            by_length.setdefault(len(t), []).append(k)
    for length, places in by_length.items():
        for a in range(0, len(places), most):
            at = places[a : a + most]
            joined = "".join(START + texts[k] for k in at)
            yield at, np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).reshape(len(at), length + 1).astype(np.uint64)


def lattice_of(path: str) -> Lattice:
    """From a sentencepiece model: pieces by rank of their scores, weight 1 / (rank + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [
        (model.get_score(k), k, model.id_to_piece(k))
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k))
    ]
    rows = [r for r in sorted(rows, key=lambda r: (-r[0], r[1])) if START not in r[2][1:]]
    weight = 1 / (np.arange(len(rows)) + 10.0)
    # bytes that stand for characters that are no pieces share a thousandth
    return Lattice([r[2] for r in rows], np.log(0.999 * weight / weight.sum()), math.log(0.001 / 256))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (its count over rows with learn) and n (over all rows). docs: learn, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter[bytes] = Counter()
        others: Counter[bytes] = Counter()

        def out(counts: Counter[bytes], learn: bool) -> pa.RecordBatch:
            found = pa.array(list(counts.values()), pa.int64())
            none = pa.array(np.zeros(len(counts), dtype=np.int64))
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), found if learn else none, found], names=["word", "c", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for learn, text in zip(batch.column("learn").to_pylist(), binaries(batch.column("text")), strict=True):
                (learned if learn else others).update(tokens(text))
                if len(learned) + len(others) > HELD:
                    yield out(learned, True)
                    yield out(others, False)
        yield out(learned, True)
        yield out(others, False)

    found = by_batches(docs.select("learn", "text"), run, "word binary, c long, n long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def adapted(spark: SparkSession, lattice: Lattice, counts: DataFrame, start: Lattice) -> Lattice:
    """The lattice with weights from expected uses over the distinct training words; the share OWN stays with those of start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.pieces))
        for batch in larger(batches):
            total += lattice.expected(batch.column("word").to_pylist())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.float64())], names=["piece", "n"])

    rows = by_batches(counts.filter("c > 0").select("word"), run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    uses = np.zeros(len(lattice.pieces))
    for r in rows:
        uses[r["piece"]] = r["n"]
    if not uses.sum():
        return lattice
    old = np.exp(start.logp)
    return Lattice(lattice.pieces, np.log(0.999 * ((1 - OWN) * uses / uses.sum() + OWN * old / old.sum())), lattice.log_byte)


def head_count(counts: DataFrame, most: int = HEAD) -> float:
    """The least count, of steps of an eighth of a power of 2, that at most `most` words reach."""
    step = F.floor(F.log2("n") * 8)
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, total = math.inf, 0
    for r in sorted(found, key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    return least


def score(spark: SparkSession, docs: DataFrame, vocabulary: str | Lattice, held_out=None, rounds: int = 2, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text)."""
    held = crc_mod(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held).alias("learn"), "text")
    counts = scratch(spark, word_counts(rows), "counts")
    ends = rows.filter("learn").count()
    seen = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = seen[0] + ends, seen[1] + (ends > 0)
    start = lattice = lattice_of(vocabulary) if isinstance(vocabulary, str) else vocabulary
    for _ in range(rounds):
        lattice = adapted(spark, lattice, counts, start)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches):
            found, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            with np.errstate(divide="ignore"):  # log 0 is -inf: the lattice alone
                mixed = np.logaddexp(np.log(c), math.log(max(v, 1)) + lattice.log_probability(found))
            mixed = (mixed - math.log(n + max(v, 1))) / math.log(10)
            base = np.log10((c + 1) / (n + v + 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("word", "c", "n")), pa.array(base), pa.array(mixed)], names=["word", "c", "n", "base", "mixed"])

    weighed = scratch(spark, by_batches(counts, weigh, "word binary, c long, n long, base double, mixed double"), "weighed")
    key = F.when(F.length("word") <= HEAD_BYTES, F.col("word")).otherwise(F.concat(F.lit(DIGEST), F.unhex(F.sha2("word", 256))))
    sent = weighed.filter(F.col("n") >= head_count(weighed, head)).select(key.alias("key"), "c", "base", "mixed").toArrow()
    columns = [sent.column(c).to_pylist() for c in ("key", "c", "base", "mixed")]
    known = spark.sparkContext.broadcast({k: (b, m, int(c > 0)) for k, c, b, m in zip(*columns, strict=True)})
    end = (math.log10((ends + 1) / (n + v + 1)), math.log10(max(ends, 1) / (n + max(v, 1))), int(ends > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            out, rare = [], []
            for text in binaries(batch.column("text")):
                found = tokens(text)
                base, mixed, hits, others = end[0], end[1], end[2], []
                for w in found:
                    x = get(w if len(w) <= HEAD_BYTES else DIGEST + sha256(w).digest())
                    if x is None:
                        others.append(w)
                    else:
                        base += x[0]
                        mixed += x[1]
                        hits += x[2]
                out.append((len(found) + 1, hits, base, mixed))
                rare.append(list(Counter(others).items()))
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("learn"), *columns, pa.array(rare, pa.map_(pa.binary(), pa.int64()))],
                names=["rid", "doc_id", "learn", "n_tokens", "hits", "base", "mixed", "rare"],
            )

    schema = "rid long, doc_id long, learn boolean, n_tokens long, hits long, base double, mixed double, rare map<binary,bigint>"
    part = scratch(spark, by_batches(rows.withColumn("rid", F.monotonically_increasing_id()), run, schema), "scored")
    tail = part.select("rid", F.explode("rare").alias("word", "times")).join(weighed.hint("merge"), "word")
    times = lambda c: F.sum(F.col("times") * F.col(c))
    tail = tail.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("t_hits"), times("base").alias("t_base"), times("mixed").alias("t_mixed"))
    both = part.drop("rare").join(tail, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return both.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", plus("hits", "t_hits").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "t_base").alias("base_score"), plus("mixed", "t_mixed").alias("score"),
    )
