"""Personal data by fixed patterns, and terms that disclose it by corpus co-occurrence; DataFrame operations only.

Base hits are e-mail addresses, IP addresses, card numbers and phone numbers. Their values are the protected entities.
So are what they are part of: an address's domain, an IP address's first three numbers, a card's first six digits and a
phone number but its last four. Every word (its edges without marks, lower-cased, of TERM characters or more) of a document with an
entity is a candidate term, wherever it stands. Over all documents of the corpus, with n documents in which the term occurs and k
in which both occur, the chance of the entity given the term is k / n, and the term reveals log2(k * N / (n * n_e)) bits about which
of the N documents' entities is meant (n_e documents have the entity). Terms that reach both thresholds for an entity are spans of
kind "term" in every document that has the term: where the entity itself stands, and, if SUPPORT documents or more have both,
in documents without it, where they tell it just as much. A word that only its document has tells an entity of that document for certain. sanitised() generalises base hits to their kind,
removes terms whose chance is REMOVE or more and generalises the others to the shape of the word.

Entities that stand in the same documents are counted once, by a hash of 64 bits of their documents. As k is at most n
and n_e, terms of more than n_e / CHANCE documents and entities of more than N / 2^BITS can't pass and are left out before.
Only terms with k < n can stand outside the entity's documents; they alone are looked for there.

Patterns are written so that Java's matcher neither backtracks nor recurses on long runs: a run is entered at its
begin (or where the last match ended) and taken whole, which finds the same leftmost matches.

Defined results: a null text counts as empty: no hits, digest of the empty string, no spans; repeated rows are separate
documents; null ids pass through; an empty table gives no rows. Documents' words are counted whole. find() and report() look at no
other columns; sanitised() hands them on and adds n_spans, called _n_spans if the table has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WORD, fresh, likely, numbered, release, scratch, with_lookup

#: Kinds in the order of the output, each as a pattern that takes what the plain one (see README) takes.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Least chance of the entity given the term, least bits.
CHANCE, BITS = 0.5, 4.0
#: Terms of this chance or more are removed, others generalised.
REMOVE = 0.9
#: Documents with a term and an entity from which on the term counts outside the entity's documents; one alone is no estimate.
SUPPORT = 2
#: Least characters of a term.
TERM = 3
#: Characters at the ends of a word that do not belong to the term.
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def hits(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end, value>>: matches (those that keep takes) with their places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        out = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))))
        return F.struct(end.alias("at"), (F.when(keep(x["value"]), out).otherwise(acc["out"]) if keep else out).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, add, lambda acc: acc["out"])).otherwise(start["out"])


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        in_order = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.try_to_number(d, F.lit("9")).cast("int") * (k % 2 + 1))
        luhn = F.aggregate(in_order, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0
        return F.when(F.length(digits).between(16, 19), luhn).otherwise(False)
    return F.lit(True)


def base_hits(text: Column, kind: str) -> Column:
    return F.filter(hits(text, PATTERNS[kind]), lambda h: valid(kind, h["value"]))


def term(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, EDGE, ""))


def terms(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), term)
    return F.array_distinct(F.filter(words, lambda t: F.length(t) >= TERM))


def wider(kind: str, value: Column) -> Column:
    """What the value is part of."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lower(F.substring_index(value, "@", -1))
    if kind == "ip":
        return F.substring_index(value, ".", 3)
    return F.substring(digits, F.lit(1), F.lit(6) if kind == "card" else F.length(digits) - 4)


def _entities(kind: str) -> Column:
    both = lambda v: F.array(F.concat(F.lit(f"{kind}:"), v), F.concat(F.lit(f"{kind} of:"), wider(kind, v)))
    return F.flatten(F.transform(F.col(kind), lambda h: both(h["value"])))


NO_TERMS = "array<struct<start:int,end:int,value:string,chance:double>>"


def _places(text: Column, marked: Column, base: Column) -> Column:
    """NO_TERMS with the words whose terms marked (term -> chance) has and that touch no base hit."""
    found = hits(text, WORD, lambda w: F.map_contains_key(marked, term(w)))
    clear = F.filter(found, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    own = lambda w: F.element_at(marked, term(w["value"]))
    return F.transform(clear, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"), own(w).alias("chance")))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find(spark: SparkSession, docs: DataFrame, chance: float = CHANCE, bits: float = BITS, row: str | None = None) -> DataFrame:
    """rid, doc_id, email, ip, card, phone (arrays of hits) and term (NO_TERMS), one row per document.

    row names a column of longs that tells rows apart and becomes rid; without it one is made."""
    rid = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = scratch(spark, rows.select("*", *[base_hits(F.col("text"), k).alias(k) for k in PATTERNS]), "hits")
    total, with_hits = base.count(), base.filter(F.size(F.concat(*PATTERNS)) > 0)

    entities = with_hits.select("rid", F.explode(F.array_distinct(F.concat(*[_entities(k) for k in PATTERNS]))).alias("entity"))
    sets = entities.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("rid")).alias("rids"))
    sets = scratch(spark, sets.filter(F.col("n_e") * F.lit(2.0**bits) <= total), "entities")
    sets = with_lookup(entities, sets, "entity", "n_e").filter("n_e is not null").select("rid", "rids", "n_e").distinct()

    terms_of = lambda found: found.select("rid", F.explode(terms(F.col("text"))).alias("term"))
    frequency = scratch(spark, terms_of(base).groupBy("term").agg(F.count("*").alias("n")), "terms")
    pairs = with_lookup(terms_of(with_hits), frequency, "term", "n").join(sets, "rid").filter(F.col("n") * chance <= F.col("n_e"))
    pairs = scratch(spark, pairs.select("rid", F.xxhash64("rids", "n_e", "term").alias("pair"), "rids", "n_e", "term", "n"), "pairs")

    together = pairs.groupBy("pair", "rids", "n_e", "term", "n").agg(F.count("*").alias("k"))
    reveals = F.log2(F.col("k") * F.lit(float(max(total, 1))) / (F.col("n") * F.col("n_e")))
    told = together.filter((F.col("k") >= chance * F.col("n")) & (reveals >= bits)).withColumn("chance", F.col("k") / F.col("n"))
    told = scratch(spark, told.select("pair", F.col("rids").alias("e"), F.col("term").alias("t"), "k", "n", "chance"), "told")
    marks = with_lookup(pairs.select("rid", "pair", "rids", "term"), told, "pair", "k").filter((F.col("rids") == F.col("e")) & (F.col("term") == F.col("t")))
    marks = marks.select("rid", "term", "chance")
    loose = told.filter(f"k < n AND k >= {SUPPORT}").groupBy(F.col("t").alias("term")).agg(F.first("n").alias("n"), F.max("chance").alias("chance"))
    loose = scratch(spark, loose.withColumn("hash", F.xxhash64("term")), "loose")
    if not loose.isEmpty():
        words = likely(terms_of(base), F.xxhash64("term"), loose, "hash")
        marks = marks.unionByName(with_lookup(words, loose, "term", "n").filter("n is not null").select("rid", "term", "chance"))
    marked = marks.groupBy("rid", "term").agg(F.max("chance").alias("chance")).groupBy("rid")
    marked = marked.agg(F.map_from_entries(F.collect_list(F.struct("term", "chance"))).alias("marked"))
    marked = scratch(spark, marked.withColumn("hash", F.xxhash64("rid")), "marked")
    release(frequency, pairs, told, loose)
    places = _places(F.col("text"), F.col("marked"), F.concat(*PATTERNS))
    spots = likely(base, F.xxhash64("rid"), marked, "hash").join(marked, "rid").select("rid", places.alias("term"))
    return base.drop("text").join(spots, "rid", "left").withColumn("term", F.coalesce("term", F.array().cast(NO_TERMS)))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows = find(spark, docs)
    base = F.concat(*[listed(k, F.col(k)) for k in PATTERNS])
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("term", F.col("term"))), ",").alias("spans"), F.size("term").cast("long").alias("n_term"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """text with spans (start, end, mask) replaced; of spans that overlap the one that begins first (then the longest) stands."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    first = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        with_gap = F.concat(acc["out"], F.substring(text, acc["upto"] + 1, s["start"] - acc["upto"]), s["mask"])
        return F.when(s["start"] < acc["upto"], acc).otherwise(F.struct(s["end"].alias("upto"), with_gap.alias("out")))

    done = F.aggregate(order, first, add)
    return F.concat(done["out"], F.substring(text, done["upto"] + 1, F.length(text)))


def masks(kind: str) -> Column:
    """array<struct<start, end, mask>> of a kind's spans."""

    def mask(s: Column) -> Column:
        if kind != "term":
            return F.lit(f"[{kind}]")
        shape = F.when(s["value"].rlike(r"[0-9]"), "[number]").when(F.regexp_replace(s["value"], EDGE, "").rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
        return F.when(s["chance"] >= REMOVE, "").otherwise(shape)

    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mask(s).alias("mask")))


def sanitised(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with base hits generalised to their kind in brackets, terms removed or generalised to [name], [number] or [word]; n_spans comes last."""
    row, count = fresh("row", docs), fresh("n_spans", docs)
    rows = numbered(spark, docs, row)
    key, spans = fresh("rid", rows), fresh("spans", rows)
    found = find(spark, rows, row=row).select(F.col("rid").alias(key), F.concat(*[masks(k) for k in [*PATTERNS, "term"]]).alias(spans))
    rows = rows.join(found, rows[row] == found[key])
    text = F.when(F.size(spans) > 0, replaced(F.coalesce("text", F.lit("")), F.col(spans))).otherwise(F.col("text"))
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*kept, F.size(spans).cast("long").alias(count))
