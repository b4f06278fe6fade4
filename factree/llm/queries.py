"""The queries opN_<name> over whole tables, and their SQL where there is any."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, disclosure, exact_dedup, html_text, jaccard, lattice, licenses, mixing, quality, substrings
from .base import crc_mod, read

#: The vocabulary whose scores op8 takes; a sentencepiece model.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod(F.col("doc_id"), 5) == 0
    ranking = quality.fit_labels(spark, docs, read(spark, sf_dir, "labels"), ~held_out)
    rows = quality.scored(spark, docs, ranking)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(spark, read(spark, sf_dir, "documents"))


def op3_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(spark, read(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("rid")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", expected=docs.count())
    rows = index.deduplicate(docs, deliveries=2)  # the second half meets the first in the index
    index.drop()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op7_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, read(spark, sf_dir, "pages"))


def op8_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)


def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard.near_classes(spark, read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


QUERIES = {f.__name__: f for f in (op1_quality_ranking, op2_substring_dedup, op3_disclosing_terms, op4_mix_sources, op5_exact_dedup, op6_benchmark_decontamination, op7_html_min_cut, op8_lattice_score, op9_license_templates, op10_ngram_jaccard)}

FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

SQL = {
    "op2_substring_dedup": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        windows AS (SELECT rid, i, sha256(array_to_string(w[i:i + 34], ' ')) AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        twice AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
        gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN twice USING (t)),
        words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
        lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)""",
    "op6_benchmark_decontamination": f"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {FOLDED} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM
            (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        d AS (SELECT row_number() OVER () AS rid, doc_id, {FOLDED} AS w FROM documents),
        places AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS t FROM
            (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows))),
        found AS (SELECT rid, i, size, item FROM places JOIN windows USING (size, t)),
        hit AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY rid),
        items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)""",
    "op10_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {LOWERED} AS w FROM documents),
        shingles AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 3], ' ') || ' ' || least(len(w), 4) AS t FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
        links AS (SELECT a.rid AS a, b.rid AS b, b.doc_id FROM shingles a JOIN shingles b ON a.t = b.t JOIN sizes x ON x.rid = a.rid JOIN sizes y ON y.rid = b.rid
            WHERE a.rid <> b.rid AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n GROUP BY a.rid, b.rid, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least_ids AS (SELECT r.a AS rid, min(doc_id) AS component_id FROM reach r JOIN d ON d.rid = r.b GROUP BY r.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sizes USING (rid) JOIN least_ids USING (rid)""",
    "op4_mix_sources": """
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   -ln((CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
                   / ((length(translate(coalesce(text, ''), '#$%&*|!0123456789', '')) + 1) / (length(coalesce(text, '')) + 1)) AS key
            FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
        filled AS (
            SELECT *, row_number() OVER w AS rank,
                   (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM ranked WINDOW w AS (ORDER BY source_size * 3 / weight, source NULLS LAST)),
        final AS (SELECT *, (SELECT arg_min(level, rank) FROM filled WHERE source_size * 3 >= level * weight) AS final FROM filled),
        plan AS (
            SELECT source, source_size, CASE WHEN final IS NULL OR source_size * 3 < final * weight THEN CAST(source_size * 3 AS DOUBLE) ELSE final * weight END AS target
            FROM final),
        placed AS (
            SELECT s.doc_id, s.size, p.source_size, p.target,
                   CASE WHEN p.source_size > 0 THEN CAST(floor(p.target / p.source_size) AS BIGINT) ELSE 0 END AS epochs,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS upto
            FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - upto)) AS BIGINT) AS taken
        FROM placed""",
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}
