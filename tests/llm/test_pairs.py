import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from factree.llm import components, exact_dedup, jaccard, substrings
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_near_classes_are_the_components_of_all_pairs(spark, corpus, documents, size, percent):
    got = jaccard.near_classes(spark, documents, size, percent)
    want = brute.components([r[:2] for r in corpus], size, percent)
    assert rows(got, "doc_id", "n", "component_id") == sorted(want, key=repr)
    assert got.filter("keep").count() == len({c for d, n, c in want})


def test_long_lists_are_paired_in_parts(spark, corpus, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 7)
    got = jaccard.near_classes(spark, documents)
    assert rows(got, "doc_id", "n", "component_id") == sorted(brute.components([r[:2] for r in corpus]), key=repr)


def test_rounds_change_nothing(spark, corpus, documents, monkeypatch):
    for name, most in (("ROUND_ROWS", 900), ("ROUND_PAIRS", 60), ("ROUND_BYTES", 40_000)):
        monkeypatch.setattr(jaccard, name, most)
    got = jaccard.near_classes(spark, documents)
    assert rows(got, "doc_id", "n", "component_id") == sorted(brute.components([r[:2] for r in corpus]), key=repr)


def test_texts_of_large_sets_that_share_a_passage_do_not_move(spark, monkeypatch):
    pick, moved, write = random.Random(9), [], jaccard.scratch

    def scratch(spark, df, name):
        out = write(spark, df, name)
        if name == "texts":
            moved.append(out.count())
        return out

    passage = [f"p{pick.random()}" for _ in range(300)]
    texts = [[f"w{pick.random()}" for _ in range(1800 + 20 * k)] + passage for k in range(30)]
    texts.append(["other", *texts[3]])
    corpus = [(k, " ".join(t)) for k, t in enumerate(texts)]
    monkeypatch.setattr(jaccard, "scratch", scratch)
    got = jaccard.near_classes(spark, spark.createDataFrame(corpus, "doc_id long, text string"), 5, 80)
    assert rows(got, "doc_id", "n", "component_id") == sorted(brute.components(corpus, 5, 80), key=repr)
    assert sum(moved) == 2


def test_whole_sketches_never_differ_in_more_bits_than_the_sets():
    pick = np.random.default_rng(5)
    every = np.unique(pick.integers(0, 2**63, 9000).astype(np.uint64) * np.uint64(2))
    sizes = [jaccard.sketch_size(n, 80) for n in (1, 500, 3000, 9000)]
    assert sizes[0] == sizes[1] == jaccard.SKETCH and sizes == sorted(sizes) and sizes[3] >= 9000 * 8 // 9
    for n in (400, 700, 2500, 8000):
        for m in (500, 1500, 8500):
            x, y = np.sort(pick.permutation(every)[:n]), np.sort(pick.permutation(every)[:m])
            marks = [jaccard.sketch(t, jaccard.sketch_size(len(t), 80)) for t in (x, y)]
            assert jaccard.bits_apart(*marks) == jaccard.bits_apart(*marks[::-1]) <= len(np.setxor1d(x, y))
            assert jaccard.bits_apart(marks[0], jaccard.sketch(x)) == 0


def test_groups_that_end_in_any_batch(monkeypatch):
    monkeypatch.setattr(jaccard, "larger", lambda batches: batches)
    pick = random.Random(3)
    rows = sorted((pick.randrange(4), pick.randrange(2), pick.randrange(2), pick.randrange(99)) for _ in range(60))
    names = ["key", "one", "two", "part", "sig", "n", "root"]
    for step in (1, 2, 7, 60):
        batches = []
        for at in range(0, 60, step):
            cut = np.array([(k, a, b, 0, n, n, n) for k, a, b, n in rows[at : at + step]], dtype=np.int64)
            marks = pa.array([bytes(jaccard.SKETCH // 8)] * len(cut), pa.binary())
            batches.append(pa.RecordBatch.from_arrays([*map(pa.array, cut.T), marks], names=[*names, "sketch"]))
        found = [(part is None, n.tolist(), marks.shape) for part, _, n, _, marks in jaccard._groups(iter(batches))]
        expected = [(k[1] == k[2], [r[3] for r in g]) for k, g in ((k, list(g)) for k, g in itertools.groupby(rows, key=lambda r: r[:3]))]
        assert found == [(same, n, (len(n), jaccard.SKETCH // 64)) for same, n in expected]
    assert list(jaccard._groups(iter([]))) == []


def test_one_row_of_each_component_stays(spark, corpus, documents):
    extra = documents.withColumn("n", F.lit(1)).withColumn("sig", F.lit("clash")).withColumn("keep", F.lit(None).cast("string"))
    again = extra.unionByName(extra.filter("doc_id = 3"))
    left = jaccard.without_near_copies(spark, again, 4, 85)
    assert left.columns == again.columns
    assert sorted(r[0] for r in left.select("doc_id").collect()) == sorted({c for _, _, c in brute.components([r[:2] for r in corpus])})


def test_a_sketch_never_differs_in_more_bits_than_the_sets(corpus):
    import numpy as np

    sets = [jaccard.shingles((r[1] or "").encode(), 4) for r in corpus[:120]]
    marks = [np.frombuffer(jaccard.sketch(s), dtype=np.uint64) for s in sets]
    for a in range(0, 120, 3):
        for b in range(a):
            differ = len(np.setxor1d(sets[a], sets[b]))
            assert np.bitwise_count(marks[a] ^ marks[b]).sum() <= differ


def test_sets_that_link_share_a_list(corpus):
    import numpy as np

    levels = jaccard.Levels(85)
    pick = np.random.default_rng(3)
    for n in (7, 8, 11, 30, 147, 600, 2000):
        for _ in range(30):
            x = np.unique(pick.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            gone = pick.integers(0, max(1, int(0.15 * n)) + 1)
            new = pick.integers(0, max(1, int(0.08 * n)) + 1)
            y = np.unique(np.concatenate([pick.permutation(x)[gone:], pick.integers(0, 2**63, new).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both) and len(np.setxor1d(x, y)):
                assert np.intersect1d(levels.keys(x), levels.keys(y)).size


def test_components_of_paths_stars_and_nothing(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(300, 299), (7, 7)]
    got = components.components(spark, spark.createDataFrame(links, "a long, b long"))
    want = [(k, 0) for k in range(31)] + [(k, 100) for k in range(100, 160)] + [(299, 299), (300, 299)]
    assert rows(got, "node", "root") == sorted(want, key=repr)
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
    up = jaccard.trees(spark, spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"))
    assert rows(up, "node", "root") == sorted([(k, 0) for k in range(1, 21)], key=repr)


def test_repeated_windows_are_removed(spark, corpus, documents):
    got = substrings.repeated(spark, documents)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated([r[:2] for r in corpus]), key=repr)


@pytest.mark.parametrize("window,seed", [(3, 8), (10, 4)])
def test_windows_of_other_lengths(spark, corpus, documents, window, seed):
    got = substrings.repeated(spark, documents, window, seed)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated([r[:2] for r in corpus], window), key=repr)


def test_known_passages_are_cut_by_automata(spark):
    known = " ".join(f"k{k}" for k in range(50))
    docs = spark.createDataFrame([(1, f"a b {known} c", "x"), (2, known, "y"), (3, "a b c", None), (4, None, "z")], "doc_id long, text string, lang string")
    reference = spark.createDataFrame([(f"start {known}",), (None,), ("short",)], "text string")
    got = substrings.remove_known(spark, docs, reference, window=35, shard_words=10)
    assert rows(got, "doc_id", "text", "lang") == [(1, "a b c", "x"), (2, "", "y"), (3, "a b c", None), (4, None, "z")]
    clash = docs.withColumnRenamed("lang", "rid").withColumn("row", F.lit(1)).withColumn("spans", F.lit("s"))
    again = substrings.remove_known(spark, clash, reference, window=35, shard_words=30)
    assert again.columns == clash.columns and rows(again, "doc_id", "text", "rid") == rows(got, "doc_id", "text", "lang")
    assert substrings.remove_known(spark, docs, reference.limit(0)).count() == 4


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert jaccard.near_classes(spark, none).count() == 0
    assert substrings.repeated(spark, none).count() == 0
    assert exact_dedup.deduplicated(spark, none).count() == 0


def exact(corpus):
    import re

    norm = {k: re.sub("[\x20\x09-\x0d]+", " ", t or "") for k, t, *_ in corpus}
    groups = {}
    for k, t in norm.items():
        groups.setdefault(t, []).append(k)
    return [(k, min(groups[t]), len(groups[t]), k == min(groups[t]), brute.sha(t)) for k, t in norm.items()]


@pytest.mark.parametrize("deliveries", [1, 3])
def test_exact_copies_keep_the_least_id(spark, corpus, documents, deliveries):
    index = exact_dedup.DigestIndex(spark, f"index_a{deliveries}", buckets=4)
    got = index.deduplicate(documents, deliveries=deliveries).withColumn("sha", F.lower(F.hex("digest")))
    index.drop()
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "sha") == sorted(exact(corpus), key=repr)


def test_a_later_batch_meets_the_index(spark):
    one = spark.createDataFrame([(5, "a b"), (7, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a\tb"), (2, "d"), (3, "d"), (7, "c")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, "index_b", buckets=4)
    assert index.deduplicate(one).filter("kept").count() == 2
    assert rows(index.deduplicate(two), "doc_id", "keep_id", "kept") == [(1, 5, False), (2, 2, True), (3, 2, False), (7, 7, False)]
    assert index.table().count() == 3
    folder = spark.sql("DESCRIBE FORMATTED index_b").filter("col_name = 'Location'").first()["data_type"]
    again = exact_dedup.DigestIndex(spark, "index_c", buckets=4, path=folder)
    assert again.deduplicate(two).filter("kept").count() == 0


def test_equal_rows_leave_one(spark):
    docs = [(1, "a", "x", 1), (1, "a", "w", 2), (1, "a ", "w", 2), (None, "a", "q", 0), (None, "z", "q", 0), (None, "z", "q", 0), (2, None, None, None), (3, "", "e", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, digest string, rid int")
    left = exact_dedup.deduplicated(spark, frame)
    assert left.columns == frame.columns
    assert rows(left, "doc_id", "text", "digest") == sorted([(1, "a", "w"), (1, "a ", "w"), (None, "z", "q"), (2, None, None)], key=repr)


def test_rows_with_maps_and_clashing_columns(spark):
    schema = "doc_id long, text string, key string, keep string, hash string, bucket string, rows_of_key string, m map<string,int>"
    docs = [(k % 5 if k % 7 else None, f"t{k % 3}", "a", "b", "c", "d", "e", {"x": k % 2}) for k in range(60)]
    frame = spark.createDataFrame(docs, schema)
    left = exact_dedup.deduplicated(spark, frame)
    assert left.columns == frame.columns and left.dtypes == frame.dtypes
    assert rows(left, "doc_id", "text", "keep") == [(0, f"t{k}", "b") for k in range(3)]
    plain = frame.select("doc_id", "text").distinct()
    assert exact_dedup.deduplicated(spark, plain).count() == 3
