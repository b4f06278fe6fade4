"""Tables whose own columns are called like what the operators add."""

from factree.llm import decontaminate, disclosure, jaccard, mixing, quality
from pyspark.sql import functions as F

NAMES = ["score", "_score", "row", "ROW", "rid", "taken", "hit", "n_words", "spans", "n_spans", "bucket", "key", "keep", "digest", "sig", "__row", "__score"]


def table(spark):
    names = [n for n in NAMES if n != "ROW"]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(k if k else None, t, f"s{k % 2}", *[f"{n}{k}" for n in names]) for k, t in enumerate([None, "", f"x y {item} z v w q r s t u o p", "mail a@b.cd now", "plain words", "plain words"])]
    return spark.createDataFrame(docs, ", ".join(["doc_id long, text string, source string", *[f"`{n}` string" for n in names]])), names, item


def same(got, docs, names):
    want = {r["doc_id"]: tuple(r[n] for n in names) for r in docs.collect()}
    assert got.columns[: len(docs.columns)] == docs.columns and got.dtypes[: len(docs.columns)] == docs.dtypes
    found = got.collect()
    assert found and all(tuple(r[n] for n in names) == want[r["doc_id"]] for r in found)
    return found


def test_scores_come_last(spark):
    docs, names, _ = table(spark)
    got = quality.scored(spark, docs, quality.fit(*[__import__("numpy").zeros(x) for x in ((0, quality.WIDTH), 0)]))
    assert got.columns[-1] == "__" + "_score"
    assert len(same(got, docs, names)) == 6


def test_cleaned_sanitised_mixed_and_deduplicated_hand_columns_on(spark):
    docs, names, item = table(spark)
    found = same(decontaminate.cleaned(spark, docs, spark.createDataFrame([("i", item)], "item_id string, text string")), docs, names)
    assert {r["doc_id"]: r["text"] for r in found}[2] == "x y  z v w q r s t u o p"
    many = decontaminate.cleaned(spark, docs, spark.createDataFrame([("i", item), ("j", "no such words")], "item_id string, text string"), shard_words=3)
    assert {r["doc_id"]: r["text"] for r in same(many, docs, names)}[2] == "x y  z v w q r s t u o p"
    assert len(same(mixing.mixed(spark, docs), docs, names)) >= 3
    assert len(same(jaccard.without_near_copies(spark, docs, 2, 80), docs, names)) == 5
    got = disclosure.sanitised(spark, docs)
    rest = got.select("doc_id", *names, "text").collect()
    assert {r["doc_id"]: r["text"] for r in rest}[3] == "mail [email] now" and got.columns[-1] == "_n_spans"
    assert all(tuple(r[n] for n in names) == tuple(f"{n}{r['doc_id'] or 0}" for n in names) for r in rest)
    assert got.filter(F.col("text").isNull()).count() == 1
