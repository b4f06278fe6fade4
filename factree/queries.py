"""One query per operator over the star of lineitem, with the same result as SQL over the explicit join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import Attribute, Expression, Op, Predicate, Test
from .operators import splits
from .operators import tables as tables_of
from .operators.messages import Kind, MessageTree
from .operators.semiring import Average, Variance
from .operators.trees import Grower, leaves
from .plans.graph import CAT, LCAT, NUM, JoinGraph, edge_profile, walk_order
from .plans.models import DecisionTree, DummyModel, GradientBoosting, RandomForest
from .plans.query import Query, run
from .plans.rename import without_reserved
from .sources.catalog import Catalog, set_operation
from .streaming.scoring import score, score_facts

CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
NUMERIC = {
    "lineitem": ["l_quantity", "l_discount", "l_tax"], "part": ["p_size", "p_retailprice"], "supplier": ["s_acctbal"], "orders": ["o_totalprice"], "customer": ["c_acctbal"],
}
CATEGORIES = {"lineitem": ["l_returnflag"], "part": ["p_brand"], "orders": ["o_orderpriority"], "customer": ["c_mktsegment"], "region": ["r_name"]}
JOINS = [
    ("lineitem", "orders", "l_orderkey", "o_orderkey"), ("lineitem", "part", "l_partkey", "p_partkey"), ("lineitem", "supplier", "l_suppkey", "s_suppkey"),
    ("orders", "customer", "o_custkey", "c_custkey"), ("customer", "nation", "c_nationkey", "n_nationkey"), ("nation", "region", "n_regionkey", "r_regionkey"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

J = """j AS (SELECT l.*, p_size, p_brand, p_retailprice, s_acctbal, o_orderpriority, o_totalprice, o_custkey, c_mktsegment, c_acctbal, n_name, r_name,
        CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS s, 1 AS c
      FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def query(sql: str | None):
    """Registers a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    out = Catalog(spark)
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        out.register(t, f"{sf_dir}/{t}.parquet")
    return out


def star(spark: SparkSession, sf_dir: str, X: dict = NUMERIC, categorical: dict | None = None, one_vs_rest: dict | None = None, y: str = "l_extendedprice") -> JoinGraph:
    """The graph of JOINS; joins are profiled when a model is trained or messages are calibrated, all in one job."""
    graph = JoinGraph.of(catalog(spark, sf_dir))
    relations = ["lineitem", "orders", "part", "supplier", "customer", "nation", "region"]
    for r in relations:
        graph.add_relation(r, X.get(r, []), y if r == "lineitem" else None, (categorical or {}).get(r, []), (one_vs_rest or {}).get(r, []))
    for a, b, k, m in JOINS:
        graph.add_join(a, b, [k], [m], profile=False)
    return graph


def calibrated(spark: SparkSession, sf_dir: str, predicates: dict | None = None, semi_join: bool = False) -> MessageTree:
    tree = MessageTree(star(spark, sf_dir, NUMERIC, CATEGORIES), semi_join=semi_join)
    tree.lift(F.expr(CENTS))
    for relation, found in (predicates or {}).items():
        tree.add_predicates(relation, found)
    tree.calibrate()
    return tree


def as_long(df: DataFrame) -> DataFrame:
    return df.withColumns({"s": F.col("s").cast("long"), "c": F.col("c").cast("long")})


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# lifting and messages


@query("SELECT CAST(SUM(ROUND(l_extendedprice * 100)) AS BIGINT) AS s, COUNT(*) AS c FROM lineitem")
def root_semiring(spark, sf_dir):
    return as_long(MessageTree(star(spark, sf_dir)).lift(F.expr(CENTS)).agg(*Variance.sums()))


@query("SELECT ROUND(AVG(l_extendedprice), 4) AS mean, COUNT(*) AS n FROM lineitem")
def dummy_mean(spark, sf_dir):
    model = DummyModel().fit(star(spark, sf_dir))
    return one_row(spark, mean=round(model.constant, 4), n=model.count)


@query("SELECT l_orderkey, l_partkey, ROUND(l_extendedprice - (SELECT AVG(l_extendedprice) FROM lineitem), 4) AS s, 1 AS c FROM lineitem")
def lift_fact(spark, sf_dir):
    graph = star(spark, sf_dir)
    mean = DummyModel().fit(graph).constant
    return MessageTree(graph).lift(F.col("l_extendedprice") - F.lit(mean)).select("l_orderkey", "l_partkey", F.round("s", 4).alias("s"), F.col("c").cast("int").alias("c"))


@query(f"WITH {J} SELECT l_partkey AS k0, CAST(SUM(s) AS BIGINT) AS s, COUNT(*) AS c FROM j GROUP BY 1")
def msg_full_fact_to_part(spark, sf_dir):
    return as_long(calibrated(spark, sf_dir).messages["lineitem", "part"].rows)


@query(f"WITH {J} SELECT o_custkey AS k0, CAST(SUM(s) AS BIGINT) AS s, COUNT(*) AS c FROM j GROUP BY 1")
def msg_full_two_hops(spark, sf_dir):
    return as_long(calibrated(spark, sf_dir).messages["orders", "customer"].rows)


@query("SELECT DISTINCT p_partkey AS k0 FROM part WHERE p_size <= 24")
def msg_selection(spark, sf_dir):
    return calibrated(spark, sf_dir, {"part": ["p_size <= 24"]}).messages["part", "lineitem"].rows


@query("SELECT * FROM (VALUES ('customer', 'orders', 'SELECTION'), ('nation', 'customer', 'SELECTION'), ('orders', 'lineitem', 'SELECTION'), ('part', 'lineitem', 'IDENTITY'), ('region', 'nation', 'SELECTION'), ('supplier', 'lineitem', 'IDENTITY')) t(sender, receiver, kind)")
def msg_kinds_to_the_root(spark, sf_dir):
    tree = calibrated(spark, sf_dir, {"region": ["r_name <> 'ASIA'"]})
    inward = [(b, a, tree.messages[b, a].kind.name) for a, b in tree.graph.outward()]
    return spark.createDataFrame(inward, "sender string, receiver string, kind string")


@query(f"WITH {J} SELECT l_suppkey AS k0, CAST(SUM(s) AS BIGINT) AS s, COUNT(*) AS c FROM j WHERE s_acctbal > 5000 AND p_size <= 24 GROUP BY 1")
def msg_semi_join_reduction(spark, sf_dir):
    return as_long(calibrated(spark, sf_dir, {"supplier": ["s_acctbal > 5000"], "part": ["p_size <= 24"]}, semi_join=True).messages["lineitem", "supplier"].rows)


def absorbed(name, relation, column, predicates=None, where=""):
    def f(spark, sf_dir):
        return as_long(calibrated(spark, sf_dir, predicates).absorb(relation, [column]))

    f.__name__ = name
    query(f"WITH {J} SELECT {column}, CAST(SUM(s) AS BIGINT) AS s, COUNT(*) AS c FROM j {where} GROUP BY 1")(f)


absorbed("absorb_part_size", "part", "p_size")
absorbed("absorb_customer_segment", "customer", "c_mktsegment")
absorbed("absorb_region", "region", "r_name")
absorbed("absorb_fact_flag", "lineitem", "l_returnflag")
absorbed(
    "absorb_with_annotations", "customer", "c_mktsegment",
    {"lineitem": ["l_quantity <= 25"], "part": [Predicate(Test.GREATER, "p_size", 24)], "customer": ["c_acctbal <= 5000"]},
    "WHERE l_quantity <= 25 AND p_size > 24 AND c_acctbal <= 5000",
)


@query(f"WITH {J} SELECT CAST(SUM(s) AS BIGINT) AS s, COUNT(*) AS c FROM j WHERE r_name = 'ASIA'")
def absorb_total(spark, sf_dir):
    return as_long(calibrated(spark, sf_dir, {"region": ["r_name = 'ASIA'"]}).absorb("part"))


@query("""SELECT l_quantity <= 25 AS a, p_size <= 24 AS b, c_acctbal <= 5000 AS d, CAST(SUM(ROUND(l_extendedprice * 100)) AS BIGINT) AS s, COUNT(*) AS c
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def split_fact_then_dimensions(spark, sf_dir):
    root, out = calibrated(spark, sf_dir), None
    for a in (True, False):
        for b in (True, False):
            for d in (True, False):
                node = root.copy()
                node.add_predicates("lineitem", [F.col("l_quantity") <= 25 if a else F.col("l_quantity") > 25])
                node.send_down("lineitem")
                node.add_predicates("part", [F.col("p_size") <= 24 if b else F.col("p_size") > 24])
                node.send("part", "lineitem", Kind.SELECTION)
                node.send_down("lineitem")
                node.add_predicates("customer", [F.col("c_acctbal") <= 5000 if d else F.col("c_acctbal") > 5000])
                part = as_long(node.absorb("customer")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d).alias("d"), "s", "c")
                out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def partition_semi_join(spark, sf_dir):
    part = calibrated(spark, sf_dir, {"customer": ["c_mktsegment = 'BUILDING'"]}).partition_target("customer")
    return part.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT ROUND(AVG(o_totalprice), 4) AS avg, COUNT(*) AS c FROM orders JOIN events ON o_custkey = user_id")
def avg_semiring_many_to_many(spark, sf_dir):
    tables = catalog(spark, sf_dir)
    ring = Average(("o", "o_totalprice"), ("k",))
    total = ring.sum_over_product({"o": tables.table("orders").withColumnRenamed("o_custkey", "k"), "e": tables.table("events").withColumnRenamed("user_id", "k")})
    return total.select(F.round(F.col("s") / F.col("c"), 4).alias("avg"), F.col("c").cast("long").alias("c"))


@query("""SELECT CAST(SUM(a * b) AS BIGINT) AS pairs, CAST(SUM(a * b + a) AS BIGINT) AS more FROM
    (SELECT o_custkey AS k, COUNT(*) AS a FROM orders GROUP BY 1) x JOIN (SELECT user_id AS k, COUNT(*) AS b FROM events GROUP BY 1) y ON x.k = y.k""")
def sum_of_products(spark, sf_dir):
    tables = catalog(spark, sf_dir)
    x = tables.table("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a"))
    y = tables.table("events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("b"))
    columns = {"pairs": Expression(Op.SUM_PROD, {"x": "a", "y": "b"}), "more": Expression(Op.DISTRIBUTED_SUM_PROD, [["x.a", "y.b"], ["x.a"]])}
    return Query(columns, {"x": x, "y": y}, [(Attribute("x", "k"), Attribute("y", "k"))]).compile(tables)


# join graph


def profiled(name, left, right, left_keys, right_keys):
    lk, rk = ", ".join(left_keys), ", ".join(right_keys)
    on = " AND ".join(f"l.{a} IS NOT DISTINCT FROM r.{b}" for a, b in zip(left_keys, right_keys, strict=True))

    def f(spark, sf_dir):
        tables = catalog(spark, sf_dir)
        return edge_profile(tables.table(left), tables.table(right), left_keys, right_keys)

    f.__name__ = name
    query(f"""WITH l AS (SELECT {lk}, COUNT(*) AS n FROM {left} GROUP BY ALL), r AS (SELECT {rk}, COUNT(*) AS n FROM {right} GROUP BY ALL)
        SELECT (SELECT MAX(n) FROM l) AS left_multiplicity, (SELECT MAX(n) FROM r) AS right_multiplicity,
               (SELECT COUNT(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE {on})) AS left_missing, (SELECT COUNT(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE {on})) AS right_missing""")(f)


profiled("edge_profile_orders", "lineitem", "orders", ["l_orderkey"], ["o_orderkey"])
profiled("edge_profile_events", "events", "customer", ["user_id"], ["c_custkey"])
profiled("edge_profile_composite", "customer", "supplier", ["c_nationkey", "c_custkey"], ["s_nationkey", "s_suppkey"])


@query(f"WITH {J} SELECT r_name, l_returnflag, COUNT(*) AS n, CAST(SUM(s) AS BIGINT) AS s, ROUND(SUM(c_acctbal), 2) AS a FROM j GROUP BY ALL")
def full_join_path(spark, sf_dir):
    rows = star(spark, sf_dir, NUMERIC, CATEGORIES).full_join()
    return rows.groupBy("r_name", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.expr(CENTS)).alias("s"), F.round(F.sum("c_acctbal"), 2).alias("a"))


@query("SELECT * FROM (VALUES (0, 'region'), (1, 'nation'), (2, 'customer'), (3, 'orders'), (4, 'lineitem'), (5, 'part'), (6, 'supplier')) t(place, relation)")
def walk_of_joins(spark, sf_dir):
    graph = star(spark, sf_dir)
    nodes, _ = walk_order({r: graph.edges[r] for r in ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")})
    return spark.createDataFrame(list(enumerate(nodes)), "place int, relation string")


# splits

NUM_SQL = f"""WITH {J}, a AS (SELECT {{f}} AS v, CAST(SUM(s) AS BIGINT) AS s, COUNT(*) AS c FROM j GROUP BY 1),
    p AS (SELECT v, CAST(SUM(s) OVER w AS BIGINT) AS ps, CAST(SUM(c) OVER w AS BIGINT) AS pc, CAST(SUM(s) OVER () AS BIGINT) AS g, CAST(SUM(c) OVER () AS BIGINT) AS h
          FROM a WINDOW w AS (ORDER BY v NULLS LAST)),
    q AS (SELECT *, CASE WHEN pc > 0 AND pc < h THEN (CAST(ps AS DOUBLE) * h - CAST(pc AS DOUBLE) * g) * (CAST(ps AS DOUBLE) * h - CAST(pc AS DOUBLE) * g)
        / (CAST(pc AS DOUBLE) * (CAST(h AS DOUBLE) - pc) * h) ELSE 0 END AS gain FROM p)"""
LCAT_SQL = NUM_SQL.replace("p AS (SELECT v,", "o AS (SELECT *, CAST(s AS DOUBLE) / c AS mean FROM a), p AS (SELECT v, mean,").replace("FROM a WINDOW w AS (ORDER BY v NULLS LAST)", "FROM o WINDOW w AS (ORDER BY mean)")


def statistics(spark, sf_dir, relation, feature, kind):
    found = as_long(calibrated(spark, sf_dir).absorb(relation, [feature])).withColumn("node", F.lit(0))
    return splits.long_form(found, [(0, feature, kind)])


@query(NUM_SQL.format(f="l_discount") + " SELECT v, ps, pc, g, h FROM q")
def prefix_sums_num(spark, sf_dir):
    return splits.curve(statistics(spark, sf_dir, "lineitem", "l_discount", NUM)).select(F.col("num").alias("v"), "ps", "pc", "g", "h")


@query(LCAT_SQL.format(f="p_brand") + " SELECT v, ps, pc, g, h FROM q")
def prefix_sums_lcat(spark, sf_dir):
    return splits.curve(statistics(spark, sf_dir, "part", "p_brand", LCAT)).select(F.col("txt").alias("v"), "ps", "pc", "g", "h")


@query(NUM_SQL.format(f="CAST(p_size AS DOUBLE)") + " SELECT v, CAST(ROUND(gain / 1e6) AS BIGINT) AS gain FROM q")
def gain_curve(spark, sf_dir):
    return splits.curve(statistics(spark, sf_dir, "part", "p_size", NUM)).select(F.col("num").alias("v"), F.round(F.col("gain") / 1e6).cast("long").alias("gain"))


@query(NUM_SQL.format(f="l_quantity") + """ SELECT v, CASE WHEN pc < h THEN CAST(ROUND((CAST(ps AS DOUBLE) / pc * ps + CAST(g - ps AS DOUBLE) / (h - pc) * (g - ps)) / 1e9) AS BIGINT) ELSE 0 END AS criterion FROM p""")
def criterion_curve(spark, sf_dir):
    rows = splits.curve(statistics(spark, sf_dir, "lineitem", "l_quantity", NUM))
    return rows.select(F.col("num").alias("v"), F.round(splits.criterion(*map(F.col, ("ps", "pc", "g", "h"))) / 1e9).cast("long").alias("criterion"))


def best_of(name, relation, feature, kind, sql):
    def f(spark, sf_dir):
        top = splits.best(statistics(spark, sf_dir, relation, feature, kind))
        value = F.array_join(F.array_sort("members"), ",") if kind == LCAT else F.coalesce(F.col("num").cast("string"), "txt") if kind == CAT else F.col("num")
        return top.select(value.alias("v"), "ps", "pc", F.round(F.col("gain") / 1e6).cast("long").alias("gain"))

    f.__name__ = name
    query(sql)(f)


BEST = " SELECT v, ps, pc, CAST(ROUND(gain / 1e6) AS BIGINT) AS gain FROM q ORDER BY q.gain DESC, v LIMIT 1"
BEST_SET = """, b AS (SELECT * FROM q ORDER BY gain DESC, mean LIMIT 1)
    SELECT (SELECT string_agg(v, ',' ORDER BY v) FROM q WHERE q.mean <= b.mean) AS v, ps, pc, CAST(ROUND(gain / 1e6) AS BIGINT) AS gain FROM b"""
for _relation, _feature in [("lineitem", "l_quantity"), ("lineitem", "l_discount"), ("part", "p_size"), ("orders", "o_totalprice"), ("customer", "c_acctbal")]:
    best_of(f"best_split_{_feature}", _relation, _feature, NUM, NUM_SQL.format(f=f"CAST({_feature} AS DOUBLE)") + BEST)
for _relation, _feature in [("part", "p_brand"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("region", "r_name")]:
    best_of(f"best_split_{_feature}", _relation, _feature, LCAT, LCAT_SQL.format(f=_feature) + BEST_SET)
best_of(
    "best_split_one_vs_rest", "customer", "c_mktsegment", CAT,
    NUM_SQL.format(f="c_mktsegment").replace("SUM(s) OVER w", "s").replace("SUM(c) OVER w", "c").replace(" WINDOW w AS (ORDER BY v NULLS LAST)", "") + BEST,
)


@query(NUM_SQL.format(f="NULLIF(l_quantity, 50)") + BEST)
def best_split_with_nulls(spark, sf_dir):
    tree = calibrated(spark, sf_dir)
    found = as_long(tree.absorb("lineitem", ["l_quantity"])).select(F.expr("nullif(l_quantity, 50)").alias("q"), "s", "c", F.lit(0).alias("node"))
    return splits.best(splits.long_form(found, [(0, "q", NUM)])).select(F.col("num").alias("v"), "ps", "pc", F.round(F.col("gain") / 1e6).cast("long").alias("gain"))


@query(NUM_SQL.format(f="CASE WHEN l_quantity > 40 THEN NULL ELSE 1.0 END") + " SELECT ps, pc, CAST(ROUND(gain / 1e6) AS BIGINT) AS gain FROM q WHERE v IS NOT NULL")
def null_split(spark, sf_dir):
    found = as_long(calibrated(spark, sf_dir).absorb("lineitem", ["l_quantity"])).select(F.expr("if(l_quantity > 40, NULL, 1.0D)").alias("q"), "s", "c", F.lit(0).alias("node"))
    return splits.best(splits.long_form(found, [(0, "q", NUM)])).select("ps", "pc", F.round(F.col("gain") / 1e6).cast("long").alias("gain"))


@query(
    f"WITH {J}, l AS ({' UNION ALL '.join(f'SELECT {k} AS fid, CAST({f} AS DOUBLE) AS v, s FROM j' for k, f in enumerate(['l_quantity', 'l_discount', 'l_tax', 'o_totalprice', 'p_size', 'p_retailprice', 's_acctbal', 'c_acctbal']))}), "
    """a AS (SELECT fid, v, SUM(s) AS s, COUNT(*) AS c FROM l GROUP BY ALL),
    p AS (SELECT fid, v, CAST(SUM(s) OVER w AS BIGINT) AS ps, CAST(SUM(c) OVER w AS BIGINT) AS pc, CAST(SUM(s) OVER t AS BIGINT) AS g, CAST(SUM(c) OVER t AS BIGINT) AS h
          FROM a WINDOW w AS (PARTITION BY fid ORDER BY v NULLS LAST), t AS (PARTITION BY fid)),
    q AS (SELECT *, CASE WHEN pc < h THEN (CAST(ps AS DOUBLE) * h - CAST(pc AS DOUBLE) * g) * (CAST(ps AS DOUBLE) * h - CAST(pc AS DOUBLE) * g) / (CAST(pc AS DOUBLE) * (CAST(h AS DOUBLE) - pc) * h) ELSE 0 END AS gain FROM p)
    SELECT fid, v, ps, pc, CAST(ROUND(gain / 1e6) AS BIGINT) AS gain FROM q QUALIFY ROW_NUMBER() OVER (PARTITION BY fid ORDER BY q.gain DESC, v) = 1"""
)
def best_split_all_features(spark, sf_dir):
    """The best cut of every feature of every relation, from one job."""
    tree = MessageTree(star(spark, sf_dir))
    fact = tree.lift(F.expr(CENTS)).withColumn("node", F.lit(0))
    rows = splits.best(Grower(tree.graph, fact).statistics())
    return rows.select("fid", F.col("num").alias("v"), F.col("ps").cast("long").alias("ps"), F.col("pc").cast("long").alias("pc"), F.round(F.col("gain") / 1e6).cast("long").alias("gain"))


# models

ORDER = ["l_quantity", "l_discount", "l_tax", "o_totalprice", "p_size", "p_retailprice", "s_acctbal", "c_acctbal"]


def tree_sql(depth: int, start: str, name: str) -> str:
    """CTEs that grow a tree of that depth on the rows (s, node, f0...) of start; the last is {name}{depth}, with each row's leaf in node."""
    ctes, last = [], start
    features = range(len(ORDER))
    for k in range(depth):
        cells = " UNION ALL ".join(f"SELECT node, {f} AS f, f{f} AS v, s FROM {last}" for f in features)
        ctes.append(f"{name}a{k} AS (SELECT node, f, v, SUM(s) AS s, COUNT(*) AS c FROM ({cells}) GROUP BY ALL)")
        ctes.append(
            f"{name}p{k} AS (SELECT node, f, v, SUM(s) OVER w AS ps, CAST(SUM(c) OVER w AS DOUBLE) AS pc, SUM(s) OVER t AS g, CAST(SUM(c) OVER t AS DOUBLE) AS h FROM {name}a{k} "
            "WINDOW w AS (PARTITION BY node, f ORDER BY v NULLS LAST), t AS (PARTITION BY node, f))"
        )
        ctes.append(
            f"{name}b{k} AS (SELECT node, f, v FROM (SELECT *, CASE WHEN pc < h THEN (ps * h - pc * g) * (ps * h - pc * g) / (pc * (h - pc) * h) ELSE 0 END AS gain FROM {name}p{k}) WHERE gain > 0 "
            "QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1)"
        )
        value = "CASE b.f " + " ".join(f"WHEN {f} THEN f{f}" for f in features) + " END"
        ctes.append(
            f"{name}{k + 1} AS (SELECT x.* REPLACE (CASE WHEN b.node IS NULL THEN x.node WHEN {value} <= b.v THEN x.node * 2 + 1 ELSE x.node * 2 + 2 END AS node) FROM {last} x LEFT JOIN {name}b{k} b ON x.node = b.node)"
        )
        last = f"{name}{k + 1}"
    return ", ".join(ctes)


ROWS = f"WITH {J}, r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_extendedprice - (SELECT AVG(l_extendedprice) FROM lineitem) AS s, 0 AS node, {', '.join(f'CAST({f} AS DOUBLE) AS f{k}' for k, f in enumerate(ORDER))} FROM j)"
PREDICTED = ", t AS (SELECT *, AVG(s) OVER (PARTITION BY node) AS a FROM x2)"


def leaf_table(spark, model):
    rows = [(float(n.total.c), round(n.total.mean * rate, 4)) for root, rate in model.trees for n in leaves(root)]
    return spark.createDataFrame(rows, "n double, value double")


@query(f"{ROWS}, {tree_sql(2, 'r', 'x')} SELECT CAST(COUNT(*) AS DOUBLE) AS n, ROUND(AVG(s), 4) AS value FROM x2 GROUP BY node")
def tree_leaves(spark, sf_dir):
    return leaf_table(spark, DecisionTree(max_depth=2).fit(star(spark, sf_dir)))


@query(f"{ROWS}, {tree_sql(2, 'r', 'x')} SELECT CAST(COUNT(*) AS DOUBLE) AS n, ROUND(AVG(s), 4) AS value FROM x2 GROUP BY node")
def tree_leaves_levelwise(spark, sf_dir):
    return leaf_table(spark, DecisionTree(max_depth=2, growth="levelwise").fit(star(spark, sf_dir)))


@query(f"{ROWS}, {tree_sql(1, 'r', 'x')} SELECT CAST(COUNT(*) AS DOUBLE) AS n, ROUND(AVG(s), 4) AS value FROM x1 GROUP BY node")
def stump_leaves_depthwise(spark, sf_dir):
    return leaf_table(spark, DecisionTree(num_leaves=2, max_depth=3, growth="depthwise").fit(star(spark, sf_dir)))


@query(f"{ROWS}, {tree_sql(2, 'r', 'x')}{PREDICTED} SELECT ROUND(a + (SELECT AVG(l_extendedprice) FROM lineitem), 3) AS prediction, COUNT(*) AS n FROM t GROUP BY 1")
def tree_predictions(spark, sf_dir):
    graph = star(spark, sf_dir)
    rows = DecisionTree(max_depth=2).fit(graph).predict(graph)
    return rows.groupBy(F.round("prediction", 3).alias("prediction")).agg(F.count("*").alias("n"))


@query(f"{ROWS}, {tree_sql(2, 'r', 'x')}{PREDICTED} SELECT ROUND(SQRT(AVG(POW(s - a, 2))), 4) AS rmse FROM t")
def tree_rmse(spark, sf_dir):
    graph = star(spark, sf_dir)
    return DecisionTree(max_depth=2).fit(graph).rmse(graph.full_join()).select(F.round("rmse", 4).alias("rmse"))


SECOND = f"{ROWS}, {tree_sql(2, 'r', 'x')}{PREDICTED}, r2 AS (SELECT * EXCLUDE (a) REPLACE (s - a AS s, 0 AS node) FROM t), {tree_sql(2, 'r2', 'z')}"


@query(f"{ROWS}, {tree_sql(2, 'r', 'x')}{PREDICTED} SELECT ROUND(SUM((s - a) * (s - a)) / 1e6, 2) AS squares, COUNT(*) AS n FROM t")
def residuals_after_a_tree(spark, sf_dir):
    model = GradientBoosting(max_depth=2, n_estimators=1)
    graph = star(spark, sf_dir)
    lifted = model._lift(graph, 1, 0)
    rows = model.residuals(model._train(lifted, 1).fact, *model.trees[-1])
    return rows.agg(F.round(F.sum(F.col("s") * F.col("s")) / 1e6, 2).alias("squares"), F.count("*").alias("n"))


@query(f"{SECOND}, u AS (SELECT s - AVG(s) OVER (PARTITION BY node) AS e FROM z2) SELECT ROUND(SQRT(AVG(e * e)), 3) AS rmse FROM u")
def boosting_rmse_of_two_trees(spark, sf_dir):
    graph = star(spark, sf_dir)
    return GradientBoosting(max_depth=2, n_estimators=2).fit(graph).rmse(graph.full_join()).select(F.round("rmse", 3).alias("rmse"))


@query(f"{ROWS}, {tree_sql(2, 'r', 'x')}{PREDICTED} SELECT ROUND(SQRT(AVG(POW(s - a, 2))), 3) AS rmse FROM t")
def forest_of_whole_samples(spark, sf_dir):
    graph = star(spark, sf_dir)
    return RandomForest(max_depth=2, n_estimators=2).fit(graph).rmse(graph.full_join()).select(F.round("rmse", 3).alias("rmse"))


@query(None)
def forest_of_samples(spark, sf_dir):
    graph = star(spark, sf_dir)
    return RandomForest(max_depth=2, n_estimators=2, subsample=0.5).fit(graph).rmse(graph.full_join())


@query(
    f"""WITH {J}, a AS (SELECT c_mktsegment AS v, SUM(s) AS s, COUNT(*) AS c FROM j GROUP BY 1), p AS (SELECT v, s, c, CAST(SUM(s) OVER w AS DOUBLE) AS ps, CAST(SUM(c) OVER w AS DOUBLE) AS pc,
        CAST(SUM(s) OVER () AS DOUBLE) AS g, CAST(SUM(c) OVER () AS DOUBLE) AS h, CAST(s AS DOUBLE) / c AS mean FROM a WINDOW w AS (ORDER BY CAST(s AS DOUBLE) / c)),
    b AS (SELECT * FROM p WHERE pc < h ORDER BY (ps * h - pc * g) * (ps * h - pc * g) / (pc * (h - pc) * h) DESC, mean LIMIT 1)
    SELECT CAST(SUM(p.c) AS DOUBLE) AS n, ROUND(SUM(p.s) / SUM(p.c) / 100 - MAX(p.g / p.h) / 100, 3) AS value FROM p, b GROUP BY p.mean <= b.mean"""
)
def tree_on_categories(spark, sf_dir):
    graph = star(spark, sf_dir, {}, {"customer": ["c_mktsegment"]})
    rows = leaf_table(spark, DecisionTree(num_leaves=2, max_depth=1).fit(graph))
    return rows.select("n", F.round("value", 3).alias("value"))


@query(f"{ROWS}, {tree_sql(2, 'r', 'x')} SELECT CAST(COUNT(*) AS DOUBLE) AS n, ROUND(AVG(s), 4) AS value FROM x2 GROUP BY node")
def tree_with_reserved_names(spark, sf_dir):
    graph = star(spark, sf_dir)
    tables = graph.catalog.tables
    tables["lineitem"] = tables["lineitem"].withColumnRenamed("l_quantity", "s").withColumnRenamed("l_extendedprice", "c").withColumnRenamed("l_linenumber", "node")
    graph.replace_attribute("lineitem", "l_quantity", "s")
    graph.replace_attribute("lineitem", "l_extendedprice", "c")
    return leaf_table(spark, DecisionTree(max_depth=2).fit(graph))


@query("SELECT * FROM (VALUES ('customer', 's', 'reserved_s'), ('customer', 'rowid', 'reserved_rowid')) t(relation, old, new)")
def reserved_renames(spark, sf_dir):
    graph = JoinGraph.of(spark)
    table = catalog(spark, sf_dir).table("customer")
    graph.add_relation("customer", ["s", "rowid"], source=table.withColumnRenamed("c_acctbal", "s").withColumnRenamed("c_custkey", "rowid"))
    return spark.createDataFrame([(r, old, new) for (r, new), old in without_reserved(graph)[1].items()], "relation string, old string, new string")


FIXED = "(CASE WHEN l_quantity <= 25 AND l_discount <= 0.05 THEN CAST(10.5 AS DOUBLE) WHEN l_quantity > 25 THEN CAST(-3.25 AS DOUBLE) ELSE 0 END)"


@query(f"SELECT l_orderkey, l_linenumber, ROUND(100 + {FIXED}, 4) AS prediction FROM lineitem")
def case_prediction(spark, sf_dir):
    """A base value and a model of two branches as one projection."""
    branches = [(10.5, [Predicate(Test.NOT_GREATER, "l_quantity", 25), Predicate(Test.NOT_GREATER, "l_discount", 0.05)]), (-3.25, [Predicate(Test.GREATER, "l_quantity", 25)])]
    columns = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "prediction": F.round(F.lit(100.0) + Expression(Op.CASE, branches).column, 4)}
    return Query(columns, ["lineitem"]).compile(catalog(spark, sf_dir))


@query("SELECT l_returnflag, ROUND(SUM(CASE WHEN l_quantity <= 25 AND l_discount > 0.05 THEN l_tax - 1 ELSE l_tax END), 4) AS t FROM lineitem GROUP BY 1")
def update_where(spark, sf_dir):
    tables = catalog(spark, sf_dir)
    name = run(Query({c: c for c in ("l_returnflag", "l_quantity", "l_discount", "l_tax")}, ["lineitem"]), tables, "view")
    tables.update(name, "l_tax", F.col("l_tax") - 1, [F.col("l_quantity") <= 25, F.col("l_discount") > 0.05])
    return tables.table(name).groupBy("l_returnflag").agg(F.round(F.sum("l_tax"), 4).alias("t"))


# queries as data


def from_query(name, make, sql):
    def f(spark, sf_dir):
        return make().compile(catalog(spark, sf_dir))

    f.__name__ = name
    query(sql)(f)


EXPRESSIONS = {
    "sum": (Expression(Op.SUM, "o_custkey"), "CAST(SUM(o_custkey) AS BIGINT)"),
    "max": (Expression(Op.MAX, "o_totalprice"), "MAX(o_totalprice)"),
    "min": (Expression(Op.MIN, "o_totalprice"), "MIN(o_totalprice)"),
    "count": (Expression(Op.COUNT, "*"), "COUNT(*)"),
    "count_columns": (Expression(Op.COUNT, ["o_custkey", "nullif(o_orderstatus, 'F')"]), "COUNT(*) FILTER (o_custkey IS NOT NULL AND NULLIF(o_orderstatus, 'F') IS NOT NULL)"),
    "distinct_count": (Expression(Op.DISTINCT_COUNT, "o_custkey"), "COUNT(DISTINCT o_custkey)"),
    "avg": (Expression(Op.AVG, "o_totalprice"), "AVG(o_totalprice)"),
    "sum_prod": (Expression(Op.SUM_PROD, ["o_custkey", "o_orderkey"]), "CAST(SUM(o_custkey * o_orderkey) AS BIGINT)"),
    "distributed_sum_prod": (Expression(Op.DISTRIBUTED_SUM_PROD, [["o_custkey", "2"], ["o_orderkey"]]), "CAST(SUM(o_custkey * 2 + o_orderkey) AS BIGINT)"),
}


def _aggregate(name, value, sql):
    def f(spark, sf_dir):
        table = catalog(spark, sf_dir).table("orders")
        return table.groupBy("o_orderstatus").agg((F.round(value.column, 4) if value.op is Op.AVG else value.column).alias("x"))

    f.__name__ = f"expr_{name}"
    sql = f"ROUND({sql}, 4)" if value.op is Op.AVG else sql
    query(f"SELECT o_orderstatus, {sql} AS x FROM orders GROUP BY 1")(f)


for _n, (_e, _s) in EXPRESSIONS.items():
    _aggregate(_n, _e, _s)

SCALARS = {
    "prod": (Expression(Op.PROD, ["o_custkey", "o_orderkey"]), "CAST(o_custkey AS DOUBLE) * CAST(o_orderkey AS DOUBLE)"),
    "add": (Expression(Op.ADD, ["o_custkey", "o_orderkey", "7"]), "o_custkey + o_orderkey + 7"),
    "sub": (Expression(Op.SUB, ["o_custkey", "o_orderkey"]), "o_custkey - o_orderkey"),
    "div": (Expression(Op.DIV, ["o_custkey", "o_orderkey % 3"]), "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) / (o_orderkey % 3) END"),
    "identity": (Expression(Op.IDENTITY, "o_custkey"), "o_custkey"),
    "identity_lambda": (Expression(Op.IDENTITY_LAMBDA, "o_custkey * 2 + 1"), "o_custkey * 2 + 1"),
    "sqrt": (Expression(Op.SQRT, "o_custkey"), "SQRT(o_custkey)"),
    "pow": (Expression(Op.POW, ["o_custkey", "2"]), "POW(o_custkey, 2)"),
    "cast": (Expression(Op.CAST, ["o_custkey", "string"]), "CAST(o_custkey AS VARCHAR)"),
    "case": (Expression(Op.CASE, [(1, ["o_custkey > 100", "o_orderkey > 100"]), ("o_custkey", ["o_custkey <= 100"])]), "CASE WHEN o_custkey > 100 AND o_orderkey > 100 THEN 1.0 WHEN o_custkey <= 100 THEN CAST(o_custkey AS DOUBLE) ELSE 0 END"),
    "case_empty": (Expression(Op.CASE, []), "CAST(0 AS DOUBLE)"),
}
for _n, (_e, _s) in SCALARS.items():
    from_query(f"expr_{_n}", lambda e=_e: Query({"o_orderkey": "o_orderkey", "x": e}, ["orders"]), f"SELECT o_orderkey, {_s} AS x FROM orders")

from_query("expr_distinct_identity", lambda: Query({"a": Expression(Op.DISTINCT_IDENTITY, "o_orderstatus"), "b": Expression(Op.DISTINCT_IDENTITY, "o_orderpriority")}, ["orders"]), "SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders")

STATUS = "nullif(o_orderstatus, 'F')"
TESTS = {
    "null": (Predicate(Test.NULL, STATUS), "NULLIF(o_orderstatus, 'F') IS NULL"),
    "not_null": (Predicate(Test.NOT_NULL, STATUS), "NULLIF(o_orderstatus, 'F') IS NOT NULL"),
    "not_greater": (Predicate(Test.NOT_GREATER, "o_totalprice", 5000.0), "o_totalprice <= 5000"),
    "lesser": (Predicate(Test.LESSER, "o_custkey", 50), "o_custkey < 50"),
    "greater": (Predicate(Test.GREATER, "o_custkey", 50), "o_custkey > 50"),
    "distinct": (Predicate(Test.DISTINCT, STATUS, "O"), "NULLIF(o_orderstatus, 'F') IS DISTINCT FROM 'O'"),
    "not_distinct": (Predicate(Test.NOT_DISTINCT, STATUS, None), "NULLIF(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL"),
    "in": (Predicate(Test.IN, "o_orderpriority", ["1-URGENT", "5-LOW"]), "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "in_nothing": (Predicate(Test.IN, "o_orderpriority", []), "FALSE"),
    "not_in": (Predicate(Test.NOT_IN, STATUS, ["O"]), "(NULLIF(o_orderstatus, 'F') <> 'O' OR NULLIF(o_orderstatus, 'F') IS NULL)"),
    "equal": (Predicate(Test.EQUAL, STATUS, "O"), "NULLIF(o_orderstatus, 'F') = 'O'"),
    "not_equal": (Predicate(Test.NOT_EQUAL, STATUS, "O"), "NULLIF(o_orderstatus, 'F') <> 'O'"),
    "semi_join": (Predicate(Test.SEMI_JOIN, ["o_custkey"], ("events", ["user_id"])), "o_custkey IN (SELECT user_id FROM events)"),
    "semi_join_composite": (Predicate(Test.SEMI_JOIN, ["o_custkey", "o_custkey"], ("events", ["user_id", "event_id"])), "EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND event_id = o_custkey)"),
}
for _n, (_p, _s) in TESTS.items():
    from_query(f"pred_{_n}", lambda p=_p: Query({"o_orderkey": "o_orderkey", "o_custkey": "o_custkey"}, ["orders"], where=[p]), f"SELECT o_orderkey, o_custkey FROM orders WHERE {_s}")

ON = [(Attribute("orders", "o_custkey"), Attribute("customer", "c_custkey"))]
from_query(
    "spja_join_filter_group", lambda: Query(
        {"segment": "customer.c_mktsegment", "n": Expression(Op.COUNT, "*"), "top": Expression(Op.MAX, "orders.o_totalprice")}, ["orders", "customer"], ON,
        ["customer.c_acctbal > 0", Predicate(Test.GREATER, Attribute("orders", "o_totalprice"), 1000)], ["customer.c_mktsegment"]),
    "SELECT c_mktsegment AS segment, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > 1000 GROUP BY 1",
)
from_query("spja_group_without_aggregates", lambda: Query({"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}, ["orders"], group_by=["o_orderstatus", "o_orderpriority"]), "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY ALL")
from_query("spja_order_limit", lambda: Query({"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"}, ["orders"], order_by=[("o_totalprice", "desc"), ("o_orderkey", "asc")], limit=25), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
from_query("spja_window", lambda: Query({"c_nationkey": "c_nationkey", "n": Expression(Op.COUNT, "*"), "s": Expression(Op.SUM, "c_custkey")}, ["customer"], window_by=["c_nationkey"]),
           "SELECT c_nationkey, COUNT(*) OVER w AS n, CAST(SUM(c_custkey) OVER w AS BIGINT) AS s FROM customer WINDOW w AS (ORDER BY c_nationkey)")
from_query("spja_window_distinct", lambda: Query({"s_nationkey": "s_nationkey", "n": Expression(Op.DISTINCT_COUNT, "s_nationkey")}, ["supplier"], window_by=["s_nationkey"]), "SELECT s_nationkey, DENSE_RANK() OVER (ORDER BY s_nationkey) AS n FROM supplier")
from_query("sample_rows", lambda: Query({"o_orderkey": "o_orderkey"}, ["orders"], sample_rate=0.1, seed=3), None)


@query("SELECT MAX(n) AS most FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey)")
def spja_nested(spark, sf_dir):
    tables = catalog(spark, sf_dir)
    inner = run(Query({"n": Expression(Op.COUNT, "*")}, ["orders"], group_by=["o_custkey"]), tables, "nested")
    return Query({"most": Expression(Op.MAX, "n")}, {"inner": inner}).compile(tables)


@query("SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS k FROM orders WHERE o_orderstatus = 'O'")
def spja_written_and_viewed(spark, sf_dir):
    tables = catalog(spark, sf_dir)
    one = run(Query({"o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus"}, ["orders"]), tables, "write")
    two = run(Query({"o_custkey": "o_custkey"}, [one], where=["o_orderstatus = 'O'"]), tables, "view")
    return spark.sql(f"SELECT COUNT(*) AS n, SUM(o_custkey) AS k FROM {two}")


for _kind in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):

    def _set(spark, sf_dir, kind=_kind):
        tables = catalog(spark, sf_dir)
        return set_operation(kind, tables.table("orders").select(F.col("o_custkey").alias("k")), tables.table("events").select(F.col("user_id").alias("k")))

    _set.__name__ = f"set_{_kind.lower().replace(' ', '_')}"
    query(f"SELECT o_custkey AS k FROM orders {_kind} SELECT user_id AS k FROM events")(_set)


@query("UNPIVOT (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal FROM customer) ON c_nationkey, c_acctbal INTO NAME feature VALUE value")
def melt(spark, sf_dir):
    table = catalog(spark, sf_dir).table("customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return tables_of.melt(table, ["c_custkey"], ["c_nationkey", "c_acctbal"])


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def top_one_per_group(spark, sf_dir):
    return tables_of.top_of_each(catalog(spark, sf_dir).table("customer"), ["c_nationkey"], "c_acctbal", ["c_custkey"], ["c_custkey", "c_acctbal"])


@query("SELECT c_custkey, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS at FROM customer")
def count_within_group(spark, sf_dir):
    return tables_of.numbered_within(catalog(spark, sf_dir).table("customer"), ["c_nationkey"], ["c_custkey"]).select("c_custkey", "at")


@query("SELECT c_custkey, ROUND(c_acctbal + CASE WHEN c_acctbal <= 100 THEN 1 ELSE 2 END, 2) AS prediction FROM customer")
def renamed_view(spark, sf_dir):
    tables = catalog(spark, sf_dir)
    name = run(Query({"c_custkey": "c_custkey", "balance": "c_acctbal"}, ["customer"]), tables, "view")
    tables.rename_column(name, "balance", "b")
    out = tables.table(name).select("c_custkey", F.round(F.col("b") + F.when(F.col("b") <= 100, 1).otherwise(2), 2).alias("prediction"))
    tables.drop(name)
    return out


@query(f"{ROWS}, {tree_sql(1, 'r', 'x')} SELECT ROUND(SUM(a), 0) AS total, COUNT(*) AS n FROM (SELECT AVG(y) OVER (PARTITION BY node) AS a FROM x1)")
def scoring_facts(spark, sf_dir):
    graph = star(spark, sf_dir)
    model = DecisionTree(num_leaves=2, max_depth=1).fit(graph)
    rows = score_facts(graph.table("lineitem"), graph, model)
    return rows.agg(F.round(F.sum("prediction"), 0).alias("total"), F.count("*").alias("n"))


@query(f"{ROWS}, {tree_sql(1, 'r', 'x')} SELECT ROUND(SUM(a), 0) AS total, COUNT(*) AS n FROM (SELECT AVG(y) OVER (PARTITION BY node) AS a FROM x1)")
def scoring_joined_rows(spark, sf_dir):
    graph = star(spark, sf_dir)
    model = DecisionTree(num_leaves=2, max_depth=1).fit(graph)
    return score(graph.full_join(), model).agg(F.round(F.sum("prediction"), 0).alias("total"), F.count("*").alias("n"))


# booleans, null targets, keys without a match


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a boolean feature and a target that is null in a fifth of the rows."""
    y = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("y")
    return catalog(spark, sf_dir).table("orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "O").alias("is_open"), y)


@query("SELECT ROUND(AVG(y), 4) AS mean, COUNT(y) AS n FROM (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS y FROM orders)")
def dummy_mean_of_null_targets(spark, sf_dir):
    graph = JoinGraph.of(spark)
    graph.add_relation("orders", [], "y", source=_orders(spark, sf_dir))
    model = DummyModel().fit(graph)
    return one_row(spark, mean=round(model.constant, 4), n=model.count)


@query("SELECT o_orderkey, ROUND(AVG(CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END) OVER (PARTITION BY o_orderstatus = 'O'), 3) AS prediction FROM orders")
def boolean_feature(spark, sf_dir):
    """One cut by a boolean; rows without a target are scored, but teach nothing."""
    graph = JoinGraph.of(spark)
    graph.add_relation("orders", ["is_open"], "y", source=_orders(spark, sf_dir))
    model = DecisionTree(num_leaves=2, max_depth=1).fit(graph)
    return score(graph.table("orders"), model).select("o_orderkey", F.round("prediction", 3).alias("prediction"))


@query("SELECT o_orderkey, ROUND((SELECT AVG(o_totalprice) FROM orders), 3) AS prediction FROM orders")
def scores_of_unmatched_keys(spark, sf_dir):
    """Facts whose keys have no match in a dimension (of which two thirds are left) are scored too."""
    graph = star(spark, sf_dir)
    orders, customers = graph.table("orders"), graph.table("customer").filter("c_custkey % 3 > 0")
    graph = JoinGraph.of(spark)
    graph.add_relation("orders", [], "o_totalprice", source=orders)
    model = DummyModel().fit(graph)
    graph.add_relation("customer", ["c_acctbal"], source=customers)
    graph.add_join("orders", "customer", ["o_custkey"], ["c_custkey"], profile=False)
    return score_facts(orders, graph, model).select("o_orderkey", F.round("prediction", 3).alias("prediction"))
