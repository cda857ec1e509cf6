"""What keeps queries small on large tables: derived tables made by keys, edges made once, closures of what is asked for."""

import re

import pytest
from pyspark.sql import functions as F

from weftline import derived, shared
from weftline.functions import scalars as S
from weftline.operators import aggregates as A
from weftline.operators import calls as X
from weftline.operators import closures as C
from weftline.operators import graph as G
from weftline.sinks import stores as K
from weftline.sources import gates as W

ROWS = {
    "region": ("r_regionkey int, r_name string", [(0, "R"), (1, "Q")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (1, "M", 1)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double", [(1, "C1", 0, 0.0), (2, "C2", 1, 0.0), (3, "C1", 0, 0.0), (4, None, 0, 0.0)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "S1", 0), (2, "S1", 0), (3, "S3", 1)]),
    "part": ("p_partkey long, p_brand string", [(1, "B1"), (2, "B2"), (2, "B3"), (1, "B1")]),
    "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 2), (2, 2), (3, 3), (4, 4), (5, 1), (1, 2)]),
    "lineitem": (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_shipdate date",
        [(o, n, 1 + (o + n) % 3, 1 + (o * n) % 4, "ANR"[(o + n + k) % 3], "O", 1.0, None) for o in (1, 2, 3, 4, 9) for n in (1, 2, 3) for k in (0, 1)],
    ),
}


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Orders that come twice or under two customers, parts of two brands, equal and missing names, repeated line items."""
    folder = tmp_path_factory.mktemp("odd")
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def by_sql(spark, folder, name):
    frames = {}
    for step in [*derived._needs(name), name]:
        for inner in derived.re.findall(r"\{(\w+)\}", derived.SQL[step]):
            if inner not in frames:
                frames[inner] = spark.read.parquet(f"{folder}/{inner}.parquet")
        frames[step] = spark.sql(derived.SQL[step], **{k: frames[k] for k in set(derived.re.findall(r"\{(\w+)\}", derived.SQL[step]))})
    return frames[name]


@pytest.mark.parametrize("name", ["methods", "nodes", "raw_edges", "edges"])
def test_tables_by_keys_are_those_of_sql(spark, odd_tables, name):
    ours, theirs = derived.derive(spark, odd_tables, name), by_sql(spark, odd_tables, name)
    assert ours.dtypes == theirs.dtypes
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))


def test_edges_join_by_keys_and_not_by_ids(spark, odd_tables):
    plan = derived.derive(spark, odd_tables, "edges").where("kind = 'Implements'")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" in plan and "impl_id" not in plan


def test_page_edges_make_edges_once(spark, odd_tables):
    nodes, edges = (derived.derive(spark, odd_tables, t) for t in ("nodes", "edges"))
    found = G.page_edges(nodes.where("kind <> 'Function'"), edges)
    assert "lineitem.parquet" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem.parquet" not in str(found.inputFiles())


def test_page_edges_of_loops_and_circles(spark):
    nodes = spark.createDataFrame([("a", "Module"), ("b", "Struct"), ("i", "Impl")], "id string, kind string").withColumns({"is_external": F.lit(False), "parent_impl": F.lit(None).cast("string")})
    rows = [("a", "a", "Contains"), ("a", "b", "Contains"), ("b", "a", "Defines"), ("b", "i", "Defines"), ("i", None, "Defines"), ("i", "x", "Defines"), ("i", "b", "Defines"), ("i", "x", "Calls")]
    found = sorted(map(str, G.page_edges(nodes, spark.createDataFrame(rows + rows[:3], "from_id string, to_id string, kind string")).select("page", "from_id", "to_id", "kind").toLocalIterator()))
    own = {(p, *r) for r in rows for p in r[:2] if p in ("a", "b")}
    second = {(p, *s) for p, h, k in rows if p in ("a", "b") and k in ("Contains", "Defines") for s in rows if s[0] == h and s[2] in ("Contains", "Defines")}
    assert found == sorted(str(r) for r in spark.createDataFrame(list(own | second), "page string, from_id string, to_id string, kind string").collect())


def test_ancestors_of_what_is_asked_for(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "b")], "child string, parent string")
    found = C.ancestors(parents, of=spark.createDataFrame([("c",)], "id string"))
    assert sorted(map(tuple, found.collect())) == [("c", "a", 2), ("c", "b", 1)]


@pytest.mark.parametrize("text", ["", "a", "Customer#1", "h\u00e9llo", "\u4e2d\U0001f600", "\x00\x7f", None])
def test_bytes_of_texts(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(S.utf8_bytes(F.col("t")).alias("b")).first().b
    assert (got or []) == list((text or "").encode())


def test_changed_buckets_hash_rows_once(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("x").alias("name"))
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(K, "staged", lambda df, label, real=K.staged: seen.append(label) or real(df, label))
        old = K.write_changed(rows, ["id"], 8, None, f"file://{tmp_path}/one")
        new = K.write_changed(rows.withColumn("name", F.when(F.col("id") == "n7", "y").otherwise(F.col("name"))), ["id"], 8, old, f"file://{tmp_path}/two")
    assert seen == ["hashes", "hashes"] and new.join(old.select("path"), "path", "left_anti").count() == 1


def test_gates_send_no_items_through_the_driver(spark):
    docs = spark.createDataFrame([("f", "{}"), ("g", "no")], "file string, t string").select("file", F.try_parse_json("t").alias("doc"))
    found = W.examined(docs)
    assert {r.file: r.reasons[-1:] for r in found.collect()} == {"f": ["external_crates: missing"], "g": ["not JSON"]}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_input(spark, odd_tables, monkeypatch):
    """A task's share of the tree's joins stays the same when tables grow, whatever the session's number of partitions."""
    nodes, edges = (derived.derive(spark, odd_tables, t) for t in ("nodes", "edges"))
    cores = spark.sparkContext.defaultParallelism
    assert shared.parts(nodes, edges) == shared.parts(spark.range(3)) == cores
    monkeypatch.setattr(shared, "PART_BYTES", 200)
    n = shared.parts(edges)
    assert n > cores
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lines = shared.parts(spark.read.parquet(f"{odd_tables}/lineitem.parquet"))
    assert f", {lines}), REPARTITION_BY_NUM" in plan(derived.derive(spark, odd_tables, "edges"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        relations = plan(G.tree_relations(nodes, edges))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for end in ("from_id", "to_id", "impl"):
        found = re.findall(rf"hashpartitioning\({end}#\d+, (\d+)\)", relations)
        assert found and {int(k) for k in found} == {shared.parts(nodes, edges)}


def test_relations_of_ids_that_are_impls_and_more(spark):
    nodes = spark.createDataFrame([("a", "Module"), ("i", "Impl"), ("i", "Struct"), ("j", "Impl"), ("x", "Function"), ("k", None)], "id string, kind string").withColumns({"is_external": F.lit(False), "parent_impl": F.lit(None).cast("string")})
    rows = [("a", "i", "Defines", 1), ("i", "x", "Contains", 2), ("a", "j", "Defines", 3), ("j", "x", "Defines", 4), ("a", "j", "Contains", 0), ("z", "k", "Contains", 5), ("k", "w", "Defines", 6), ("a", "x", "UsesType", 7), (None, "x", "Defines", 8)]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, kind string, edge_seq long")
    found = {tuple(r) for r in G.tree_relations(nodes, edges).collect()}
    assert found == {("a", "i", 1), ("i", "x", 2), ("a", "x", 1), ("z", "k", 5), ("k", "w", 6), (None, "x", 8)}


def test_calls_count_what_fits_once(spark, monkeypatch):
    """functions are read, exploded and counted once for the attempts by type and by name; ids of one segment have no suffix."""
    seen = []
    monkeypatch.setattr(X, "staged", lambda df, label, real=X.staged: seen.append(label) or real(df, label))
    functions = spark.createDataFrame([("p", "p::T::m"), ("p", "p::U::k"), ("p", "p::V::k"), ("p", "m"), ("p", None)], "package string, id string")
    calls = spark.createDataFrame([("p", "p::f", "p", "T", "m", 1), ("p", "p::f", "p", None, "m", 2), ("p", "p::f", "p", "W", "k", 3), ("p", "p::f", "p", "U", "k", 4)], "package string, caller string, module string, type string, name string, span int")
    found = X.resolve_methods(calls, functions)
    assert sorted((r.span, r.target) for r in found.collect()) == [(1, "p::T::m"), (2, "p::T::m"), (4, "p::U::k")]
    assert sorted(seen) == ["asked", "fits", "typed_calls"]


def test_matrix_deals_edges_by_the_input(spark, odd_tables, monkeypatch):
    """both joins of edges with owners are dealt by the size of the input."""
    edges = derived.derive(spark, odd_tables, "edges")
    monkeypatch.setattr(shared, "PART_BYTES", 200)
    owners = spark.createDataFrame([("R", "R")], "id string, module string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.module_matrix(edges, owners)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for end in ("from_id", "to_id"):
        assert f"hashpartitioning({end}" in plan and f", {shared.parts(edges)}), REPARTITION_BY_NUM" in plan.split(f"hashpartitioning({end}", 1)[1][:60]
