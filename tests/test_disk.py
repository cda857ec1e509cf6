"""What keeps disks and the driver small: shuffles that go when a step is written, sieves ahead of joins, groups dealt once, merges of tables that
pack well."""

import re
import time

from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import calls as X
from weftline.operators import graph as G
from weftline.operators import ingest as I
from weftline.operators import pages as V
from weftline.operators import ranking as R
from weftline.operators.focus import Focus
from weftline.operators.sieve import sieve, sifted, unsifted
from weftline.shared import staged
from weftline.sinks import stores as K
from weftline.streaming import graph_load as H
from weftline.view_queries import _streamed

NODES = [("a", "Module", False), ("s", "Struct", False), ("t", "Trait", False), ("i", "Impl", False), ("j", "Impl", False), ("m", "Function", True), ("e", "Enum", None)]
EDGES = [
    ("a", "s", "Contains"), ("a", "t", "Contains"), ("s", "i", "Defines"), ("s", "j", "Defines"), ("i", "m", "Defines"), ("i", "j", "CallsStatic"), ("j", "j", "CallsStatic"),
    ("i", "t", "CallsStatic"), ("s", "t", "Implements"), ("m", "e", "UsesType"), ("i", "s", "CallsStatic"), ("j", None, "CallsStatic"), ("s", "s", "Defines"), ("s", None, "Defines"), ("t", "i", "Defines"),
]


def _graph(spark):
    rows = [(n, n, k, n == "e", "i" if inside else None) for n, k, inside in NODES]
    nodes = spark.createDataFrame(rows, "id string, name string, kind string, is_external boolean, parent_impl string").withColumn("id", F.when(F.col("id") == "m", "i::impl-1::m").otherwise(F.col("id")))
    named = lambda c: F.when(F.col(c) == "m", "i::impl-1::m").otherwise(F.col(c)).alias(c)
    return nodes, spark.createDataFrame(EDGES + EDGES[:4], "from_id string, to_id string, kind string").select(named("from_id"), named("to_id"), "kind")


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sieves_keep_all_that_a_join_keeps(spark):
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    through = sieve(ids, "id")
    rows = spark.createDataFrame([(x,) for x in ["a", "b", "c", None, "a", *map(str, range(500))]], "id string")
    inside, outside = [r.id for r in sifted(rows, "id", through).collect()], [r.id for r in unsifted(rows, "id", through).collect()]
    assert sorted(inside) == ["a", "a", "b"] and len(outside) == 502 and None in outside and "c" in outside


def test_shuffles_go_when_a_step_is_written(spark):
    """Before, the shuffle files of every step stayed until the driver collected its garbage."""
    files = lambda: sum(".data" in str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = files()
    found = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "k")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and found.count() == 7


def test_what_is_grouped_by_page_is_dealt_once(spark):
    """rows and pages are each shuffled once, also for the ranking and the counts; edges of what a page holds aren't made for it."""
    nodes, edges = _graph(spark)
    for found in (R.neighbour_cap(G.own_edges(nodes, edges), 3), R.overflow(G.own_edges(nodes, edges), 3)):
        assert len(re.findall(r"Exchange hashpartitioning", _plan(found))) <= 2
    kept = {(r.page, r.neighbour) for r in R.neighbour_cap(G.page_edges(nodes, edges), 3).collect()}
    left = {}
    for r in G.page_edges(nodes, edges).collect():
        if r.page in (r.from_id, r.to_id) and None not in (r.from_id, r.to_id) and r.from_id != r.to_id:
            other = r.from_id if r.to_id == r.page else r.to_id
            if (r.page, other) not in kept:
                left.setdefault(r.page, {}).setdefault(other, set()).add(r.to_id == r.page)
    want = [(p, len(o), sum(True in d for d in o.values()), sum(False in d for d in o.values())) for p, o in left.items()]
    assert want and _rows(R.overflow(G.own_edges(nodes, edges), 3)) == sorted(map(str, want))


def test_related_nodes_by_all_ends(spark):
    """the pairs are those of both ends of all edges of a page, and dealt by id once."""
    nodes, edges = _graph(spark)
    found = G.related_ends(*G.page_parts(nodes, edges))
    assert len(re.findall("Exchange", _plan(found))) == 1
    ends = G.page_edges(nodes, edges).select("page", F.explode(F.array("from_id", "to_id")).alias("id")).where("id <> page").distinct()
    assert _rows(found) == _rows(ends)


def test_edges_between_two_impls_of_a_type(spark):
    """an edge whose both ends a type defines is there once, loops and lost ends too."""
    nodes, edges = _graph(spark)
    rows = {tuple(r) for r in edges.collect()}
    pages = {r.id: r.kind for r in nodes.collect() if r.kind in ("Module", "Struct", "Trait")}
    want = {(p, *r) for p in pages for r in rows if p in r[:2]}
    want |= {(p, *r) for p, k in pages.items() if k != "Module" for h in rows if h[0] == p and h[2] == "Defines" and h[1] for r in rows if h[1] in r[:2]}
    assert _rows(V.local_page_edges(nodes, edges)) == sorted(str(r) for r in want)


def test_cross_edges_of_repeated_and_unknown_ids(spark):
    """edges are dealt twice, not once for each of their ends and joins."""
    cross = spark.createDataFrame([("p::a", "q::b", "K"), ("p::a", "q::lost", "K"), ("q::b", "q::b", "L"), ("p::x", "p::a", "K")], "from_id string, to_id string, kind string")
    known = spark.createDataFrame([("p::a", "A1", "S"), ("p::a", "A2", "S"), ("q::b", "B", "T")], "id string, name string, kind string")
    ids = spark.createDataFrame([("p::a",), ("p::a",), ("q::b",), ("q::lost",)], "id string")
    found = V.cross_edge_data(cross, known, ids)
    row = lambda i, f, t, k, o, n, kind: (i, f, t, k, o, n, kind)
    want = [
        row("p::a", "p::a", "q::b", "K", "q::b", "B", "T"), row("q::b", "p::a", "q::b", "K", "p::a", "A1", "S"), row("q::b", "p::a", "q::b", "K", "p::a", "A2", "S"),
        row("p::a", "p::a", "q::lost", "K", "q::lost", "lost", "ExternCrate"), row("q::lost", "p::a", "q::lost", "K", "p::a", "A1", "S"), row("q::lost", "p::a", "q::lost", "K", "p::a", "A2", "S"),
        row("q::b", "q::b", "q::b", "L", "q::b", "B", "T"), row("p::a", "p::x", "p::a", "K", "p::x", "x", "ExternCrate"),
    ]
    assert _rows(found) == sorted(map(str, want))


def test_view_rows_bring_the_hash_of_their_page(spark, tmp_path):
    """a page is hashed once and not for each of its rows; the store is the same."""
    nodes, edges = _graph(spark)
    own, rest = G.page_parts(nodes, edges, bucket=S.bucket_label(F.col("page"), 4))
    above = spark.createDataFrame([("s", "a", 1)], "node string, ancestor string, depth int")
    tables = K.page_details(G.ends_of(own, "bucket").unionByName(rest), G.related_nodes(G.related_ends(own, rest, "bucket"), nodes, "bucket"), above)
    assert ["fnv" in _plan(t) or "aggregate(" in _plan(t) for t in tables] == [False] * 3
    K.write_details(tables, f"file://{tmp_path}/with", 4)
    K.write_details([t.drop("bucket") for t in tables], f"file://{tmp_path}/without", 4)
    with_, without = [spark.read.parquet(f"file://{tmp_path}/{x}").selectExpr("page", "part", "from_id", "to_id", "kind", "depth", "package", "bucket") for x in ("with", "without")]
    assert _rows(with_) == _rows(without) and with_.count() == sum(t.count() for t in tables)


def test_views_reach_two_hops(spark):
    """what the sieves drop no view needs; names and kinds of seeds without edges stay."""
    nodes = spark.createDataFrame([(x, x, "Struct") for x in "abcdez"], "id string, name string, kind string")
    edges = spark.createDataFrame([("a", "b", "Contains", "Static"), ("b", "c", "Contains", "Static"), ("c", "d", "Contains", "Static"), ("d", "e", "Contains", "Static"), ("b", "b", "Contains", "Static")], "from_id string, to_id string, kind string, confidence string")
    view = Focus(nodes, edges, spark.createDataFrame([("a",), ("z",)], "seed string"), max_hops=2)
    assert sorted((r.seed, r.id) for r in view.nodes_out.collect()) == [("a", "a"), ("a", "b"), ("a", "c"), ("z", "z")]
    assert sorted((r.from_id, r.to_id) for r in view.edges_out.collect()) == [("a", "b"), ("b", "b"), ("b", "c")]
    assert view.edges.count() <= 4 and "e" not in [r.id for r in view.nodes.collect()]


def test_suffixes_that_no_call_asks_for_are_dropped(spark, monkeypatch):
    """F16: before, every suffix of every function was shuffled twice."""
    seen = []
    monkeypatch.setattr(X, "_every", lambda table, n, real=X._every: seen.append(table.count()) or real(table, n))
    functions = spark.createDataFrame([("p", f"p::m{k}::f") for k in range(50)] + [("p", "p::n::g"), ("q", "q::n::g")], "package string, id string")
    calls = spark.createDataFrame([("p", "p::c", "m1", "f", 1), ("p", "p::c", "m1", "g", 2), ("p", "p::c", "m1", "m3::f", 3)], "package string, caller string, module string, path string, span int")
    found = {(r.target, r.span): r.confidence for r in X.resolve(calls, functions, ambiguous=True).collect()}
    assert found == {(f"p::m{k}::f", 1): "Static" if k == 1 else "Inferred" for k in range(50)} | {("p::n::g", 2): "Static", ("p::m3::f", 3): "Static"}
    assert seen == [53]


def test_batches_are_cut_without_a_shuffle(spark):
    """files come in as many triggers as asked for at most, and keys are carried once through the choice of a row."""
    rows = spark.range(0, 40, 1, 9).select(F.lit("all").alias("package"), F.lit("1").alias("version"), F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("K").alias("kind"), F.lit("P").alias("visibility"), F.lit(False).alias("is_external"), F.col("id").alias("node_seq"))
    log = _streamed(rows.unionByName(rows.withColumns({"name": F.lit("new"), "node_seq": F.col("node_seq") + 100})), H.NODE, "nodes", 4)
    assert log.count() == 80 and log.select("batch").distinct().count() <= 4
    loaded = H.loaded_nodes(log)
    assert loaded.columns == [c.split()[0] for c in H.NODE.split(", ")] and {r.name for r in loaded.collect()} == {"new"} and loaded.count() == 40
    assert "struct(package" not in _plan(loaded)


def test_the_index_of_items_is_merged(spark):
    """the index packs to a few MB of files and was broadcast whole, once under each of its names."""
    index = staged(spark.range(5).select(F.col("id").alias("item_id"), F.lit("Struct").alias("kind"), F.lit("p").alias("path"), F.concat(F.lit("p::"), "id").alias("node")), "index")
    links = spark.createDataFrame([("p", 1, "t", 2), ("p", 1, "t", 9)], "package string, item_id long, text string, target_item long")
    found = I.doc_links(links, index, spark.createDataFrame([("p::2", "p::two")], "canonical string, alias string"))
    assert "BroadcastHashJoin Inner" not in _plan(found) and "SortMergeJoin" in _plan(found)
    assert sorted(r.target or "" for r in found.collect()) == ["", "p::two"]
