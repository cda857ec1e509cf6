"""Focused views, graphs in batches, the tree index meanwhile, snapshots, lanes and gates, on hand-made rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.fixed import SUMMARY_PREFIX
from weftline.operators import aggregates as A
from weftline.operators.focus import Focus, trait_metadata
from weftline.plans import planning as L
from weftline.sources import snapshots as Z
from weftline.streaming import graph_load as H

NODE, EDGE = "id string, name string, kind string", "from_id string, to_id string, kind string, confidence string"


def focus(spark, nodes, edges, seed, **options):
    view = Focus(spark.createDataFrame([(n, n.split("::")[-1], k) for n, k in nodes], NODE), spark.createDataFrame([(*e, "Static") for e in edges], EDGE), spark.createDataFrame([(s,) for s in ([seed] if isinstance(seed, str) else seed)], "seed string"), **options)
    return view.nodes_out.collect(), view.edges_out.collect()


def test_traits_and_internals_are_hidden(spark):
    nodes = [("c::TypeA", "Struct"), ("c::SomeTrait", "Trait"), ("c::impl-TypeA", "Impl"), ("c::TypeA::field", "StructField"), ("c::TypeA::Variant", "Variant"), ("c::dep_fn", "Function")]
    edges = [("c::TypeA", "c::SomeTrait", "Implements"), ("c::TypeA", "c::impl-TypeA", "Defines"), ("c::TypeA", "c::TypeA::field", "Contains"), ("c::TypeA", "c::TypeA::Variant", "Contains"), ("c::TypeA", "c::dep_fn", "UsesType")]
    found, links = focus(spark, nodes, edges, "c::TypeA")
    assert {n.id for n in found} == {"c::TypeA", "c::dep_fn"} and [(e.from_id, e.to_id) for e in links] == [("c::TypeA", "c::dep_fn")]
    traits = trait_metadata(spark.createDataFrame([(n, n.split("::")[-1], k) for n, k in nodes], NODE), spark.createDataFrame([(*e, "Static") for e in edges], EDGE)).collect()
    assert [(t.id, t.trait_ids, t.trait_names) for t in traits] == [("c::TypeA", ["c::SomeTrait"], ["SomeTrait"])]


def test_dense_neighbourhoods_are_capped(spark):
    nodes = [("c::Center", "Struct")] + [(f"c::dep_{i:03}", "Function") for i in range(240)]
    found, links = focus(spark, nodes, [("c::Center", n, "UsesType") for n, _ in nodes[1:]], "c::Center", max_nodes=30, max_edges=80)
    assert len(found) == 30 and len(links) == 29
    assert {(n.id, n.name) for n in found if n.synthetic} == {(f"{SUMMARY_PREFIX}c::Center::overflow-out", "+212 more deps")}
    assert {n.id for n in found} >= {"c::Center", "c::dep_000", "c::dep_027"} and "c::dep_028" not in {n.id for n in found}


def test_edges_are_capped(spark):
    nodes = [("c::Center", "Struct")] + [(f"c::n_{i:02}", "Function") for i in range(40)]
    edges = [e for n, _ in nodes[1:] for e in (("c::Center", n, "UsesType"), (n, "c::Center", "CallsRuntime"))]
    found, links = focus(spark, nodes, edges, "c::Center", max_nodes=100, max_edges=24)
    assert len(links) == 24 and sum(e.kind == "UsesType" for e in links) == 24 and "c::Center" in {n.id for n in found}
    assert [n.name for n in found if n.synthetic] == ["+56 more links"]


def test_selected_node_is_never_hidden(spark):
    found, links = focus(spark, [("c::TraitA", "Trait"), ("c::TypeA", "Struct")], [("c::TypeA", "c::TraitA", "Implements")], ["c::TraitA", "c::TypeA"])
    assert {(n.seed, n.id) for n in found} == {("c::TraitA", "c::TraitA"), ("c::TraitA", "c::TypeA"), ("c::TypeA", "c::TypeA")} and len(links) == 1


def test_hops_don_t_pass_hidden_nodes(spark):
    nodes = [("a", "Struct"), ("t", "Trait"), ("b", "Struct"), ("c", "Struct"), ("d", "Struct")]
    edges = [("a", "t", "Implements"), ("b", "t", "Implements"), ("a", "c", "UsesType"), ("c", "d", "UsesType")]
    assert {n.id for n in focus(spark, nodes, edges, "a", max_hops=5)[0]} == {"a", "c", "d"}
    assert {n.id for n in focus(spark, nodes, edges, "a", max_hops=5, traits=True)[0]} == {"a", "b", "c", "d", "t"}
    assert {n.id for n in focus(spark, nodes, edges, "a", max_hops=2, semantic=False)[0]} == {"a"}


# ---- batches


def graph(seed=7):
    r = random.Random(seed)
    nodes = [("p", "1", f"p::n{r.randrange(30)}", f"name{i}", "Struct", "Public", False, i) for i in range(60)]
    ends = [f"p::n{i}" for i in range(30)] + ["q::x", "q::y"]
    edges = [("p", "1", r.choice(ends), r.choice(ends), r.choice(["Contains", "Defines", "UsesType"]), r.choice(["Static", "Inferred"]), r.random() < 0.5, i) for i in range(150)]
    return nodes, edges


def final(spark, nodes, edges):
    n, e = H.loaded_nodes(nodes), H.loaded_edges(edges)
    return sorted(map(tuple, n.collect())), sorted(map(tuple, e.collect())), sorted(map(str, H.cross_edges(e, n).collect()))


def test_batches_in_any_order_and_again_load_the_same(spark, tmp_path):
    nodes, edges = graph()
    want = final(spark, spark.createDataFrame(nodes, H.NODE), spark.createDataFrame(edges, H.EDGE))
    assert len(want[2]) > 5
    for seed, parts in ((1, 5), (2, 3)):
        r = random.Random(seed)
        for name, rows, schema in (("nodes", nodes, H.NODE), ("edges", edges, H.EDGE)):
            rows = r.sample(rows, len(rows))
            for k in range(parts):
                for _ in range(1 + (k == 1)):  # the second batch comes twice
                    H.write_batch(spark.createDataFrame(rows[k::parts], schema), f"file://{tmp_path}/{seed}/{name}", k)
        logs = [H.log(spark, f"file://{tmp_path}/{seed}/{n}", s) for n, s in (("nodes", H.NODE), ("edges", H.EDGE))]
        assert final(spark, *logs) == want
        counts = {(c.part, c.batch): c for c in H.batch_counts(*logs).collect()}
        assert sum(c.rows for c in counts.values()) == len(nodes) + len(edges) and sum(c.new for (p, _), c in counts.items() if p == "nodes") == len(want[0])
        assert sum(c.new for (p, _), c in counts.items() if p == "edges") == len(want[1])


def test_stream_loads_what_the_batch_loads(spark, tmp_path):
    nodes, edges = graph(9)
    want = final(spark, spark.createDataFrame(nodes, H.NODE), spark.createDataFrame(edges, H.EDGE))
    logs, index = [], f"file://{tmp_path}/index"
    empty_nodes, empty_edges = spark.createDataFrame([], H.NODE), spark.createDataFrame([], H.EDGE)
    thens = {"edges": lambda rows, _: H.update_index(spark, index, H.places(empty_nodes, rows)), "nodes": lambda rows, _: H.update_index(spark, index, H.places(rows, empty_edges))}
    for name, rows, schema in (("edges", edges, H.EDGE), ("nodes", nodes, H.NODE)):
        source = f"file://{tmp_path}/in-{name}"
        spark.createDataFrame(rows, schema).repartition(3).write.json(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        H.load(stream, f"file://{tmp_path}/{name}", f"file://{tmp_path}/check-{name}", thens[name]).trigger(availableNow=True).start().awaitTermination()
        logs.append(H.log(spark, f"file://{tmp_path}/{name}", schema))
    assert final(spark, logs[1], logs[0]) == want
    known = H.read_index(spark, index)
    assert tree(known) == plain_tree(nodes, edges)


def tree(index):
    return {r.id: r.parent for r in index.collect()}, {r.id for r in H.roots(index).collect()}, {(r.parent, r.child) for r in H.children(index).collect()}


def plain_tree(nodes, edges):
    """The first edge by number decides; nodes without one are roots."""
    parents = {n[2]: None for n in nodes}
    for e in sorted((e for e in edges if e[4] != "UsesType"), key=lambda e: (e[7], e[2]), reverse=True):
        parents[e[3]] = e[2]
    return parents, {n[2] for n in nodes if parents[n[2]] is None}, {(p, c) for c, p in parents.items() if p is not None}


def test_index_after_every_batch(spark):
    nodes, edges = graph(11)
    r = random.Random(3)
    events = [(n, None) for n in nodes] + [(None, e) for e in edges]
    r.shuffle(events)
    index, seen = H.places(spark.createDataFrame([], H.NODE), spark.createDataFrame([], H.EDGE)), []
    for k in range(0, len(events), 55):
        part = events[k : k + 55]
        seen += part
        batch = H.places(spark.createDataFrame([n for n, _ in part if n], H.NODE), spark.createDataFrame([e for _, e in part if e], H.EDGE))
        after = spark.createDataFrame(H.with_batch(index, batch).collect(), "id string, is_node boolean, parent string, edge_seq long")
        before, want = tree(index)[0], plain_tree([n for n, _ in seen if n], [e for _, e in seen if e])
        assert tree(after) == want
        assert {(c.id, c.before, c.after) for c in H.changes(index, after).collect()} == {(i, before.get(i), p) for i, p in want[0].items() if before.get(i) != p}
        assert tree(H.with_batch(after, batch)) == want
        index = after


# ---- snapshots, lanes, gates


def test_snapshots(spark, tmp_path):
    folder, now, built = f"file://{tmp_path}/s", datetime(2026, 5, 1, 12), []

    def ask(at, age_hours, pre=False):
        def build():
            built.append(at)
            return spark.createDataFrame([(len(built),)], "n int")

        rows, reused = Z.load_or_build(spark, folder, pre, timedelta(hours=age_hours), at, build)
        return rows.first().n, reused

    assert ask(now, 24) == (1, False)
    assert ask(now + timedelta(hours=23), 24) == (1, True)
    assert ask(now + timedelta(hours=24), 24) == (1, True)
    assert ask(now + timedelta(hours=25), 24) == (2, False)
    assert ask(now + timedelta(hours=25), 0) == (3, False)
    assert ask(now + timedelta(hours=26), 24, pre=True) == (4, False)
    assert ask(now + timedelta(hours=20), 24, pre=True) == (5, False)  # the newest pointer is from later on
    assert Z.latest(spark, folder).count() == 1


@pytest.mark.parametrize("cap", [1, 7, 100, 5000])
def test_lanes_are_cut_before_they_are_ranked(spark, cap):
    r = random.Random(5)
    rows = [(f"p{r.randrange(10**6):06}", r.choice(["revision", "newer", "never"]), r.choice([None, r.randrange(1, 100_000)]), r.random() < 0.02) for _ in range(4000)]
    work = spark.createDataFrame(rows, "name string, state string, download_rank int, forced boolean").withColumns({"version": F.lit("1.0.0"), "tier": L.priority(F.col("state"), F.col("forced"), F.col("download_rank"))}).dropDuplicates(["name"])
    whole = [x.name for x in L.fair_order(work).orderBy("forced_first", "cycle", "slot", "lane").limit(cap).collect()]
    assert [x.name for x in L.select_work(work, cap).collect()] == whole
    if cap <= 7:
        assert L.first_of_lanes(work, cap).count() < 400


def test_every_gate(spark):
    packages = [(g, "my-pkg", n) for g, n in (("good", 3), ("none", 3), ("to", 3), ("from", 3), ("kind", 3), ("outer", 3), ("name", 3), ("items", 0), ("only", 2), ("one", 1))]
    nodes = [(g, "My_Pkg", "Crate", False) for g in ("good", "to", "from", "items", "only", "one")] + [("kind", "my_pkg", "Module", False), ("outer", "my_pkg", "Crate", True), ("name", "my_pkgs", "Crate", False)]
    nodes += [(g, "My_Pkg::x", "Struct", g == "only") for g in ("good", "to", "from", "items", "only", "kind", "outer")]
    edges = [("good", "My_Pkg", "My_Pkg::x"), ("to", "My_Pkg", "lost"), ("from", "lost", "My_Pkg")]
    got = A.quality_gates(spark.createDataFrame(packages, "graph string, name string, local_paths long"), spark.createDataFrame(nodes, "graph string, id string, kind string, is_external boolean"), spark.createDataFrame(edges, "graph string, from_id string, to_id string"))
    assert {r.graph: r.outcome for r in got.collect()} == {
        "good": "accepted", "none": "rejected: empty graph", "to": "rejected: dangling edge", "from": "rejected: dangling edge", "kind": "rejected: no root", "outer": "rejected: no root",
        "name": "rejected: no root", "items": "rejected: no local items", "only": "quarantined", "one": "accepted",
    }
