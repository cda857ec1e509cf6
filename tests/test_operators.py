"""Planning, registry, closures, state and sinks on hand-made rows."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.fixed import LANE_PATTERNS
from weftline.operators import calls as X
from weftline.operators import closures as C
from weftline.operators import graph as G
from weftline.operators import ingest as I
from weftline.operators import ranking as R
from weftline.plans import planning as L
from weftline.sinks import stores as K
from weftline.sources import scans as N
from weftline.streaming import status as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_newest_version_rules(spark):
    v = spark.createDataFrame(
        [(1, "1.9.0", False), (1, "1.10.0", False), (1, "2.0.0", True), (2, "1.0.0-alpha.1", False), (2, "1.0.0", False), (2, "1.1.0-alpha.1", False), (3, "1.0.0-alpha.1", False), (3, "1.0.0-beta.1", False), (4, "0.1.0", True)],
        "package_id long, num string, yanked boolean",
    ).withColumn("created_at", F.lit(None).cast("timestamp"))
    assert {r.package_id: r.newest for r in R.newest_versions(v).collect()} == {1: "1.10.0", 2: "1.0.0", 3: "1.0.0-beta.1", 4: None}
    assert {r.package_id: r.newest for r in R.newest_versions(v, include_pre=True).collect()}[2] == "1.1.0-alpha.1"


@pytest.mark.parametrize("mode", ["daily", "backfill"])
def test_fair_interleave_is_the_walk(spark, mode):
    """Lanes by tier; a slot of an empty lane goes to the next slot whose lane has something."""
    random.seed(5)
    names = [(f"p{i:03}", random.choice(["revision", "schema", "newer", "never"]), random.choice([None, 60 * i + 1, 60 * i + 1]), i % 13 == 0) for i in range(160)]
    tier = L.priority(F.col("state"), F.col("forced"), F.col("download_rank"), mode)
    work = spark.createDataFrame(names, "name string, state string, download_rank int, forced boolean").withColumns({"version": F.lit("1.0.0"), "tier": tier})
    order = ["forced", "top-download-stale", "newer-version", "catalog-stale", "catalog-newer", "never-parsed-backfill", "long-tail-backfill"]
    items = sorted((order.index(r.tier), r.download_rank or 2**31, r.name) for r in work.collect())
    lanes = {lane: [n for t, _, n in items if t in tiers] for lane, tiers in {-1: (0,), 0: (1, 2), 1: (3, 4), 2: (5, 6)}.items()}
    assert {t for t, _, _ in items} == set(range(7 if mode == "backfill" else 6))
    walk, cursor, pattern = lanes.pop(-1), 0, LANE_PATTERNS[mode]
    while any(lanes.values()):
        offset = next(o for o in range(10) if lanes[pattern[(cursor + o) % 10]])
        walk.append(lanes[pattern[(cursor + offset) % 10]].pop(0))
        cursor = (cursor + offset + 1) % 10
    for cap in (10, 500):
        assert [r.name for r in L.select_work(work, cap, mode).collect()] == walk[:cap]


def test_staleness_of_versions(spark):
    wanted = spark.createDataFrame([("a", "1.0.0"), ("a", "2.0.0"), ("b", "1.0.0"), ("c", "1.0.0"), ("d", "1.10.0")], "name string, version string")
    recorded = spark.createDataFrame([("a", "1.0.0", "r", 2), ("a", "0.9.0", "r", 2), ("b", "1.0.0", "old", 2), ("c", "1.0.0", "r", 1), ("d", "1.9.0", "r", 2), ("d", "1.10.0", "r", 2)], "name string, version string, parser_revision string, schema_version int")
    assert rows(L.staleness(wanted, recorded, "r", 2).select("name", "version", "state")) == [("a", "1.0.0", "fresh"), ("a", "2.0.0", "never"), ("b", "1.0.0", "revision"), ("c", "1.0.0", "schema"), ("d", "1.10.0", "fresh")]
    assert rows(L.staleness(wanted, recorded, "r", 2, latest=True).where("name in ('a', 'd')").select("name", "version", "state")) == [("a", "1.0.0", "fresh"), ("a", "2.0.0", "newer"), ("d", "1.10.0", "fresh")]


def test_owner_modules_over_chains(spark):
    nodes = [("p", "p", "Crate"), ("p::m", "p", "Module")] + [(f"n{i}", "p", "Struct") for i in range(300)] + [("x", "q", "Struct"), ("y", "q", "Struct"), ("lost", "q", "Struct")]
    parents = [("p::m", "p"), ("n0", "p::m"), *[(f"n{i}", f"n{i - 1}") for i in range(1, 300)], ("x", "y"), ("y", "x"), ("lost", "nowhere")]
    got = C.nearest_modules(spark.createDataFrame(parents, "child string, parent string"), spark.createDataFrame(nodes, "id string, package string, kind string"))
    want = {"p": "p", "p::m": "p::m", **{f"n{i}": "p::m" for i in range(300)}, "x": "q", "y": "q", "lost": "q"}
    assert {r.id: r.module for r in got.collect()} == want and got.count() == len(want)


def test_wrapped_types(spark):
    inner = '{"resolved_path":{"id":7}}'
    types = [(1, inner), (2, f'{{"borrowed_ref":{{"type":{{"slice":{inner}}}}}}}'), (3, f'{{"array":{{"type":{{"raw_pointer":{{"type":{inner}}}}},"len":"2"}}}}'), (4, '{"generic":"T"}'), (5, None)]
    assert rows(I.unwrapped(spark.createDataFrame(types, "item_id long, type string"))) == [(1, 7), (2, 7), (3, 7), (4, None), (5, None)]


def test_delta_merge(spark):
    index = spark.createDataFrame([("alpha", "1", "old", 5, "t"), ("beta", "1", "old", 7, None)], "name string, version string, graph_hash string, nodes long, tier string")
    deltas = spark.createDataFrame(
        [("alpha", "1", "transient", "e1", None, None, None, 1), ("alpha", "1", "published", None, "new", 9, None, 2), ("beta", "1", "transient", "late", None, None, "b", 3), ("gamma", "1", "permanent", "bad", "unused", 3, None, 4), ("delta", "1", "parser-bumped", None, "d", 2, None, 5), ("beta", "1", "quarantine", None, "unused", 1, None, 6)],
        "name string, version string, outcome string, error string, graph_hash string, nodes long, tier string, seq long",
    )
    assert rows(L.merge_deltas(index, deltas)) == [("alpha", "1", "new", 9, "t", None, None), ("beta", "1", "old", 7, "b", "quarantine", ""), ("delta", "1", "d", 2, None, None, None), ("gamma", "1", "", None, None, "permanent", "bad")]


def test_channels_are_the_toolchains(spark):
    e = [("std", "1.96.0", "sysroot"), ("std", "1.97.0-beta.2", "sysroot"), ("std", "1.98.0-nightly", "sysroot"), ("core", "1.98.0-nightly", "sysroot"), ("lib", "1.0.0", "docs.rs"), ("lib", "2.0.0-beta.1", "docs.rs")]
    got = rows(R.channel_aliases(spark.createDataFrame(e, "name string, version string, source string")))
    assert got == [("core", "nightly", "1.98.0-nightly"), ("lib", "latest", "2.0.0-beta.1"), ("lib", "stable", "2.0.0-beta.1"), ("std", "beta", "1.97.0-beta.2"), ("std", "latest", "1.96.0"), ("std", "nightly", "1.98.0-nightly"), ("std", "stable", "1.96.0")]


def test_cycles_end(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e")], "child string, parent string")
    found = {(r.node, r.ancestor) for r in C.ancestors(parents, 8).collect()}
    assert {("a", "b"), ("a", "c"), ("d", "a"), ("d", "b"), ("d", "c")} <= found and not any(n == a for n, a in found)


def test_glob_closure(spark):
    globs = spark.createDataFrame([("m", "n"), ("n", "o"), ("o", "m")], "module string, target string")
    children = spark.createDataFrame([("n", "n::x"), ("o", "o::y"), ("m", "m::z")], "parent string, child string")
    assert rows(C.glob_exports(globs, children).where("module = 'm'")) == [("m", "m::z"), ("m", "n::x"), ("m", "o::y")]


def test_reexports_and_trait_docs(spark):
    edges = spark.createDataFrame([("demo", "demo::a::T", "ReExports"), ("demo", "demo::U", "ReExports")], "from_id string, to_id string, kind string")
    aliases = spark.createDataFrame([("demo::T", "demo::a::T")], "alias string, canonical string")
    assert rows(G.project_reexports(edges, aliases)) == [("demo", "demo::T", "ReExports"), ("demo", "demo::U", "ReExports")]
    members = spark.createDataFrame([("i::f", "T", "Function", "f", None), ("i::g", "T", "Function", "g", "own")], "id string, trait string, kind string, name string, docs string")
    trait = spark.createDataFrame([("T", "Function", "f", "doc f", True), ("T", "Function", "g", "doc g", True), ("T", "Function", "h", "doc h", True)], "trait string, kind string, name string, docs string, provided boolean")
    assert [r.docs for r in G.trait_documentation(members, trait).orderBy("id").collect()] == ["doc f", "own"]
    impls = spark.createDataFrame([("i", "T")], "impl string, trait string")
    assert rows(G.provided_methods(members.withColumn("impl", F.lit("i")), trait, impls)) == [("i", "Function", "h", "T")]


def events(n):
    random.seed(3)
    start, pick = datetime(2026, 1, 1), random.choice
    return [(f"k{random.randrange(5)}", "1", pick(["queue", "begin", "record", "record"]), pick([True, False, False]), pick(["processing", "ready", "failed"]), pick([None, "s"]), pick([None, "bad"]), pick([None, "r0", "r1", "r2"]), start + timedelta(seconds=i // 3), i) for i in range(n)]


def folded(rows_):
    state = {}
    for name, _, kind, forced, status, step, error, request, at, seq in rows_:
        state[name] = T.fold(state.get(name), {"kind": kind, "forced": forced, "status": status, "step": step, "error": error, "request_id": request, "at": at, "seq": seq})
    return {k: (*v[:5], v[6]) for k, v in state.items()}


SCHEMA = "name string, version string, kind string, forced boolean, status string, step string, error string, request_id string, at timestamp, seq long"


def test_status_rules():
    """Registration, rivals, force, events of other requests, and step and error that null clears."""
    at = [datetime(2026, 1, 1, i) for i in range(9)]
    e = lambda kind, request, t, status=None, step=None, forced=False: {"kind": kind, "forced": forced, "status": status, "step": step, "error": None, "request_id": request, "at": at[t]}
    s = T.fold(None, e("queue", "a", 0))
    assert s == ("processing", "queued", None, "a", at[0], at[0], 1)
    assert T.fold(s, e("queue", "b", 1)) == s and T.fold(s, e("begin", "b", 1)) == s and T.fold(s, e("record", "b", 1, "failed")) == s
    assert T.fold(s, e("begin", "b", 1, forced=True)) == ("processing", "workflow-started", None, "b", at[1], at[1], 3)
    s = T.fold(s, e("begin", "a", 2))
    assert s == ("processing", "workflow-started", None, "a", at[0], at[2], 3)
    s = T.fold(s, e("record", None, 3, "ready"))
    assert s == ("ready", None, None, "a", at[0], at[3], 4)
    assert T.fold(s, e("begin", "a", 4)) == s and T.fold(s, e("queue", "b", 3)) == s
    assert T.fold(s, e("queue", "b", 4)) == ("processing", "queued", None, "b", at[4], at[4], 5)


def test_status_batch_is_the_fold(spark):
    e = events(200)
    got = {r.name: (r.status, r.step, r.error, r.request_id, r.created_at, r.sequence) for r in T.final_status(spark.createDataFrame(e, SCHEMA)).collect()}
    assert got == folded(e)


def test_status_stream_is_the_batch(spark, tmp_path):
    e = events(120)
    for i in range(4):
        spark.createDataFrame(e[30 * i : 30 * i + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = T.status_stream(stream).writeStream.outputMode("update").format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = spark.table("statuses").groupBy("name").agg(F.max_by(F.struct("status", "step", "error", "request_id", "created_at", "sequence"), "sequence").alias("s")).collect()
    assert {r.name: tuple(r.s) for r in last} == folded(e)


def test_only_changed_buckets_are_written(spark, tmp_path):
    one = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "id string, v long")
    first = K.write_changed(one, ["id"], 16, None, f"file://{tmp_path}/a")
    second = K.write_changed(one.withColumn("v", F.when(F.col("id") == "k7", -1).otherwise(F.col("v"))), ["id"], 16, first, f"file://{tmp_path}/b")
    assert sum("/b/" in r.path for r in second.collect()) == 1 and second.count() == first.count()
    assert N.aggregate_index(spark, second.select("path", F.col("n").alias("rows"))).where("v = -1").count() == 1


def test_bad_flag_is_an_error(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,name\n1,a\n")
    (tmp_path / "v.csv").write_text("package_id,num,yanked\n1,1.0.0,maybe\n")
    p = N.packages_csv(spark, str(tmp_path / "p.csv"))
    assert p.first().downloads == 0
    try:
        N.versions_csv(spark, str(tmp_path / "v.csv"), p).collect()
    except Exception as e:
        assert "yanked is maybe" in str(e)
    else:
        raise AssertionError("accepted")


def test_lists_and_index_lines(spark, tmp_path):
    (tmp_path / "names").write_text("# all\n a \n\nb\n")
    assert rows(N.name_list(spark, str(tmp_path / "names"))) == [("a",), ("b",)]
    (tmp_path / "lines").write_text('{"name":"a","vers":"1","yanked":false}\nbroken\n{"name":"a","vers":"2","yanked":true}\n{"name":"a","vers":"3"}\n')
    assert [r.version for r in N.version_lines(spark, str(tmp_path / "lines"), 5).orderBy("place").collect()] == ["3", "1"]


FUNCTIONS = ["p::f", "p::m::f", "p::m::k::f", "p::n::g", "p::n::T::go", "p::m::T::go", "p::m::U::run", "p::q::h", "p::caller"]


def function_table(spark):
    return spark.createDataFrame([("p", i) for i in FUNCTIONS] + [("other", "other::m::f")], "package string, id string")


def path_calls(spark, *calls):
    return spark.createDataFrame([("p", f"c{i}", module, path, None) for i, (module, path) in enumerate(calls)], "package string, caller string, module string, path string, span string")


def test_paths_of_calls(spark):
    """One fitting function, by the path as it stands or in scope; anchors mean scope alone; any number of supers; no last segment alone."""
    asked = [("m", "f"), ("n", "super::m::f"), ("", "f"), ("n", "crate::n::g"), ("n", "x::h"), ("m", "self::f"), ("m::k", "super::super::n::g"), ("m", "super::super::super::q::h"), ("m::k", "super"), ("n", "super::self::g"), ("m", "Self::k::f"), ("q", "h")]
    got = {(r.caller, r.target, r.confidence) for r in X.resolve(path_calls(spark, *asked), function_table(spark)).collect()}
    assert got == {(f"c{i}", t, "Static") for i, t in [(0, "p::m::f"), (1, "p::m::f"), (3, "p::n::g"), (5, "p::m::f"), (6, "p::n::g"), (7, "p::q::h"), (9, "p::n::g"), (10, "p::m::k::f"), (11, "p::q::h")]}
    many = X.resolve(path_calls(spark, ("m", "f"), ("", "f"), ("n", "x::h")), function_table(spark), ambiguous=True)
    assert rows(many.select("caller", "target", "confidence")) == [(c, t, "Static" if (c, t) == ("c0", "p::m::f") else "Inferred") for c in ("c0", "c1") for t in ("p::f", "p::m::f", "p::m::k::f")]


def test_calls_of_methods(spark):
    asked = [("m", "T", "go"), ("m", "crate::n::T", "go"), ("n", "super::m::T", "go"), ("q", "T", "go"), ("q", None, "run"), ("q", "V", "run"), ("q", None, "go"), ("m", "T", "nothing")]
    calls = spark.createDataFrame([("p", f"c{i}", *a, i) for i, a in enumerate(asked)], "package string, caller string, module string, type string, name string, span int")
    methods = function_table(spark).where("id like '%::T::%' or id like '%::U::%'")
    assert rows(X.resolve_methods(calls, methods).select("caller", "target", "confidence")) == [("c0", "p::m::T::go", "Static"), ("c1", "p::n::T::go", "Static"), ("c2", "p::m::T::go", "Static"), ("c4", "p::m::U::run", "Static"), ("c5", "p::m::U::run", "Static")]
    every = {(r.caller, r.target, r.confidence) for r in X.resolve_methods(calls, methods, ambiguous=True).collect()}
    assert {x for x in every if x[0] in ("c0", "c3", "c6")} == {("c0", "p::m::T::go", "Static"), ("c0", "p::n::T::go", "Inferred")} | {(c, t, "Inferred") for c in ("c3", "c6") for t in ("p::m::T::go", "p::n::T::go")}


def test_places_of_calls(spark):
    """Two calls of one function on two lines: one edge with both places; what calls itself has no edge."""
    span = "struct<file: string, line: int, column: int>"
    calls = spark.createDataFrame([("p", "p::caller", "", path, ("src/lib.rs", line, 5)) for path, line in [("q::h", 3), ("q::h", 2), ("q::h", 2), ("caller", 4)]], f"package string, caller string, module string, path string, span {span}")
    edge = X.call_edges(X.resolve(calls, function_table(spark))).collect()
    assert [(e.from_id, e.to_id, e.confidence, [o.line for o in e.occurrences]) for e in edge] == [("p::caller", "p::q::h", "Static", [2, 3])]
