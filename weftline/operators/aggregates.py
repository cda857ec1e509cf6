"""Aggregations over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.fixed import NODE_KINDS, OVERVIEW_CONFIDENCE, SEMANTIC
from weftline.functions import scalars as S
from weftline.operators.filters import is_local_page
from weftline.shared import parts


def merge_edges(raw: DataFrame) -> DataFrame:
    """One edge for each (from, to, kind, glob), the strongest confidence, the first sequence number; occurrences are united, and counted."""
    strongest = F.max(F.struct(S.confidence_rank(F.col("confidence")).alias("rank"), "confidence"))["confidence"]
    return raw.groupBy("from_id", "to_id", "kind", "is_glob").agg(strongest.alias("confidence"), F.min("edge_seq").alias("edge_seq"), F.count_distinct("edge_seq").alias("occurrences"))


def merged_occurrences(raw: DataFrame) -> DataFrame:
    """The same with the edges' distinct places united, in order. raw: also occurrences (array of structs, null for none)."""
    strongest = F.max(F.struct(S.confidence_rank(F.col("confidence")).alias("rank"), "confidence"))["confidence"]
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_set("occurrences"))))
    merged = raw.groupBy("from_id", "to_id", "kind", "is_glob").agg(strongest.alias("confidence"), F.min("edge_seq").alias("edge_seq"), places.alias("places"))
    return merged.select("from_id", "to_id", "kind", "is_glob", "confidence", "edge_seq", F.when(F.size("places") > 0, F.col("places")).alias("occurrences"))


def merge_nodes(raw: DataFrame, completeness: Column | None = None) -> DataFrame:
    """One row for each id: local beats external, then the more complete, then the first seen."""
    score = completeness if completeness is not None else F.lit(0)
    best = F.max(F.struct((~F.col("is_external")).alias("local"), score.alias("score"), (-F.col("node_seq")).alias("late"), F.struct(*raw.columns).alias("row")))["row"]
    return raw.groupBy(F.col("id").alias("__id")).agg(best.alias("r")).select("r.*")


def kind_counts(nodes: DataFrame) -> DataFrame:
    """Local pages by package and kind."""
    return nodes.where(is_local_page()).groupBy("package", "kind").agg(F.count("*").alias("n"))


def kind_facets(nodes: DataFrame) -> DataFrame:
    """Every kind with its number of local pages, zero included."""
    kinds = nodes.sparkSession.createDataFrame([(k, i, label) for i, (k, label, _) in enumerate(NODE_KINDS)], "kind string, place int, label string")
    return kinds.join(nodes.where(is_local_page()).groupBy("kind").count(), "kind", "left").select("kind", "place", "label", F.coalesce("count", F.lit(0)).alias("n"))


def trait_metadata(edges: DataFrame) -> DataFrame:
    """By node: the traits it implements, how many, sorted."""
    traits = F.sort_array(F.collect_set("to_id"))
    return edges.where("kind = 'Implements'").groupBy(F.col("from_id").alias("id")).agg(traits.alias("traits")).withColumn("n_traits", F.size("traits").cast("long"))


def relationship_groups(page_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """By page, direction, relation and other node, the number of edges; impls as other nodes are left out."""
    incoming = F.col("to_id") == F.col("page")
    touching = page_edges.where((F.col("from_id") == F.col("page")) | incoming)
    other = touching.select("page", F.when(incoming, "in").otherwise("out").alias("direction"), "kind", F.when(incoming, F.col("from_id")).otherwise(F.col("to_id")).alias("other"))
    known = nodes.where("kind <> 'Impl'").select(F.col("id").alias("other"), "name")
    labelled = other.join(known, "other").withColumn("label", S.relation_label(F.col("kind"), F.col("direction") == "in"))
    return labelled.groupBy("page", "direction", "label", "other", "name").agg(F.count("*").alias("n"), F.min(S.relation_order(F.col("kind"))).alias("place"))


def ego(page_edges: DataFrame) -> DataFrame:
    """By page, neighbour and direction: the kinds, any glob, and the weakest confidence."""
    incoming = F.col("to_id") == F.col("page")
    e = page_edges.where((F.col("from_id") == F.col("page")) | incoming).where("from_id <> to_id")
    e = e.withColumns({"neighbour": F.when(incoming, F.col("from_id")).otherwise(F.col("to_id")), "direction": F.when(incoming, "in").otherwise("out")})
    shown = F.max(F.struct(S.confidence_rank(F.col("confidence"), OVERVIEW_CONFIDENCE).alias("rank"), "confidence"))["confidence"]
    return e.groupBy("page", "neighbour", "direction").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.bool_or("is_glob").alias("is_glob"), shown.alias("confidence"))


def module_counts(owners: DataFrame, nodes: DataFrame) -> DataFrame:
    """By module: nodes that it owns directly, and child modules. owners: id, module."""
    direct = owners.groupBy("module").agg(F.count("*").alias("direct"))
    modules = nodes.where("kind in ('Crate', 'Module')").select(F.col("id").alias("module"))
    children = modules.select(S.parent_id(F.col("module")).alias("parent")).where("parent is not null").groupBy(F.col("parent").alias("module")).agg(F.count("*").alias("children"))
    return modules.join(direct, "module", "left").join(children, "module", "left").select("module", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("children", F.lit(0)).alias("children"))


def module_matrix(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Semantic edges between the modules that own their ends: in all and by kind."""
    o = lambda end, name: owners.select(F.col("id").alias(end), F.col("module").alias(name))
    n = parts(edges, owners)
    e = edges.where(F.col("kind").isin(*SEMANTIC)).select("from_id", "to_id", "kind").repartition(n, "from_id").join(o("from_id", "from_module"), "from_id")
    e = e.drop("from_id").repartition(n, "to_id").join(o("to_id", "to_module"), "to_id")
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in SEMANTIC]
    return e.groupBy("from_module", "to_module").agg(F.count("*").alias("total"), *kinds)


def edge_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count_if(~F.col("is_external")).alias("internal_nodes"))
    return edges.agg(F.count("*").alias("all_edges"), F.count_if(F.col("kind").isin(*SEMANTIC)).alias("semantic_edges")).join(n, F.lit(True))  # one row each


def quality_gates(packages: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By graph: an outcome (rejected with its first reason, quarantined, accepted) and the numbers that led to it. packages: graph, name (of the
    package asked for), local_paths (of its document); nodes: graph, id, kind, is_external; edges: graph, from_id, to_id.

    Rejected: no nodes; an edge with an end that isn't there; no local package node of that name (hyphens and capitals aside); no
    local node; no local paths. Put aside: more than one local path, but a single local node."""
    n = nodes.groupBy("graph").agg(F.count("*").alias("n_nodes"), F.count_if(~F.col("is_external")).alias("n_local"))
    end = lambda name: nodes.select("graph", F.col("id").alias(f"{name}_id"), F.lit(True).alias(f"has_{name}"))
    lost = edges.join(end("from"), ["graph", "from_id"], "left").join(end("to"), ["graph", "to_id"], "left").where("has_from is null or has_to is null")
    roots = nodes.where("kind = 'Crate' and not is_external").join(packages.select("graph", "name"), "graph").where(S.normal_name(F.col("id")) == S.normal_name(F.col("name")))
    joined = packages.join(n, "graph", "left").join(lost.groupBy("graph").agg(F.count("*").alias("n_dangling")), "graph", "left")
    joined = joined.join(roots.select("graph", F.lit(True).alias("has_root")).distinct(), "graph", "left").na.fill(0, ["n_nodes", "n_local", "n_dangling"]).na.fill(False, ["has_root"])
    outcome = (
        F.when(F.col("n_nodes") == 0, "rejected: empty graph").when(F.col("n_dangling") > 0, "rejected: dangling edge").when(~F.col("has_root"), "rejected: no root")
        .when(F.col("n_local") == 0, "rejected: no local nodes").when(F.col("local_paths") == 0, "rejected: no local items")
        .when((F.col("local_paths") > 1) & (F.col("n_local") == 1), "quarantined").otherwise("accepted")
    )
    return joined.select("graph", "n_nodes", "n_local", "n_dangling", "has_root", outcome.alias("outcome"))


def publish_gate(nodes: DataFrame) -> DataFrame:
    """By package, whether it may be published: not with external nodes beside a single local one."""
    n = nodes.groupBy("package").agg(F.count("*").alias("n_nodes"), F.count_if(~F.col("is_external")).alias("n_local"), F.count_if("is_external").alias("n_external"))
    return n.withColumn("publish", ~((F.col("n_nodes") > 1) & (F.col("n_local") <= 1) & (F.col("n_external") > 0)))


def member_groups(nodes: DataFrame) -> DataFrame:
    """By impl, its members in order of kind and name."""
    place = F.when(F.col("kind") == "AssocType", 0).when(F.col("kind").isin("Constant", "AssocConst"), 1).when(F.col("kind") == "TypeAlias", 2).otherwise(3)
    return nodes.where("parent_impl is not null").groupBy("parent_impl").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "name", "id"))), lambda x: x["id"]).alias("members"))


def validation_report(items: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """By package: items, local and external paths, nodes, edges, link counts, a warning that names up to eight local paths without an item, and
    why the package is put aside. items: package, item_id; paths: package, item_id, is_local; links: package, raw, resolved, unresolved."""
    there = items.select("package", "item_id", F.lit(True).alias("there")).distinct()
    p = paths.join(there, ["package", "item_id"], "left")
    lost = F.col("is_local") & F.col("there").isNull()
    path_counts = p.groupBy("package").agg(F.count_if("is_local").alias("local_paths"), F.count_if(~F.col("is_local")).alias("external_paths"), F.count_if(lost).alias("n_lost"))
    order = Window.partitionBy("package").orderBy("item_id")
    first = p.where(lost).withColumn("r", F.row_number().over(order)).where("r <= 8").groupBy("package").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ", ").alias("sample"))
    counts = items.groupBy("package").agg(F.count("*").alias("items")).join(path_counts, "package", "left").join(first, "package", "left")
    n = nodes.groupBy("package").agg(F.count("*").alias("graph_nodes"), F.count_if(~F.col("is_external")).alias("local_nodes"))
    e = edges.groupBy(S.package_of(F.col("from_id")).alias("package")).agg(F.count("*").alias("graph_edges"))
    joined = counts.join(n, "package", "left").join(e, "package", "left").join(links, "package", "left")
    more = F.when(F.col("n_lost") > 8, F.concat(F.lit("; "), (F.col("n_lost") - 8).cast("string"), F.lit(" more"))).otherwise("")
    warning = F.when(F.col("n_lost") > 0, F.concat(F.col("n_lost").cast("string"), F.lit(" local paths without items: "), F.col("sample"), more))
    aside = (F.col("local_paths") > 1) & (F.col("local_nodes") == 1)
    return joined.select("package", "items", "local_paths", "external_paths", "graph_nodes", "graph_edges", "raw", "resolved", "unresolved", warning.alias("warning"), aside.alias("quarantined"))


def enriched(packages: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """Package nodes with what their document's root item says where they say nothing. roots: package and columns."""
    found = packages.join(roots.select("package", *[F.col(c).alias(f"root_{c}") for c in columns]), "package", "left")
    return found.select(*[F.coalesce(c, f"root_{c}").alias(c) if c in columns else c for c in packages.columns])
