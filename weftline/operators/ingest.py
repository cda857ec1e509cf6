"""Items of API documents (item_id, kind, name, path, ...) to nodes, edges and aliases. Every lookup is an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators.closures import glob_exports
from weftline.shared import staged

#: Kinds of members that become nodes, and the word before their number.
MEMBER_PREFIX = {"Function": "method", "AssocType": "type", "AssocConst": "const", "Constant": "const", "TypeAlias": "type"}
#: Where a type holds the type that it wraps.
WRAPPERS = ("borrowed_ref.type", "raw_pointer.type", "slice", "array.type", "pat.type", "qualified_path.self_type")


def _suffixed(path: Column) -> Column:
    return F.concat(path, F.lit("~"), S.kind_slug(F.col("kind")), F.lit("-"), F.col("item_id").cast("string"))


def node_ids(items: DataFrame) -> DataFrame:
    """item_id, kind, path and node: of the items of one path a module, else the lowest id, keeps the path; others get their kind and id
    behind it. The path of the package itself is one node. The keeper is a minimum, so a path of any number of items is no group."""
    keeper = F.min(F.struct(F.col("kind") != "Module", "item_id"))["item_id"].alias("keeper")
    kept = items.join(items.groupBy("path").agg(keeper), "path")
    own = (F.col("path") == F.col("package")) | (F.col("item_id") == F.col("keeper"))
    return kept.select("item_id", "kind", "path", F.when(own, F.col("path")).otherwise(_suffixed(F.col("path"))).alias("node"))


def resolve(wanted: DataFrame, index: DataFrame, summaries: DataFrame) -> DataFrame:
    """wanted (item_id) with node: by the index, else by the path summaries; null if neither knows it."""
    second = summaries.groupBy("item_id").agg(F.min("path").alias("summary"))
    return wanted.join(index.select("item_id", "node"), "item_id", "left").join(second, "item_id", "left").select(*wanted.columns, F.coalesce("node", "summary").alias("node"))


def unwrapped(types: DataFrame) -> DataFrame:
    """item_id and owner: the id of the path below references, pointers, slices, arrays and qualified selves. types: item_id, type (JSON
    text, as to_json gives it). Each round takes one layer off every type that has one left."""
    inner = F.coalesce(*[F.get_json_object("type", f"$.{w}") for w in WRAPPERS])
    found = types.select("item_id", "type", inner.alias("inner"))
    while not found.where("inner is not null").isEmpty():
        types = staged(found.select("item_id", F.coalesce("inner", "type").alias("type")), "types")
        found = types.select("item_id", "type", inner.alias("inner"))
    return types.select("item_id", F.get_json_object("type", "$.resolved_path.id").cast("bigint").alias("owner"))


def parents_of(members: DataFrame) -> DataFrame:
    """item_id and the highest of the items that list it."""
    return members.groupBy("item_id").agg(F.max("owner_item").alias("parent_item"))


def _as(index: DataFrame, item: str, node: str) -> DataFrame:
    """The index under other names, to be merged: its files are far smaller than its rows, so Spark would send all of it through the driver."""
    return index.select(F.col("item_id").alias(item), F.col("node").alias(node)).hint("merge")


def impl_edges(impls: DataFrame, members: DataFrame, index: DataFrame) -> DataFrame:
    """from_id, to_id, kind: the parent module contains the impl, its type defines it and implements its trait, and it defines its
    members. impls: item_id, impl_id, parent_item, self_item, trait_item; members: owner_item, item_id, kind."""
    ends = impls.join(_as(index, "parent_item", "parent"), "parent_item", "left").join(_as(index, "self_item", "self"), "self_item", "left").join(_as(index, "trait_item", "trait"), "trait_item", "left")
    edge = lambda a, b, kind: F.struct(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(kind).alias("kind"))
    own = ends.select(F.inline(F.array(edge("parent", "impl_id", "Contains"), edge("self", "impl_id", "Defines"), edge("self", "trait", "Implements")))).where("from_id is not null and to_id is not null")
    return own.unionByName(member_edges(impls.select(F.col("item_id").alias("owner_item"), F.col("impl_id").alias("owner")), members, index)).distinct()


def member_edges(owners: DataFrame, members: DataFrame, index: DataFrame, named: bool = True) -> DataFrame:
    """Owners (owner_item, owner) define their members: by the index, or else (named) by an id below the owner."""
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in MEMBER_PREFIX.items() for x in kv]), F.col("kind"))
    below = F.concat("owner", F.lit("::"), prefix, F.lit("-"), F.col("item_id").cast("string"))
    known = members.where(F.col("kind").isin(*MEMBER_PREFIX)).join(owners, "owner_item").join(index.select("item_id", "node"), "item_id", "left")
    to = F.coalesce("node", below) if named else F.col("node")
    return known.select(F.col("owner").alias("from_id"), to.alias("to_id"), F.lit("Defines").alias("kind")).where("to_id is not null")


def associated_ids(owned: DataFrame, index: DataFrame) -> DataFrame:
    """item_id and node of members (item_id, kind, name, owner: a node): ``owner::name`` goes to the lowest id if no item has it."""
    paths = owned.select("item_id", "kind", F.concat_ws("::", "owner", "name").alias("path")).distinct()
    free = paths.join(index.select(F.col("node").alias("path")), "path", "left_anti").groupBy("path").agg(F.min("item_id").alias("keeper"))
    found = paths.join(free, "path", "left")
    return found.select("item_id", F.when(F.col("item_id").eqNullSafe(F.col("keeper")), F.col("path")).otherwise(_suffixed(F.col("path"))).alias("node"))


def exported(uses: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """parent, name, node, is_glob of what uses (parent: a node, target_item, name, is_glob) bring in; globs bring the public children
    of their module, and those that its own globs bring."""
    named = uses.where("not is_glob").join(_as(index, "target_item", "node"), "target_item").select("parent", "name", "node", "is_glob")
    globs = uses.where("is_glob").join(_as(index, "target_item", "target"), "target_item").select(F.col("parent").alias("module"), "target")
    children = items.where("public").join(_as(index, "parent_item", "parent"), "parent_item").select("parent", F.col("item_id").alias("child"))
    found = glob_exports(globs, children).select(F.col("module").alias("parent"), F.col("id").alias("item_id"))
    brought = found.join(items.select("item_id", "name"), "item_id").join(_as(index, "item_id", "node"), "item_id")
    return named.unionByName(brought.select("parent", "name", "node", F.lit(True).alias("is_glob")))


def reexport_edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("parent").alias("from_id"), F.col("node").alias("to_id"), F.lit("ReExports").alias("kind"), "is_glob").distinct()


def alias_map(found: DataFrame) -> DataFrame:
    """alias and canonical: public paths that differ from the node's; those of single uses only if they are shorter. The smallest node wins."""
    public = found.select(F.concat_ws("::", "parent", "name").alias("alias"), F.col("node").alias("canonical"), "is_glob").where("alias <> canonical")
    shorter = F.size(S.segments(F.col("alias"))) < F.size(S.segments(F.col("canonical")))
    return public.where(F.col("is_glob") | shorter).groupBy("alias").agg(F.min("canonical").alias("canonical"))


def derive_edges(derives: DataFrame, traits: DataFrame) -> DataFrame:
    """derives (owner, name) to traits (node, name): a full path goes to its trait, a short name only if a single trait has it."""
    short = traits.groupBy("name").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").select("name", "node")
    lookup = short.unionByName(traits.select(F.col("node").alias("name"), "node").distinct())
    return derives.join(lookup, "name").select(F.col("owner").alias("from_id"), F.col("node").alias("to_id"), F.lit("Derives").alias("kind"), F.lit("Inferred").alias("confidence")).distinct()


def doc_links(links: DataFrame, index: DataFrame, inverse: DataFrame) -> DataFrame:
    """package, item_id, text and target of links (package, item_id, text, target_item): the node's shortest alias, else the node; null if
    the id resolves to nothing. inverse: canonical, alias."""
    found = links.join(_as(index, "target_item", "canonical"), "target_item", "left").join(inverse, "canonical", "left")
    return found.select("package", "item_id", "text", F.coalesce("alias", "canonical").alias("target"))


def link_stats(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("package").agg(F.count("*").alias("raw"), F.count("target").alias("resolved"), F.count_if(F.col("target").isNull()).alias("unresolved"))


def trait_method_sets(members: DataFrame) -> DataFrame:
    """owner_item with the sorted names of its required and its defaulted functions; null where there are none."""
    names = lambda rows: F.sort_array(F.collect_list(F.when(rows, F.col("name"))))
    sets = members.where("kind = 'Function' and name is not null").groupBy("owner_item").agg(names(~F.col("has_body")).alias("required"), names(F.col("has_body")).alias("defaulted"))
    return sets.select("owner_item", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("required", "defaulted")])


def renamed(paths: DataFrame, actual: str, wanted: str) -> DataFrame:
    """paths (path: an array) whose first segment is the document's own name take the package's."""
    first = F.get("path", F.lit(0)) == actual
    return paths.withColumn("path", F.when(first, F.concat(F.array(F.lit(wanted)), F.slice("path", F.lit(2), F.size("path")))).otherwise(F.col("path")))


def outcome_class(error: Column, suspicious: Column) -> Column:
    """What a document's error means: the parser's own are permanent, the surroundings' transient; suspicious graphs are put aside."""
    permanent = error.isin("json", "format", "shape", "deserialize", "structure", "graph")
    return F.when(permanent, "permanent").when(error.isNotNull(), "transient").when(suspicious, "quarantine").otherwise("accepted")


def publish_decision(documents: DataFrame, freshness: DataFrame, force: bool = False) -> DataFrame:
    """documents (name, version, revision, graph_hash, outcome) with decision: what isn't accepted keeps its outcome; a record of the same
    version and revision is fresh, one with the same hash unchanged; all else is published."""
    f = freshness.select("name", "version", F.col("revision").alias("f_revision"), F.col("graph_hash").alias("f_hash"))
    same = F.col("f_hash").isNotNull() & ~F.lit(force)
    decision = F.when(F.col("outcome") != "accepted", F.col("outcome")).when(same & (F.col("revision") == F.col("f_revision")) & (F.col("graph_hash") == F.col("f_hash")), "fresh").when(same & (F.col("graph_hash") == F.col("f_hash")), "unchanged").otherwise("publish")
    return documents.join(f, ["name", "version"], "left").select("name", "version", decision.alias("decision"))
