"""Joins over nodes, edges (from_id, to_id, kind, confidence, is_glob, edge_seq) and aliases (alias, canonical)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.fixed import SEMANTIC, STRUCTURAL
from weftline.functions import scalars as S
from weftline.operators.filters import is_local_page
from weftline.operators.sieve import sieve, sifted
from weftline.shared import parts, staged

EDGE = ["from_id", "to_id", "kind", "confidence", "is_glob", "edge_seq"]


def endpoint_prune(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges["from_id"] == ids["id"], "left_semi").join(ids, F.col("to_id") == ids["id"], "left_semi")


def missing_stubs(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes for ends that no table has but the path index (id, kind) knows, and for their packages."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    found = ends.join(nodes.select("id"), "id", "left_anti").join(paths.select("id", "kind"), "id")
    packages = found.select(S.package_of(F.col("id")).alias("id"), F.lit("Crate").alias("kind")).distinct().join(nodes.select("id"), "id", "left_anti")
    return found.unionByName(packages).select("id", S.last_segment(F.col("id")).alias("name"), "kind", F.lit(True).alias("is_external")).dropDuplicates(["id"])


def structural_edges(nodes: DataFrame) -> DataFrame:
    """Parent path to node: Contains below packages, modules and unknown parents, else Defines."""
    child = nodes.select("id", S.parent_id(F.col("id")).alias("parent")).where("parent is not null and parent <> id")
    above = nodes.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"))
    kind = F.when(F.coalesce("parent_kind", F.lit("Module")).isin("Crate", "Module"), "Contains").otherwise("Defines")
    return child.join(above, "parent", "left").select(F.col("parent").alias("from_id"), F.col("id").alias("to_id"), kind.alias("kind"))


def placeholder_modules(nodes: DataFrame) -> DataFrame:
    """Proper prefixes of ids that are no node, up to the first that is a node but no module or package."""
    steps = nodes.select("id", F.posexplode(S.prefixes(F.col("id"))).alias("pos", "prefix"))
    known = nodes.select(F.col("id").alias("prefix"), F.col("kind").alias("prefix_kind"))
    joined = steps.join(known, "prefix", "left")
    stop = joined.where("prefix_kind not in ('Crate', 'Module')").groupBy("id").agg(F.min("pos").alias("stop"))
    open_ = joined.where("prefix_kind is null").join(stop, "id", "left").where("stop is null or pos < stop")
    return open_.select(F.col("prefix").alias("id")).distinct().select("id", S.last_segment(F.col("id")).alias("name"), F.lit("Module").alias("kind"))


def tree_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """parent, child, edge_seq: structural edges, without those from impls; an impl's local page members stand for it under the
    owner that defines it. Structural edges are made once; each join deals its rows by the size of the input."""
    n = parts(nodes, edges)
    structural = staged(edges.where(F.col("kind").isin(*STRUCTURAL)).select("from_id", "to_id", "kind", "edge_seq"), "structural")
    impls = nodes.select("id", F.coalesce(F.col("kind") == "Impl", F.lit(False)).alias("is_impl")).repartition(n, "id")  # for both ends
    end = lambda rows, name: rows.repartition(n, name).join(impls, F.col(name) == F.col("id"), "left").withColumn("is_impl", F.coalesce("is_impl", F.lit(False))).drop("id")
    s = end(end(structural, "from_id").where("not is_impl").drop("is_impl"), "to_id")
    direct = s.where("not is_impl").select(F.col("from_id").alias("parent"), F.col("to_id").alias("child"), "edge_seq")
    owners = s.where("is_impl and kind = 'Defines'").select(F.col("from_id").alias("parent"), F.col("to_id").alias("impl"), "edge_seq").repartition(n, "impl")
    pages = nodes.where(is_local_page()).select(F.col("id").alias("to_id")).repartition(n, "to_id")
    inside = structural.join(pages, "to_id", "left_semi").select(F.col("from_id").alias("impl"), F.col("to_id").alias("child"))
    return direct.unionByName(owners.join(inside, "impl").select("parent", "child", "edge_seq")).groupBy("parent", "child").agg(F.min("edge_seq").alias("edge_seq"))


def first_parents(relations: DataFrame) -> DataFrame:
    """child and parent: the first edge decides, equal ones by the smaller parent."""
    return relations.groupBy("child").agg(F.min(F.struct("edge_seq", "parent"))["parent"].alias("parent"))


def tree_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Local pages under each parent with has_children."""
    relations = staged(tree_relations(nodes, edges), "relations")  # used twice below
    pages = nodes.where(is_local_page()).select(F.col("id").alias("child"), "name", F.col("kind").alias("child_kind"))
    local = relations.join(pages, "child")
    parents = local.select(F.col("parent").alias("child")).distinct().withColumn("has", F.lit(True))
    return local.join(parents, "child", "left").select("parent", "child", "name", F.col("child_kind").alias("kind"), F.coalesce("has", F.lit(False)).alias("has_children"))


def alias_tree_nodes(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that become tree nodes: their canonical node is a page, no node has their id, their parent is a node or an alias."""
    pages = nodes.where(is_local_page()).select(F.col("id").alias("canonical"), "name", "kind")
    parents = nodes.select(F.col("id").alias("parent")).union(aliases.select("alias")).distinct()
    found = aliases.join(nodes.select(F.col("id").alias("alias")), "alias", "left_anti").join(pages, "canonical").withColumn("parent", S.parent_id(F.col("alias")))
    return found.join(parents, "parent", "left_semi").select(F.col("alias").alias("id"), "canonical", "parent", "name", "kind")


def project_reexports(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Re-export edges to a canonical node go to its aliases under the same parent, if it has any."""
    under = aliases.select(S.parent_id(F.col("alias")).alias("from_id"), F.col("canonical").alias("to_id"), "alias")
    e = edges.where(F.col("kind") == "ReExports").join(under, ["from_id", "to_id"], "left")
    return e.select("from_id", F.coalesce("alias", "to_id").alias("to_id"), "kind")


def sides(edges: DataFrame, *more: str) -> DataFrame:
    """page, other, incoming, kind and further columns: each edge once for each of its ends, a loop once. One end travels as the page, so no
    id is carried twice."""
    side = lambda end, other, incoming: F.struct(F.col(end).alias("page"), F.col(other).alias("other"), F.lit(incoming).alias("incoming"))
    both = F.array(side("from_id", "to_id", False), side("to_id", "from_id", True))
    once = F.when(F.col("from_id") == F.col("to_id"), F.slice(both, 1, 1)).otherwise(both)
    return edges.select("kind", *more, F.explode(once).alias("s")).select("s.*", "kind", *more)


def ends_of(rows: DataFrame, *more: str) -> DataFrame:
    """page, from_id, to_id, kind of rows of ``sides``."""
    from_id, to_id = F.when(F.col("incoming"), F.col("other")).otherwise(F.col("page")), F.when(F.col("incoming"), F.col("page")).otherwise(F.col("other"))
    return rows.select("page", from_id.alias("from_id"), to_id.alias("to_id"), "kind", *more)


def apart(rows: DataFrame, *more: str) -> DataFrame:
    """Edges (page, from_id, to_id, kind) that don't touch their page, each once: none of them is among the page's own."""
    return rows.where("not (page <=> from_id or page <=> to_id)").select("page", "from_id", "to_id", "kind", *more).distinct()


def local_pages(nodes: DataFrame, **more: Column) -> DataFrame:
    """page (and further columns, made once for each page) of the local pages, each once."""
    found = nodes.where(is_local_page()).select(F.col("id").alias("page")).where("page is not null").distinct()
    return staged(found.select("page", *[c.alias(name) for name, c in more.items()]), "pages")


def of_pages(rows: DataFrame, pages: DataFrame, through: DataFrame) -> DataFrame:
    """rows of these pages, with the pages' further columns. Most others are dropped before rows are shuffled; ids pack well, so Spark takes the
    table for smaller than it is and a merge is asked for."""
    return sifted(rows, "page", through).join(pages.hint("merge"), "page", "inner")


def own_edges(nodes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """page, from_id, to_id, kind and further columns of the edges that touch each local page. Edges are made once; rows are dealt by page
    and once alone, so what is grouped by page needs no further shuffle."""
    pages = local_pages(nodes)
    e = staged(edges.select("from_id", "to_id", "kind", *more), "page_edges")
    own = of_pages(sides(e, *more), pages, sieve(pages, "page"))
    return ends_of(own if more else own.distinct(), *more)


def page_parts(nodes: DataFrame, edges: DataFrame, **more: Column) -> tuple[DataFrame, DataFrame]:
    """What the edges of pages are made of, each part written: page, other, incoming, kind of those that touch the page, and page, from_id, to_id,
    kind of structural ones that leave what it defines or contains and don't touch it. more: columns of a page that its rows carry."""
    return page_parts_of(nodes, staged(edges.select("from_id", "to_id", "kind"), "page_edges"), **more)


def page_parts_of(nodes: DataFrame, edges: DataFrame, **more: Column) -> tuple[DataFrame, DataFrame]:
    """The same of edges that are written already."""
    pages = local_pages(nodes, **more)
    own = staged(of_pages(sides(edges), pages, sieve(pages, "page")).distinct(), "own")
    step = edges.where(F.col("kind").isin(*STRUCTURAL))
    held = own.where(F.col("kind").isin(*STRUCTURAL) & ~F.col("incoming")).select("page", *more, F.col("other").alias("held"))
    return own, staged(apart(held.join(step.select("from_id", "to_id", "kind").hint("merge"), F.col("held") == F.col("from_id")), *more), "apart")


def page_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each local page: its own, both ways, and structural ones that leave what it defines or contains. Edges are made once; what
    touches a page is among its own, so the two parts are made distinct apart."""
    own, rest = page_parts(nodes, edges)
    return ends_of(own).unionByName(rest)


def related_ends(own: DataFrame, rest: DataFrame, *more: str) -> DataFrame:
    """page and id of the other ends of its edges, each once, dealt by id. own, rest: ``page_parts``; what ``rest`` leaves is an other end in ``own``."""
    pairs = own.select("page", F.col("other").alias("id"), *more).where("id <> page").unionByName(rest.select("page", F.col("to_id").alias("id"), *more).where("id is not null"))
    return pairs.repartition(parts(own, rest), "id").distinct()


def related_nodes(related: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """page and those of its other ends (page, id) that are nodes."""
    return related.join(nodes.select("id", "kind", "is_external"), "id").select("page", "id", "kind", "is_external", *more)


def related_by_alias(ends: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """page and its other ends (page, id), where an end may be an alias: it keeps that name and has the kind of what it stands for.
    An alias goes before a node of the same id."""
    named = ends.join(aliases.select(F.col("alias").alias("id"), "canonical"), "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))
    return named.join(nodes.select(F.col("id").alias("canonical"), "kind", "is_external"), "canonical").select("page", "id", "canonical", "kind", "is_external")


def cross_package_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"from_package": S.package_of(F.col("from_id")), "to_package": S.package_of(F.col("to_id"))}).where("from_package <> to_package")


def detail_union(local: DataFrame, cross: DataFrame) -> DataFrame:
    """Local edges and those cross edges that aren't there yet."""
    key = ["from_id", "to_id", "kind", "confidence", "is_glob"]
    return local.select(*key).unionByName(cross.select(*key)).distinct()


def longest_alias(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """id rewritten through its longest aliased prefix: every prefix is an equi-join key."""
    inverse = inverse_aliases(aliases)
    steps = ids.select("id", F.posexplode(S.prefixes(F.col("id"), proper=False)).alias("pos", "canonical"))
    best = steps.join(inverse, "canonical").groupBy("id").agg(F.max_by(F.struct("alias", "canonical"), "pos").alias("m"))
    return best.select("id", F.concat(F.col("m.alias"), F.substring(F.col("id"), F.length("m.canonical") + 1, F.length("id"))).alias("public_id"))


def inverse_aliases(aliases: DataFrame) -> DataFrame:
    """canonical and its shortest alias, the smaller of equals."""
    return aliases.groupBy("canonical").agg(F.min(F.struct(F.length("alias").alias("n"), "alias"))["alias"].alias("alias"))


def containing_modules(nodes: DataFrame) -> DataFrame:
    """id and the longest proper prefix that is a module or package."""
    modules = nodes.where(F.col("kind").isin("Crate", "Module")).select(F.col("id").alias("module"))
    steps = nodes.select("id", F.posexplode(S.prefixes(F.col("id"))).alias("pos", "module"))
    return steps.join(modules, "module").groupBy("id").agg(F.max_by("module", "pos").alias("module"))


def suffix_resolve(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """suffix, matches and the id if it is the only one that ends in the suffix."""
    table = nodes.select("id", F.explode(S.suffixes(F.col("id"))).alias("suffix"))
    return wanted.select("suffix").distinct().join(table, "suffix").groupBy("suffix").agg(F.count("*").alias("matches"), F.when(F.count("*") == 1, F.min("id")).alias("id"))


def shallowest_by_suffix(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(package, suffix) to the node of the package with the fewest segments, none of them an impl's."""
    table = nodes.where(~F.col("id").contains("::impl-")).select("id", S.package_of(F.col("id")).alias("package"), F.explode(S.suffixes(F.col("id"))).alias("suffix"))
    best = F.min(F.struct(F.size(S.segments(F.col("id"))).alias("n"), "id"))["id"].alias("id")
    return wanted.select("package", "suffix").distinct().join(table, ["package", "suffix"]).groupBy("package", "suffix").agg(best)


def exists(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("id").distinct().withColumn("known", F.lit(True))
    return ids.join(known, "id", "left").select("id", F.col("known").isNotNull().alias("found"))


def alias_fallback(wanted: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted id, and the node it names itself or as an alias."""
    own = nodes.select("id", "kind")
    through = aliases.join(own.withColumnRenamed("id", "canonical").withColumnRenamed("kind", "alias_kind"), "canonical").select(F.col("alias").alias("id"), "canonical", "alias_kind")
    joined = wanted.join(own, "id", "left").join(through, "id", "left")
    return joined.select("id", F.when(F.col("kind").isNotNull(), F.col("id")).otherwise(F.col("canonical")).alias("node_id"), F.coalesce("kind", "alias_kind").alias("kind"))


def where_used(page_edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Semantic edges into pages that are neither packages nor modules."""
    pages = nodes.where(~F.col("kind").isin("Crate", "Module")).select(F.col("id").alias("page"))
    return page_edges_.where((F.col("to_id") == F.col("page")) & F.col("kind").isin(*SEMANTIC)).join(pages, "page").select("page", F.col("from_id").alias("user"), "kind")


def trait_documentation(members: DataFrame, trait_members: DataFrame) -> DataFrame:
    """Members (id, trait, kind, name, docs) take the docs of their trait's member of the same kind and name if they have none."""
    t = trait_members.select("trait", "kind", "name", F.col("docs").alias("trait_docs"))
    return members.join(t, ["trait", "kind", "name"], "left").select("id", "trait", "kind", "name", F.coalesce("docs", "trait_docs").alias("docs"))


def provided_methods(members: DataFrame, trait_members: DataFrame, impls: DataFrame) -> DataFrame:
    """Provided trait members that an impl (impl, trait) doesn't have itself."""
    offered = impls.join(trait_members.where("provided"), "trait").select("impl", "trait", "kind", "name")
    return offered.join(members.select("impl", "kind", "name"), ["impl", "kind", "name"], "left_anti")
