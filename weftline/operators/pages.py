"""What a page lists: direct items, kinds of impls, members of traits; its root, and the modules that a map keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators.graph import ends_of, local_pages, of_pages, sides
from weftline.operators.sieve import sieve, sifted, unsifted
from weftline.shared import parts, staged

#: Kinds that a package or module page lists itself.
DIRECT_KINDS = ("Module", "Struct", "Union", "Enum", "Trait", "TraitAlias", "Function", "TypeAlias", "Constant", "Static", "Macro", "ProcMacro")
ASSOCIATED = ("AssocType", "AssocConst", "Constant", "TypeAlias")


def direct_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """page and id of what package and module pages list: local nodes of the kinds listed, public ones alone on a package's page, no module
    of the page's own name, each once."""
    pages = nodes.where("kind in ('Crate', 'Module')").select(F.col("id").alias("page"), F.col("kind").alias("page_kind"), F.col("name").alias("page_name"))
    targets = nodes.where(~F.col("is_external") & F.col("kind").isin(*DIRECT_KINDS)).select("id", "name", F.col("kind").alias("item_kind"), "visibility")
    e = edges.where("kind in ('Contains', 'Defines', 'ReExports')").select(F.col("from_id").alias("page"), F.col("to_id").alias("id")).distinct()
    found = e.join(pages, "page").join(targets, "id")
    fine = ((F.col("page_kind") != "Crate") | (F.col("visibility") == "Public")) & ~((F.col("item_kind") == "Module") & (F.col("name") == F.col("page_name")))
    return found.where(fine).select("page", "id", F.col("item_kind").alias("kind"), S.kind_order(F.col("item_kind")).alias("place"), "name")


def impl_class(kind: Column, impl_type: Column, category: Column, name: Column) -> Column:
    """trait, inherent, or null for what is no impl."""
    trait = F.coalesce(impl_type == "Trait", F.lit(False)) | F.coalesce(category.isin("Trait", "Blanket", "Negative", "Synthetic"), F.lit(False)) | name.contains(" for ")
    return F.when(kind == "Impl", F.when(trait, "trait").otherwise("inherent"))


def trait_items(nodes: DataFrame, edges: DataFrame, required: DataFrame) -> DataFrame:
    """trait, id and part (required, provided, associated) of the members that traits define. required: trait, name."""
    traits = nodes.where("kind = 'Trait'").select(F.col("id").alias("trait"))
    members = nodes.select("id", "name", F.col("kind").alias("member_kind"))
    e = edges.where("kind in ('Contains', 'Defines')").select(F.col("from_id").alias("trait"), F.col("to_id").alias("id")).distinct()
    found = e.join(traits, "trait", "left_semi").join(members, "id").join(required.select("trait", "name", F.lit(True).alias("needed")), ["trait", "name"], "left")
    part = F.when(F.col("member_kind") == "Function", F.when(F.col("needed"), "required").otherwise("provided")).when(F.col("member_kind").isin(*ASSOCIATED), "associated")
    return found.select("trait", "id", "name", part.alias("part")).where("part is not null")


def root_choice(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (package, name) to its root: the package node of exactly that name, else of the name in its usual form, else the first package
    node, else the first node; none of them external."""
    inside = nodes.where(~F.col("is_external")).select("package", "id", "kind", "node_seq").join(wanted, "package")
    usual, package = S.normal_name(F.col("name")), F.col("kind") == "Crate"
    rule = F.when(package & (F.col("id") == usual), 0).when(package & (S.normal_name(F.col("id")) == usual), 1).when(package, 2).otherwise(3)
    return inside.groupBy("package", "name").agg(F.min_by("id", F.struct(rule, "node_seq")).alias("root"))


def hierarchy_cap(modules: DataFrame, roots: DataFrame, closure: DataFrame, most: int) -> DataFrame:
    """Of each package its root, the first ``most`` - 1 other modules by total (falling), depth and name, and all above them. modules: package, id, total,
    depth, name; roots: package, root; closure: node, ancestor. The ranking is limited in each task before a package's modules come together."""
    place = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("total"), "depth", "name", "id"))
    others = modules.join(roots.select(F.col("root").alias("id")), "id", "left_anti").withColumn("place", place).where(F.col("place") <= most - 1)
    kept = others.select("package", "id").unionByName(roots.select("package", F.col("root").alias("id")))
    above = kept.join(closure.select(F.col("node").alias("id"), "ancestor"), "id").select("package", F.col("ancestor").alias("id"))
    return kept.unionByName(above).distinct()


def touched(edges: DataFrame) -> DataFrame:
    """The distinct ends of new cross edges."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


def corpus(snapshot: DataFrame, choice: str, listed: DataFrame | None = None) -> DataFrame:
    """Names by choice: all, top:N (by download_rank), or those of a list (catalog or file: name)."""
    if choice.startswith("top:"):
        return snapshot.where(F.col("download_rank") <= int(choice[4:])).select("name")
    return snapshot.select("name") if choice == "all" else listed.select("name").distinct()


def nodes_with_aliases(nodes: DataFrame, alias_nodes: DataFrame) -> DataFrame:
    """The surface of a tree: pages and the aliases that are nodes of it."""
    return nodes.select("id", "name", "kind", F.lit(None).cast("string").alias("canonical")).unionByName(alias_nodes.select("id", "name", "kind", "canonical"))


#: Kinds whose pages also show what their impls hold.
TYPE_KINDS = ("Struct", "Enum", "Union", "Trait", "TraitAlias", "TypeAlias")


def local_page_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each local page (page), and for types all edges of what they define. An edge comes twice to a type only if it defines both ends, so
    rows whose other end no type defines (by a sieve, so a few others too) aren't shuffled to be made distinct."""
    pages = local_pages(nodes)
    e = staged(edges.select("from_id", "to_id", "kind"), "page_edges")
    own = staged(of_pages(sides(e), pages, sieve(pages, "page")).distinct(), "own")
    types = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("page")).distinct()
    defined = own.where((F.col("kind") == "Defines") & ~F.col("incoming") & F.col("other").isNotNull())
    impls = staged(defined.join(types.hint("merge"), "page", "left_semi").select("page", F.col("other").alias("end")), "impls")
    through = sieve(impls, "end")
    inside = sifted(sides(e).withColumnRenamed("page", "end"), "end", through).distinct().join(impls.hint("merge"), "end")
    found = staged(inside.where("not (page <=> end or page <=> other)").select("page", "end", "other", "incoming", "kind"), "inside")
    ends = lambda rows: ends_of(rows.withColumnsRenamed({"page": "of", "end": "page"}), "of").select(F.col("of").alias("page"), "from_id", "to_id", "kind")
    twice = sifted(found, "other", through)
    once = unsifted(found, "other", through)
    return ends_of(own).unionByName(ends(once)).unionByName(ends(twice).distinct())


def cross_edge_data(cross: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id with its cross edges, both ways, and the other end's name and kind; a made-up one where the index doesn't know it. Each end is looked up
    before an edge becomes two rows; of an id with several rows in the index the first stands for the id, and all for the other end."""
    n = parts(cross, nodes, ids)
    first = F.row_number().over(Window.partitionBy("id").orderBy("name", "kind"))
    known = nodes.select("id", "name", "kind").repartition(n, "id").withColumn("first", first == 1)
    there = ids.select("id").repartition(n, "id").distinct().withColumn("there", F.lit(True))

    def end(rows: DataFrame, name: str) -> DataFrame:
        dealt = rows.repartition(n, f"{name}_id")
        columns = lambda df: df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
        return dealt.join(columns(there).hint("merge"), f"{name}_id", "left").join(columns(known).hint("merge"), f"{name}_id", "left")

    rows = end(end(cross.select("from_id", "to_id", "kind"), "from"), "to")

    def side(own: str, other: str) -> Column:
        shown = F.coalesce(f"{own}_there", F.lit(False)) & F.coalesce(f"{own}_first", F.lit(True))
        name = F.coalesce(f"{other}_name", S.last_segment(F.col(f"{other}_id")))
        return F.when(shown, F.struct(F.col(f"{own}_id").alias("id"), F.col(f"{other}_id").alias("other"), name.alias("name"), F.coalesce(f"{other}_kind", F.lit("ExternCrate")).alias("other_kind")))

    loop = F.col("from_id") == F.col("to_id")
    both = F.filter(F.array(side("from", "to"), F.when(~F.coalesce(loop, F.lit(False)), side("to", "from"))), lambda s: s.isNotNull())
    return rows.select("from_id", "to_id", "kind", F.explode(both).alias("s")).select("s.id", "from_id", "to_id", "kind", "s.other", "s.name", "s.other_kind")


def trait_views(impls: DataFrame, packages: DataFrame) -> DataFrame:
    """page (of a package) with the traits of its trait impls whose pages are fetched: those of the same package at its version, those of
    standard packages (packages: package, is_std) at ``latest``; others are passed over. impls: page, package, version, trait."""
    own = S.package_of(F.col("trait"))
    asked = impls.where("trait <> ''").select("page", "package", "version", "trait", own.alias("trait_package")).distinct()
    std = packages.where("is_std").select(F.col("package").alias("trait_package"), F.lit(True).alias("std"))
    same = S.normal_name(F.col("trait_package")) == S.normal_name(F.col("package"))
    found = asked.join(std, "trait_package", "left").where(same | F.col("std"))
    return found.select("page", "trait", "trait_package", F.when(same, F.col("version")).otherwise("latest").alias("version"))


def detail_counts(page_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """page with its impls, the functions that those define, and what it holds itself."""
    kinds = nodes.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    held = page_edges.where("kind in ('Contains', 'Defines')").join(kinds, "to_id")
    own = F.col("from_id") == F.col("page")
    return held.groupBy("page").agg(F.count_if(own & (F.col("to_kind") == "Impl")).alias("impls"), F.count_if(~own & (F.col("from_id") != F.col("page")) & (F.col("to_kind") == "Function")).alias("methods"), F.count_if(own & (F.col("to_kind") != "Impl")).alias("contents"))


def catalog_order(entries: DataFrame) -> DataFrame:
    """Third-party packages first, standard ones last, each in their own order."""
    return entries.orderBy("is_std", "seq")


def prefix_search(store: DataFrame, query: str, limit: int = 64) -> DataFrame:
    """Nodes of the buckets (prefix) that a query can be in, whose names hold it; at most ``limit``. Only those buckets are read."""
    prefix = S.query_prefix(F.lit(query))
    return store.where(F.col("prefix").startswith(prefix)).where(F.lower("name").contains(query.lower())).orderBy("id").limit(limit)
