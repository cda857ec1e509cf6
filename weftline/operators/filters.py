"""Projections, filters and predicates over nodes (id, name, kind, is_external, parent_impl, ...) and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.fixed import SEMANTIC, STRUCTURAL, WAITING_STEPS


def is_local_page() -> Column:
    """Not external, not an impl, not a member inside an impl."""
    return ~F.col("is_external") & (F.col("kind") != "Impl") & ~(F.col("parent_impl").isNotNull() & F.col("id").contains("::impl-"))


def summaries(nodes: DataFrame, impl_fields_always: bool = True) -> DataFrame:
    impl = F.col("parent_impl") if impl_fields_always else F.when(F.col("kind") == "Impl", F.col("parent_impl"))
    return nodes.select("package", "id", "name", "kind", "visibility", "is_external", impl.alias("parent_impl"))


def edges_of(edges: DataFrame, structural: bool, semantic: bool) -> DataFrame:
    """Structural and semantic edges, each if asked for; unknown kinds always."""
    return edges.where(F.when(F.col("kind").isin(*STRUCTURAL), structural).when(F.col("kind").isin(*SEMANTIC), semantic).otherwise(True))


def is_internal_path(path: Column) -> Column:
    return F.exists(path, lambda s: (s == "_") | s.startswith("__")) | (F.size(path) == 0)


def matching(nodes: DataFrame, text: str, kinds: list[str] | None = None) -> DataFrame:
    hit = F.lower("name").contains(text.lower()) | F.lower("id").contains(text.lower())
    return nodes.where(hit & F.col("kind").isin(*kinds) if kinds else hit)


def shown(nodes: DataFrame, selected: str | None, traits: bool, details: bool) -> DataFrame:
    """Hide trait-like nodes and details unless asked for; never the selected node."""
    hidden = F.lit(False)
    if not traits:
        hidden = hidden | F.col("kind").isin("Trait", "TraitAlias")
    if not details:
        hidden = hidden | F.col("kind").isin("Impl", "Field", "Variant", "AssocType", "AssocConst")
    return nodes.where(~hidden | F.col("id").eqNullSafe(F.lit(selected)))


def impl_category(synthetic: Column, negative: Column, blanket: Column, trait: Column) -> Column:
    return F.when(synthetic, "synthetic").when(negative, "negative").when(blanket, "blanket").when(trait.isNotNull(), "trait").otherwise("inherent")


def uses_capacity(status: Column, step: Column) -> Column:
    return (status == "processing") & ~F.coalesce(step.isin(*WAITING_STEPS), F.lit(False))


def members_only(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes whose package is a member (a table with ``package``)."""
    return nodes.join(members.select("package"), "package", "left_semi")
