"""Recursive operations as rounds of joins. Every round is a written table; the driver only asks whether it has rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.fixed import MAX_DEPTH, STRUCTURAL
from weftline.operators.filters import is_local_page
from weftline.shared import parts, staged


def ancestors(parents: DataFrame, deepest: int = MAX_DEPTH, of: DataFrame | None = None) -> DataFrame:
    """node, ancestor, depth for the chain of parents (child, parent) of every child, or of those asked for (of: id), up to ``deepest`` steps; a
    chain that comes back to its node stops there."""
    parents = staged(parents.select("child", "parent"), "parents")  # every round reads it
    step = parents.select(F.col("child").alias("ancestor"), F.col("parent").alias("above"))
    first = parents.where("child <> parent")
    first = first.join(of.select(F.col("id").alias("child")), "child", "left_semi") if of is not None else first
    level = staged(first.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "level")
    levels = [level]
    while len(levels) < deepest and not level.isEmpty():
        level = staged(level.join(step, "ancestor").where("above <> node and above <> ancestor").select("node", F.col("above").alias("ancestor"), (F.col("depth") + 1).alias("depth")), "level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Local pages without a parent that is a local page."""
    pages = nodes.where(is_local_page()).select("package", "id", "name", "kind")
    inside = parents.join(pages.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id"))
    return pages.join(inside, "id", "left_anti")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, id, distance within so many undirected steps, for all seeds at once."""
    e = staged(edges.select("from_id", "to_id"), "edges")  # every hop reads it twice; what it finds is made distinct
    both = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("next")).union(e.select("to_id", "from_id"))
    seen = frontier = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance"))
    for k in range(1, hops + 1):
        found = frontier.join(both, "id").select("seed", F.col("next").alias("id")).distinct()
        frontier = staged(found.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(k)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def nearest_modules(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and its owner: itself if a module or package, else the first on its chain of parents, else the package's root. Chains
    are halved each round by pointer jumping, so as many rounds as the number of nodes has bits end any chain but a circle; what has arrived leaves
    the rows that move, so rounds join ever fewer."""
    n = parts(nodes, parents)
    kinds = nodes.select("id", "package", F.col("kind").isin("Crate", "Module").alias("is_module")).repartition(n, "id")
    chain = staged(kinds.join(parents.select(F.col("child").alias("id"), "parent"), "id", "left"), "chain")
    done = chain.where("is_module or parent is null").select("id", F.when(F.col("is_module"), F.col("id")).otherwise(F.col("package")).alias("module"))
    moving = chain.where("not is_module and parent is not null").select("id", "package", F.col("parent").alias("at"))
    for _ in range(moving.count().bit_length() + 1):
        known = staged(moving.repartition(n, "at").join(done.select(F.col("id").alias("at"), "module"), "at", "left"), "owners")
        left = known.where("module is null")
        done = done.unionByName(known.where("module is not null").select("id", "module"))
        if left.isEmpty():
            return done
        jump = left.select(F.col("id").alias("at"), F.col("at").alias("next"))
        ahead = staged(left.drop("module").join(jump.unionByName(known.where("module is not null").select(F.col("id").alias("at"), F.col("module").alias("next"))), "at", "left"), "moving")
        done = done.unionByName(ahead.where("next is null").select("id", F.col("package").alias("module")))  # above is no node
        moving = ahead.where("next is not null").select("id", "package", F.col("next").alias("at"))
    return done.unionByName(moving.select("id", F.col("package").alias("module")))  # a circle


def module_depths(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """Modules and packages and how many of those stand above them."""
    modules = nodes.where(F.col("kind").isin("Crate", "Module")).select(F.col("id").alias("module"))
    above = closure.join(modules.select(F.col("module").alias("ancestor")), "ancestor").groupBy(F.col("node").alias("module")).agg(F.count("*").alias("depth"))
    return modules.join(above, "module", "left").select("module", F.coalesce("depth", F.lit(0)).alias("depth"))


def subtree_totals(counts: DataFrame, closure: DataFrame) -> DataFrame:
    """module and the direct counts of it and all below it (counts: module, direct)."""
    up = closure.select(F.col("node").alias("module"), F.col("ancestor").alias("over"))
    spread = counts.join(up, "module").select(F.col("over").alias("module"), "direct").union(counts.select("module", "direct"))
    return spread.groupBy("module").agg(F.sum("direct").alias("total")).join(counts.select("module"), "module", "left_semi")


def reachable_edges(relations: DataFrame, parents: DataFrame, package_nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Tree relations whose both ends reach a package node by first parents."""
    packages = package_nodes.select(F.col("id").alias("ancestor"))
    fine = closure.join(packages, "ancestor", "left_semi").select(F.col("node").alias("id")).union(packages.select("ancestor")).distinct()
    return relations.join(fine.withColumnRenamed("id", "parent"), "parent", "left_semi").join(fine.withColumnRenamed("id", "child"), "child", "left_semi")


def matching_with_ancestors(matches: DataFrame, closure: DataFrame) -> DataFrame:
    """Ids that match, and everything above them."""
    up = closure.join(matches.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("ancestor").alias("id"))
    return matches.select("id").union(up).distinct()


def glob_exports(globs: DataFrame, children: DataFrame) -> DataFrame:
    """module and the public children that its glob edges (module, target) reach, through further globs."""
    seen = frontier = staged(globs.select("module", "target").distinct(), "globs")
    step = globs.select(F.col("module").alias("target"), F.col("target").alias("next"))
    while not frontier.isEmpty():
        found = frontier.join(step, "target").select("module", F.col("next").alias("target")).distinct()
        frontier = staged(found.join(seen, ["module", "target"], "left_anti"), "globs")
        seen = seen.unionByName(frontier)
    return seen.join(children.select(F.col("parent").alias("target"), F.col("child").alias("id")), "target").select("module", "id").distinct()


def structural_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural edges between nodes that aren't external."""
    inside = nodes.where(~F.col("is_external")).select("id")
    e = edges.where(F.col("kind").isin(*STRUCTURAL))
    return e.join(inside, e["from_id"] == inside["id"], "left_semi").join(inside, F.col("to_id") == inside["id"], "left_semi").select("from_id", "to_id", "kind")
