"""Rankings, caps and searches: windows and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.fixed import CHANNELS
from weftline.functions import scalars as S
from weftline.shared import staged


def download_rank(packages: DataFrame) -> DataFrame:
    """rank by downloads, then name. Global, but not in one task: ranks inside ranges, and the sizes of the ranges before."""
    order = [F.desc("downloads"), F.asc("name")]
    spread = staged(packages.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return spread.withColumn("place", inside).join(F.broadcast(base), "part").withColumn("rank", (F.col("place") + F.col("base")).cast("int")).drop("part", "place", "base")


def newest_versions(versions: DataFrame, include_pre: bool = False) -> DataFrame:
    """By package: the newest version that isn't yanked, and when it was made."""
    key = S.newest_key(F.col("num"), include_pre)
    best = F.max(F.when(~F.col("yanked"), F.struct(key.alias("key"), "created_at", "num")))
    return versions.groupBy("package_id").agg(best.alias("b")).select("package_id", F.col("b.num").alias("newest"), F.col("b.created_at").alias("newest_time"))


def with_downloads(packages: DataFrame, versions: DataFrame, include_pre: bool = False) -> DataFrame:
    """Packages (id, name, and downloads if the registry tells them) with their newest version, its time, and downloads: those of the package, or where
    the registry has no such column the sum over its versions (package_id, num, yanked, created_at, downloads), yanked ones too."""
    newest = newest_versions(versions, include_pre).withColumnRenamed("package_id", "id")
    found = packages.join(newest, "id", "left")
    if "downloads" not in packages.columns:
        summed = versions.groupBy(F.col("package_id").alias("id")).agg(F.sum("downloads").alias("downloads"))
        found = found.join(summed, "id", "left").withColumn("downloads", F.coalesce("downloads", F.lit(0)))
    return found.select("id", "name", "newest", "newest_time", "downloads")


def newest_of_each(entries: DataFrame, key: str) -> DataFrame:
    """The first entry by version, time, name for each key; good ones (with a content hash) alone."""
    order = Window.partitionBy(key).orderBy(S.semver(F.col("version")).desc(), F.desc("parsed_at"), F.asc("name"))
    return entries.where("graph_hash <> ''").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def channel_aliases(entries: DataFrame) -> DataFrame:
    """name, alias, version: of a package of the toolchain (any of its entries has the source sysroot) latest and stable are the newest version of
    neither other channel, beta and nightly the newest that says so; of other packages latest and stable are the newest version."""
    channel = F.when(F.col("version").contains("beta"), "beta").when(F.col("version").contains("nightly"), "nightly").otherwise("stable")
    newest = entries.groupBy("name", channel.alias("channel")).agg(F.max(F.struct(S.semver(F.col("version")).alias("key"), "version")).alias("newest"), F.bool_or(F.col("source") == "sysroot").alias("toolchain"))
    toolchain = newest.groupBy("name").agg(F.bool_or("toolchain").alias("toolchain"))  # three rows of a package at most come together
    told = newest.drop("toolchain").join(toolchain, "name").withColumn("alias", F.when(F.col("toolchain"), F.col("channel")).otherwise("stable"))
    found = told.groupBy("name", "alias").agg(F.max("newest")["version"].alias("version"))
    return found.unionByName(found.where("alias = 'stable'").withColumn("alias", F.lit("latest")))


def search(nodes: DataFrame, query: str, limit: int, kinds: list[str] | None = None) -> DataFrame:
    """Ranked: exact name, name prefix, last segment, name holds it, id holds it; then id. Impls aren't found, nor anything by a blank query."""
    q = query.strip().lower()
    name, node_id = F.lower("name"), F.lower("id")
    score = F.when(name == q, 0).when(name.startswith(q), 1).when(node_id.endswith(f"::{q}"), 2).when(name.contains(q), 3).when(node_id.contains(q), 4)
    found = nodes.where((F.col("kind") != "Impl") & F.lit(bool(q)))
    found = found.where(F.col("kind").isin(*kinds)) if kinds else found
    return found.withColumn("score", score).where("score is not null").select("id", "name", "kind", "score").orderBy("score", "id").limit(limit)


def search_toolchain(toolchain: DataFrame, query: str) -> DataFrame:
    """id, name, version, description, place of the toolchain's packages (name, description, seq) that a query means, in each of the channels or the one
    that it asks for."""
    asked = S.toolchain_query(F.lit(query))
    needle, channel = asked["name"], asked["channel"]
    hyphens = F.replace("name", F.lit("_"), F.lit("-"))
    searchable = F.lower(F.concat_ws(" ", "name", hyphens, "description"))
    hit = (needle == "") & channel.isNotNull() | (needle != "") & (F.contains("name", needle) | F.contains(searchable, F.replace(needle, F.lit("_"), F.lit(" "))))
    every = toolchain.where(hit).select("*", hyphens.alias("id"), F.posexplode(F.array(*map(F.lit, CHANNELS))).alias("at", "version")).where(channel.isNull() | (F.col("version") == channel))
    return every.select("id", "name", "version", F.concat("description", F.lit(" ("), "version", F.lit(")")).alias("description"), (F.col("seq") * len(CHANNELS) + F.col("at")).cast("long").alias("place"))


def search_packages(packages: DataFrame, toolchain: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The toolchain's packages first, then those (id or null, name, version, description) whose name or id is the query, begins with it, holds it, or
    whose description holds it, by name; each id and version once."""
    q = query.strip().lower()
    name, node_id, told = F.lower("name"), F.lower(F.coalesce("id", "name")), F.lower(F.coalesce("description", F.lit("")))
    score = F.when((name == q) | (node_id == q), 0).when(name.startswith(q) | node_id.startswith(q), 1).when(name.contains(q) | node_id.contains(q), 2).when(told.contains(q), 3)
    columns = ["id", "name", "version", "description"]
    found = packages.withColumn("score", score).where(F.col("score").isNotNull() & F.lit(bool(q))).select(*columns, F.struct(F.lit(1).alias("part"), F.col("score").cast("long").alias("a"), F.lower("name").alias("b"), "name", "version").alias("order"))
    first = search_toolchain(toolchain, q).select(*columns, F.struct(F.lit(0).alias("part"), F.col("place").alias("a"), F.lit("").alias("b"), "name", "version").alias("order"))
    keyed = first.unionByName(found).groupBy(F.coalesce("id", "name").alias("key"), "version").agg(F.min(F.struct("order", F.struct("id", "name", "description").alias("row"))).alias("m"))
    return keyed.orderBy("m.order").limit(limit).select("m.row.id", "m.row.name", "version", "m.row.description", F.col("m.order.part").alias("part"), F.col("m.order.a").alias("score"))


def best_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """child and parent of the lowest score: packages before modules before others, Contains before Defines, then the first."""
    kinds = nodes.select(F.col("id").alias("from_id"), F.col("kind").alias("parent_kind"))
    score = F.when(F.col("parent_kind") == "Crate", 0).when(F.col("parent_kind") == "Module", 10).otherwise(20) + F.when(F.col("kind") == "Contains", 0).otherwise(1)
    e = edges.where("kind in ('Contains', 'Defines')").join(kinds, "from_id")
    return e.groupBy(F.col("to_id").alias("child")).agg(F.min(F.struct(score.alias("s"), "edge_seq", "from_id"))["from_id"].alias("parent"))


def _neighbours(page_edges: DataFrame) -> DataFrame:
    """page, neighbour, n (edges between them), whether any comes in (i) and any goes out (o), and the place by n, then id."""
    incoming = F.col("to_id") == F.col("page")
    ends = page_edges.where("from_id <> to_id and (from_id = page or to_id = page)").select("page", F.when(incoming, F.col("from_id")).otherwise(F.col("to_id")).alias("neighbour"), incoming.cast("int").alias("incoming"))
    counts = ends.groupBy("page", "neighbour").agg(F.count("*").alias("n"), F.max("incoming").alias("i"), F.max(1 - F.col("incoming")).alias("o"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("n"), "neighbour")))


def neighbour_cap(page_edges: DataFrame, most: int) -> DataFrame:
    """For each page the neighbours with most edges (then by id), at most ``most`` - 2: one place is the page's, one the summary's."""
    return _neighbours(page_edges).where(F.col("place") <= most - 2).select("page", "neighbour", "n", "place")


def overflow(page_edges: DataFrame, most: int) -> DataFrame:
    """For each page, how many neighbours that cap leaves out, by direction. Pages are grouped once for the ranking and the counts."""
    left = _neighbours(page_edges).where(F.col("place") > most - 2)
    return left.groupBy("page").agg(F.count("*").alias("dropped"), F.sum("i").alias("dropped_in"), F.sum("o").alias("dropped_out"))


def edge_cap(page_edges: DataFrame, most: int) -> DataFrame:
    """For each page at most ``most`` edges: those that touch it first, then by relation order, from, to."""
    touches = F.when((F.col("from_id") == F.col("page")) | (F.col("to_id") == F.col("page")), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("page").orderBy(touches, S.relation_order(F.col("kind")), "from_id", "to_id", "kind"))
    return page_edges.withColumn("place", place).where(F.col("place") <= most)


def matrix_modules(totals: DataFrame, most: int = 24) -> DataFrame:
    """By package: the root first, then modules by total, depth, id, at most ``most``. totals: package, module, depth, total."""
    root = F.when(F.col("module") == F.col("package"), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("package").orderBy(root, F.desc("total"), "depth", "module"))
    return totals.withColumn("place", place).where(F.col("place") <= most)


def first_users(used: DataFrame, most: int = 8) -> DataFrame:
    """For each page its first distinct users, by id."""
    users = used.select("page", "user").distinct()
    return users.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("user"))).where(F.col("place") <= most)


def page_of(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of a listing, its number held inside 1 .. pages."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((max(1, min(number, pages)) - 1) * size).limit(size)
