"""Partitioned read models. Every store is a folder partitioned by what its readers filter on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators.filters import is_local_page
from weftline.shared import freed, staged

BUCKETS, SALTS = 16, 8


def _salt(*columns: str) -> Column:
    """Deals the rows of one bucket to several tasks."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def write_nodes(nodes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """By package and bucket of the id."""
    labelled = nodes.withColumn("bucket", S.bucket_label(F.col("id"), buckets))
    labelled.repartition("package", "bucket", _salt("id")).write.partitionBy("package", "bucket").mode("overwrite").parquet(path)


def write_children(children: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A row for each child by package and bucket of the parent, with its place in display order (kind, name, id) as columns; sorted by them
    in each file, so a parent of any number of children is no single value."""
    order = ["parent", "kind_place", "name", "child"]
    rows = children.withColumn("kind_place", S.kind_order(F.col("kind"))).select(*order, "kind", "has_children")
    keyed = rows.withColumns({"package": S.package_of(F.col("parent")), "bucket": S.bucket_label(F.col("parent"), buckets)})
    keyed.repartition("package", "bucket", _salt("child")).sortWithinPartitions("package", "bucket", *order).write.partitionBy("package", "bucket").mode("overwrite").parquet(path)


def read_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """parent, place, child, name, has_children of the parents asked for, in display order. children: the store, read back."""
    asked = children.join(parents.select("parent").distinct(), "parent", "left_semi")
    place = F.row_number().over(Window.partitionBy("parent").orderBy("kind_place", "name", "child"))
    return asked.select("parent", place.alias("place"), "child", "name", "has_children")


def write_search(nodes: DataFrame, path: str) -> None:
    """Pages by the two characters that searches begin with."""
    nodes.where(is_local_page()).withColumn("prefix", S.search_prefix(F.col("name"))).repartition("prefix", _salt("id")).write.partitionBy("prefix").mode("overwrite").parquet(path)


def write_kinds(nodes: DataFrame, path: str) -> None:
    nodes.where(is_local_page()).repartition("kind", _salt("id")).sortWithinPartitions("kind", "id").write.partitionBy("kind").mode("overwrite").parquet(path)


def write_aliases(aliases: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    rows = aliases.select("alias", "canonical", F.replace("canonical", F.lit("::"), F.lit("/")).alias("path"), S.bucket_label(F.col("alias"), buckets).alias("bucket"))
    rows.repartition("bucket", _salt("alias")).write.partitionBy("bucket").mode("overwrite").parquet(path)


def manifest(nodes: DataFrame, edges: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """By package: nodes, pages, edges, and how many buckets hold anything."""
    n = nodes.groupBy("package").agg(F.count("*").alias("n_nodes"), F.count_if(is_local_page()).alias("n_pages"), F.count_distinct(F.pmod(S.fnv1a32(F.col("id")), F.lit(buckets))).alias("n_buckets"))
    e = edges.groupBy(S.package_of(F.col("from_id")).alias("package")).agg(F.count("*").alias("n_edges"))
    return n.join(e, "package", "left").select("package", "n_nodes", "n_pages", "n_buckets", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def build_report(nodes: DataFrame) -> DataFrame:
    """By package: entries, bytes in all, the largest entry and its id."""
    size = F.octet_length(F.to_json(F.struct("id", "name", "kind", "visibility"))).cast("bigint")
    return nodes.withColumn("size", size).groupBy("package").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min_by("id", F.struct(-F.col("size"), "id")).alias("largest_id"))


def bucket_hashes(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """A content hash and a count for each bucket: rows' hashes are added up, so no bucket is brought together."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    second = F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(38,0)")
    bucketed = rows.withColumn("bucket", F.pmod(S.fnv1a32(F.concat_ws("@", *keys)), F.lit(buckets)))
    return bucketed.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.sum(number).cast("string"), F.sum(second).cast("string")), 256).alias("hash"))


def changed_buckets(now: DataFrame, before: DataFrame) -> DataFrame:
    """Buckets whose hash or count isn't that of before."""
    return now.join(before, ["bucket", "n", "hash"], "left_anti")


def write_changed(rows: DataFrame, keys: list[str], buckets: int, before: DataFrame | None, folder: str) -> DataFrame:
    """Write the changed buckets to ``folder``, then the manifest (bucket, n, hash, path) that names old and new files. Readers go by
    the manifest, so what is half written is never seen."""
    spark = rows.sparkSession
    now = staged(bucket_hashes(rows, keys, buckets), "hashes")  # a row for each bucket, read three times
    changed = changed_buckets(now, before.select("bucket", "n", "hash")) if before is not None else now
    bucketed = rows.withColumn("bucket", F.pmod(S.fnv1a32(F.concat_ws("@", *keys)), F.lit(buckets)))
    bucketed.join(changed.select("bucket"), "bucket", "left_semi").repartition("bucket", _salt(*keys)).write.partitionBy("bucket").parquet(f"{folder}/data")
    fresh = changed.withColumn("path", F.concat(F.lit(f"{folder}/data/bucket="), F.col("bucket").cast("string")))
    kept = before.join(now, ["bucket", "n", "hash"], "left_semi").select("bucket", "n", "hash", "path") if before is not None else fresh.limit(0)
    fresh.select("bucket", "n", "hash", "path").unionByName(kept).coalesce(1).write.parquet(f"{folder}/manifest")  # a row for each bucket
    return spark.read.parquet(f"{folder}/manifest")


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite just the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def graph_hashes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By package, a hash of all nodes and edges that doesn't depend on their order."""
    row = lambda df, *c: df.select("package", F.sha2(F.to_json(F.struct(*c)), 256).alias("h"))
    both = row(nodes, "id", "name", "kind", "visibility").union(row(edges.withColumn("package", S.package_of(F.col("from_id"))), "from_id", "to_id", "kind", "confidence"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return both.groupBy("package").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", part(1), part(16), part(31)), 256).alias("graph_hash"))


def _details(rows: DataFrame, part: str, *values: Column) -> DataFrame:
    names = zip(values, ("from_id", "to_id", "kind", "depth"), strict=True)
    return rows.select("page", F.lit(part).alias("part"), *[c.alias(n) for c, n in names], *[c for c in ("bucket",) if c in rows.columns])


def page_details(page_edges: DataFrame, related: DataFrame, ancestors: DataFrame) -> list[DataFrame]:
    """A row for each edge, related node and ancestor of a page, in one shape, as three tables. Rows and not lists, so a page of any number of edges
    is no single value. Where page_edges and related have the page's bucket, it is kept."""
    none, flat = F.lit(None).cast("string"), F.lit(None).cast("int")
    edges = _details(page_edges, "edge", F.col("from_id"), F.col("to_id"), F.col("kind"), flat)
    others = _details(related, "related", none, F.col("id"), F.col("kind"), flat)
    above = _details(ancestors.withColumnRenamed("node", "page"), "ancestor", none, F.col("ancestor"), none, F.col("depth").cast("int"))
    return [edges, others, above]


def write_details(details: list[DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """By package and bucket of the page; rows of a bucket are dealt by page and other end, and sorted by page in each file. The tables are written
    one after the other; the bucket is made here where rows don't bring it, as hashing the page of every row takes long."""
    for k, rows in enumerate(details):
        label = {} if "bucket" in rows.columns else {"bucket": S.bucket_label(F.col("page"), buckets)}
        keyed = rows.withColumns({"package": S.package_of(F.col("page"))} | label)
        dealt = keyed.repartition("package", "bucket", _salt("page", "to_id")).sortWithinPartitions("package", "bucket", "page", "part")
        with freed(rows.sparkSession):
            dealt.write.partitionBy("package", "bucket").mode("append" if k else "overwrite").option("compression", "zstd").parquet(path)


def node_views(related: DataFrame, nodes: DataFrame, inverse: DataFrame) -> DataFrame:
    """page with each related node whole: under its alias if it has one, and its size as JSON. inverse: canonical, alias."""
    whole = nodes.select("id", "name", F.col("kind").alias("node_kind"), "visibility")
    more = [c for c in related.columns if c == "page_hash"]
    joined = related.select("page", "id", *more).join(whole, "id").join(inverse.withColumnRenamed("canonical", "id"), "id", "left").withColumn("shown", F.coalesce("alias", "id"))
    size = F.octet_length(F.to_json(F.struct("shown", "name", "node_kind", "visibility"))).cast("bigint")
    return joined.select("page", "shown", F.col("id").alias("canonical"), "name", "node_kind", "visibility", size.alias("size"), *more)


def write_pointers(versions: DataFrame, path: str) -> None:
    """A row for each alias of a version (storage_name, version, aliases)."""
    versions.select("storage_name", F.explode("aliases").alias("alias"), "version").write.mode("overwrite").parquet(path)


def version_refs(entries: DataFrame) -> DataFrame:
    """storage_name with its versions, newest first. entries: storage_name, version, graph_hash; those without a hash don't count."""
    good = entries.where("graph_hash <> ''").select("storage_name", "version").distinct().withColumn("key", S.semver(F.col("version")))
    listed = F.sort_array(F.collect_list(F.struct("key", "version")), asc=False)
    return good.groupBy("storage_name").agg(F.transform(listed, lambda x: x["version"]).alias("versions"))


def write_refs(refs: DataFrame, path: str) -> None:
    """One JSON document a line for each storage name."""
    refs.write.mode("overwrite").json(path)


def write_catalog(newest: DataFrame, path: str, schema_version: int) -> None:
    """The newest good entry of each storage name, sorted by name in each file."""
    rows = newest.select(F.lit(schema_version).alias("schema_version"), "name", "version")
    rows.repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").json(path)


def append_log(deltas: DataFrame, path: str) -> None:
    """A JSON line for each finished item, beside those of earlier runs."""
    deltas.write.mode("append").json(path)


def record_versions(before: DataFrame | None, entries: DataFrame) -> DataFrame:
    """name, key, version: a row for each exact version, and ``latest`` if no higher version is there."""
    exact = entries.select("name", F.col("version").alias("key"), "version")
    both = exact.unionByName(before) if before is not None else exact
    latest = both.groupBy("name").agg(F.max_by("version", S.semver(F.col("version"))).alias("version")).select("name", F.lit("latest").alias("key"), "version")
    return both.where("key <> 'latest'").distinct().unionByName(latest)


# ---- documents in full


def _newest_place() -> Column:
    """The order of a package's entries: by version, then the later parse, then the name."""
    return F.row_number().over(Window.partitionBy("storage_name").orderBy(S.semver(F.col("version")).desc(), F.desc("parsed_at"), "name"))


def _channel(version: Column) -> Column:
    return F.when(version.contains("beta"), "beta").when(version.contains("nightly"), "nightly").otherwise("stable")


def ref_documents(entries: DataFrame, schema_version: int) -> DataFrame:
    """By storage name what readers need to find a version: schema_version, display_name, aliases (name to version and hash) and versions (with
    hash, time, nodes and edges), newest first. entries: storage_name, name, version, graph_hash, parsed_at, nodes, edges, source; only
    those with a hash count.

    Of a package of the toolchain (any entry's source is sysroot) latest and stable are the newest version of neither other channel, beta and
    nightly the newest that says so; of others latest and stable are the newest version. A document lists one package's versions."""
    good = entries.where("graph_hash <> ''").withColumn("place", _newest_place())
    toolchain = good.groupBy("storage_name").agg(F.bool_or(F.col("source") == "sysroot").alias("toolchain"), F.min_by("name", "place").alias("display_name"))
    told = good.join(toolchain, "storage_name")
    firsts = told.withColumn("alias", F.when(F.col("toolchain"), _channel(F.col("version"))).otherwise("stable"))
    named = firsts.groupBy("storage_name", "alias").agg(F.min_by(F.struct("version", "graph_hash"), "place").alias("entry"))
    with_latest = named.unionByName(named.where("alias = 'stable'").withColumn("alias", F.lit("latest")))
    aliases = with_latest.groupBy("storage_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "entry")))).alias("aliases"))
    listed = F.array_sort(F.collect_list(F.struct("place", F.struct("version", "graph_hash", "parsed_at", "nodes", "edges").alias("v"))))
    versions = good.groupBy("storage_name").agg(F.transform(listed, lambda x: x["v"]).alias("versions"))
    joined = toolchain.join(versions, "storage_name").join(aliases, "storage_name", "left")
    return joined.select(F.lit(schema_version).alias("schema_version"), "storage_name", "display_name", "aliases", "versions")


REF_DOCUMENT = "schema_version int, storage_name string, display_name string, aliases map<string, struct<version: string, graph_hash: string>>, versions array<struct<version: string, graph_hash: string, parsed_at: timestamp, nodes: long, edges: long>>"


def catalog_documents(entries: DataFrame, schema_version: int) -> DataFrame:
    """The newest good entry of each storage name with its time and counts."""
    newest = entries.where("graph_hash <> ''").withColumn("place", _newest_place()).where("place = 1")
    return newest.select(F.lit(schema_version).alias("schema_version"), "name", "storage_name", "version", "parsed_at", F.col("nodes").alias("node_count"), F.col("edges").alias("edge_count"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document a line, sorted by storage name in each file."""
    documents.repartitionByRange("storage_name").sortWithinPartitions("storage_name").write.mode("overwrite").json(path)


def write_node_views(views: DataFrame, path: str, target_bytes: int, least: int, most: int) -> None:
    """Views by package and bucket of the page. A package has as many buckets (a power of two within bounds) as keep each near
    ``target_bytes``; rows of a bucket are dealt by a salt and sorted by page in each file. Views are made once, for the sums and the store."""
    keyed = staged(views.withColumn("package", S.package_of(F.col("page"))), "views")
    hashed = F.col("page_hash") if "page_hash" in views.columns else S.fnv1a32(F.col("page"))
    totals = keyed.groupBy("package").agg(F.sum("size").alias("total")).select("package", S.bucket_count(F.col("total"), target_bytes, least, most).alias("buckets"))
    placed = keyed.join(totals, "package").withColumn("bucket", F.pmod(hashed, F.col("buckets"))).drop("page_hash")
    dealt = placed.repartition("package", "bucket", _salt("page", "canonical")).sortWithinPartitions("package", "bucket", "page", "shown")
    with freed(views.sparkSession):
        dealt.write.partitionBy("package", "bucket").mode("overwrite").option("compression", "zstd").parquet(path)


def node_view_report(stored: DataFrame) -> DataFrame:
    """By package of a written view store: entries, bytes in all, the largest entry, buckets, and the largest bucket's bytes."""
    pages = stored.groupBy("package", "bucket", "buckets", "page").agg(F.sum("size").alias("bytes"))
    buckets = pages.groupBy("package", "bucket", "buckets").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.min_by("page", F.struct(-F.col("bytes"), "page")).alias("largest_id"))
    return buckets.groupBy("package", "buckets").agg(
        F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest_bytes"), F.min_by("largest_id", F.struct(-F.col("largest"), "largest_id")).alias("largest_id"), F.max("bytes").alias("largest_bucket_bytes"),
    )


def manifest_documents(nodes: DataFrame, edges: DataFrame, roots: DataFrame, children: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """By package: counts, local pages by kind, buckets that hold nodes, and roots with how many children each shows. roots: id; children: parent, child.
    The lists are of kinds, buckets and roots, which don't grow with a package."""
    pages = nodes.where(is_local_page())
    kinds = pages.groupBy("package", "kind").agg(F.count("*").alias("n")).groupBy("package").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kind_counts"), F.sum("n").alias("node_count"))
    filled = nodes.select("package", S.bucket_label(F.col("id"), buckets).alias("bucket")).groupBy("package").agg(F.sort_array(F.collect_set("bucket")).alias("node_buckets"))
    shown = children.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    top = roots.join(pages.select("id", "package"), "id").join(shown, "id", "left").groupBy("package").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("n_children", F.lit(0)).alias("n_children")))).alias("roots"))
    e = edges.groupBy(S.package_of(F.col("from_id")).alias("package")).agg(F.count("*").alias("edge_count"))
    joined = filled.join(kinds, "package", "left").join(e, "package", "left").join(top, "package", "left")
    return joined.select("package", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "kind_counts", "node_buckets", "roots")
