"""Registered queries over focused views and graphs that arrive in batches, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.fixed import FOCUS_ORDER, SUMMARY_PREFIX
from weftline.functions import scalars as S
from weftline.operators import aggregates as A
from weftline.operators import graph as G
from weftline.operators import ranking as R
from weftline.operators.filters import is_local_page
from weftline.operators.focus import Focus, trait_metadata
from weftline.queries import _FNV32, PARTS, STORED, TREE, query
from weftline.shared import freed, parts, scratch, staged
from weftline.sinks import stores as K
from weftline.streaming import graph_load as H

MAX_NODES, MAX_EDGES = 8, 10
_AT = "list_position([" + ", ".join(f"'{k}'" for k in FOCUS_ORDER) + "], {})"
_KIND = "[" + ", ".join(f"'{k}'" for k in FOCUS_ORDER) + "][{}]"

STORED |= {"fe", "reach", "own", "kept", "comb", "lim", "focused"}
PARTS |= {
    "fe": "SELECT e.from_id, e.to_id, e.kind, e.confidence, f.kind = 'Trait' AS fh, t.kind = 'Trait' AS th FROM edges e JOIN nodes f ON e.from_id = f.id JOIN nodes t ON e.to_id = t.id",
    "reach": "SELECT id AS seed, id FROM pages UNION SELECT p.id, to_id FROM fe JOIN pages p ON from_id = p.id WHERE NOT th UNION SELECT p.id, from_id FROM fe JOIN pages p ON to_id = p.id WHERE NOT fh",
    "full_seeds": f"SELECT seed, count(*) > {MAX_NODES} AS is_full FROM reach GROUP BY seed",
    "own": "SELECT seed, to_id AS other, fe.kind, true AS outgoing FROM fe JOIN full_seeds ON from_id = seed WHERE is_full AND NOT th AND from_id <> to_id UNION ALL SELECT seed, from_id, fe.kind, false FROM fe JOIN full_seeds ON to_id = seed WHERE is_full AND NOT fh AND from_id <> to_id",
    "few": f"SELECT seed, other AS id FROM (SELECT seed, other, row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, min(name), other) AS r FROM own JOIN nodes ON other = id GROUP BY seed, other) WHERE r <= {MAX_NODES - 2}",
    "kept": "SELECT r.seed, r.id FROM reach r JOIN full_seeds s USING (seed) WHERE NOT is_full UNION SELECT seed, id FROM few UNION SELECT seed, seed FROM full_seeds",
    "lost_ends": f"SELECT seed, count(DISTINCT other) FILTER (outgoing) AS more_out, count(DISTINCT other) FILTER (NOT outgoing) AS more_in, min({_AT.format('kind')}) FILTER (outgoing) AS kind_out, min({_AT.format('kind')}) FILTER (NOT outgoing) AS kind_in FROM own o LEFT JOIN few w USING (seed) WHERE (seed, other) NOT IN (SELECT seed, id FROM few) GROUP BY seed",
    "room": f"SELECT *, coalesce(more_out, 0) > 0 AND size < {MAX_NODES} AS add_out, coalesce(more_in, 0) > 0 AND size + CAST(coalesce(more_out, 0) > 0 AND size < {MAX_NODES} AS INTEGER) < {MAX_NODES} AS add_in FROM (SELECT seed, count(*) AS size FROM kept GROUP BY seed) LEFT JOIN lost_ends USING (seed)",
    "comb": f"SELECT a.seed, from_id, to_id, fe.kind, confidence FROM fe JOIN kept a ON a.id = from_id JOIN kept b ON b.id = to_id AND b.seed = a.seed UNION ALL SELECT seed, seed, '{SUMMARY_PREFIX}' || seed || '::overflow-out', {_KIND.format('kind_out')}, 'Inferred' FROM room WHERE add_out UNION ALL SELECT seed, '{SUMMARY_PREFIX}' || seed || '::overflow-in', seed, {_KIND.format('kind_in')}, 'Inferred' FROM room WHERE add_in",
    "lim": f"SELECT r.*, greatest(c.total - {MAX_EDGES}, 0) AS more, c.total > {MAX_EDGES} AND size + CAST(add_out AS INTEGER) + CAST(add_in AS INTEGER) < {MAX_NODES} AS add_edge FROM room r JOIN (SELECT seed, count(*) AS total FROM comb GROUP BY seed) c USING (seed)",
    "focused": f"SELECT seed, from_id, to_id, kind, confidence FROM (SELECT c.*, add_edge, row_number() OVER (PARTITION BY seed ORDER BY from_id <> seed AND to_id <> seed, {_AT.format('kind')}, from_id, to_id, confidence) AS r FROM comb c JOIN lim USING (seed)) WHERE r <= {MAX_EDGES} - CAST(add_edge AS INTEGER) UNION ALL SELECT seed, seed, '{SUMMARY_PREFIX}' || seed || '::overflow-edges', 'UsesType', 'Inferred' FROM lim WHERE add_edge",
}
FOCUS = ("pages", "fe", "reach", "full_seeds", "own", "few", "kept", "lost_ends", "room", "comb", "lim", "focused")


def _focus(nodes: DataFrame, edges: DataFrame) -> Focus:
    """Every page with a small view, so that caps and summaries show."""
    return Focus(nodes, edges, nodes.where(is_local_page()).select(F.col("id").alias("seed")), MAX_NODES, MAX_EDGES, internals=True)


@query("focus_edges", ("nodes", "edges"), "SELECT * FROM focused", FOCUS)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _focus(nodes, edges).edges_out


@query(
    "focus_nodes", ("nodes", "edges"),
    "SELECT e.seed, e.id, coalesce(n.name, CASE WHEN ends_with(e.id, '-out') THEN '+' || CAST(more_out AS VARCHAR) || ' more deps' WHEN ends_with(e.id, '-in') THEN '+' || CAST(more_in AS VARCHAR) || ' more users' ELSE '+' || CAST(more AS VARCHAR) || ' more links' END) AS name, coalesce(n.kind, 'Module') AS kind, n.id IS NULL AS synthetic"
    " FROM (SELECT seed, from_id AS id FROM focused UNION SELECT seed, to_id FROM focused UNION SELECT id, id FROM pages) e LEFT JOIN nodes n ON e.id = n.id LEFT JOIN lim ON lim.seed = e.seed",
    FOCUS,
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _focus(nodes, edges).nodes_out


@query("focus_traits", ("nodes", "edges"), "SELECT from_id AS id, list_sort(list(DISTINCT to_id)) AS trait_ids, list_sort(list(DISTINCT name)) AS trait_names FROM edges e JOIN nodes t ON e.to_id = t.id WHERE e.kind = 'Implements' AND t.kind IN ('Trait', 'TraitAlias') AND from_id IN (SELECT id FROM nodes) GROUP BY from_id")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return trait_metadata(nodes, edges)


# ---- graphs in batches


def _versioned(rows: DataFrame, schema: str) -> DataFrame:
    """Rows as a loader gets them, each also in an older (node) or later (edge) form that must not win."""
    return rows.withColumn("version", F.lit("1.0")).select(*[x.split()[0] for x in schema.split(", ")])


def _streamed(rows: DataFrame, schema: str, name: str, batches: int) -> DataFrame:
    """Written as files, read as a stream of so many triggers at most, and loaded; the log. Rows are not shuffled for it: which batch one is in doesn't matter."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, name)
    with freed(spark):
        rows.write.option("compression", "zstd").parquet(f"{folder}/in")
    files = len(spark.read.schema(schema).parquet(f"{folder}/in").inputFiles())
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{folder}/in")
    H.load(stream, f"{folder}/log", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return H.log(spark, f"{folder}/log", schema)


@query(
    "graph_load", ("nodes", "raw_edges"),
    "SELECT e.from_id, e.to_id, e.kind, e.confidence, e.is_glob, f.name AS from_name, f.kind AS from_kind, coalesce(t.name, string_split(e.to_id, '::')[-1]) AS to_name, coalesce(t.kind, 'ExternCrate') AS to_kind, t.id IS NOT NULL AS to_known FROM (SELECT from_id, to_id, kind, arg_min(confidence, edge_seq) AS confidence, arg_min(is_glob, edge_seq) AS is_glob FROM raw_edges GROUP BY from_id, to_id, kind) e LEFT JOIN nodes f ON e.from_id = f.id LEFT JOIN (SELECT * FROM nodes WHERE node_seq % 2 = 0) t ON e.to_id = t.id AND split_part(e.to_id, '::', 1) = 'part' WHERE split_part(from_id, '::', 1) <> split_part(to_id, '::', 1) AND split_part(to_id, '::', 1) = 'part'",
)
def _(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """Externals with odd numbers never come; every other node comes twice, its older row under another name."""
    come = nodes.where("not is_external or node_seq % 2 = 0")
    older = come.withColumns({"name": F.lit("older"), "node_seq": F.col("node_seq") - 10_000_000_000_000})
    loaded = staged(H.loaded_nodes(_streamed(_versioned(come.unionByName(older).withColumn("package", F.lit("all")), H.NODE), H.NODE, "nodes", 4)), "loaded")
    outer = raw.where("to_id like 'part::%'").withColumn("package", F.lit("all"))
    edges = H.loaded_edges(_streamed(_versioned(outer, H.EDGE), H.EDGE, "edges", 4))
    found = H.cross_edges(staged(edges, "loaded"), loaded)
    return found.select("from_id", "to_id", "kind", "confidence", "is_glob", "from_name", "from_kind", "to_name", "to_kind", "to_known")


@query(
    "tree_index", ("nodes", "raw_edges"),
    "SELECT n.id, e.parent, e.parent IS NULL AS is_root FROM nodes n LEFT JOIN (SELECT to_id AS id, arg_min(from_id, (edge_seq, from_id)) AS parent FROM raw_edges WHERE kind IN ('Contains', 'Defines') GROUP BY to_id) e ON n.id = e.id",
)
def _(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """Nodes and edges in three batches that have nothing to do with their order: the index is merged after each."""
    batches = [H.places(nodes.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k), raw.where(F.pmod(F.xxhash64("to_id", "from_id"), F.lit(3)) == k)) for k in range(3)]
    index = reduce(lambda known, batch: staged(H.with_batch(known, batch), "index"), batches)
    return index.where("is_node").select("id", "parent", F.col("parent").isNull().alias("is_root"))


# ---- stores and documents in full


_ENTRIES = """SELECT CAST(package_id AS STRING) AS storage_name, CASE version_seq % 5 WHEN 0 THEN 'p_' ELSE 'p-' END || CAST(package_id AS STRING) AS name, CASE WHEN package_id % 10 = 0 THEN replace(num, '-rc.', CASE version_seq % 2 WHEN 0 THEN '-beta.' ELSE '-nightly.' END) ELSE num END AS version,
 CASE WHEN version_seq % 4 = 0 THEN '' ELSE 'h' || CAST(version_seq AS STRING) END AS graph_hash, CAST(created_at AS TIMESTAMP) AS parsed_at, CAST(version_seq % 97 AS BIGINT) AS nodes, CAST(version_seq % 89 AS BIGINT) AS edges, CASE WHEN package_id % 10 = 0 THEN 'sysroot' ELSE 'docs' END AS source FROM (SELECT package_id, num, min(version_seq) AS version_seq, min(created_at) AS created_at FROM versions GROUP BY package_id, num)"""
_SORTED = r"SELECT *, row_number() OVER (PARTITION BY storage_name ORDER BY CAST(k.a AS BIGINT) DESC, CAST(k.b AS BIGINT) DESC, CAST(k.c AS BIGINT) DESC, k.d <> '', k.d DESC, coalesce(try_cast(k.e AS BIGINT), 0) DESC, parsed_at DESC, name) AS place FROM (SELECT *, regexp_extract(version, '^(\d+)\.(\d+)\.(\d+)(?:-([a-z]+)\.(\d+))?$', ['a', 'b', 'c', 'd', 'e']) AS k FROM entries WHERE graph_hash <> '')"
PARTS |= {
    "entries": _ENTRIES, "ranked_entries": _SORTED,
    "channels": "SELECT *, CASE WHEN source <> 'sysroot' THEN 'stable' WHEN contains(version, 'beta') THEN 'beta' WHEN contains(version, 'nightly') THEN 'nightly' ELSE 'stable' END AS channel FROM ranked_entries",
}
STORED |= {"ranked_entries"}


def _stored_refs(versions: DataFrame) -> DataFrame:
    spark, path = versions.sparkSession, scratch(versions.sparkSession, "refs")
    K.write_documents(K.ref_documents(spark.sql(_ENTRIES.replace("FROM versions", "FROM {v}"), v=versions), 2), path)
    return spark.read.schema(K.REF_DOCUMENT).json(path)


@query("ref_versions", ("versions",), "SELECT r.storage_name, d.name AS display_name, CAST(r.place - 1 AS INTEGER) AS place, r.version, r.graph_hash, r.parsed_at, r.nodes, r.edges FROM ranked_entries r JOIN ranked_entries d ON r.storage_name = d.storage_name AND d.place = 1", ("entries", "ranked_entries"))
def _(versions: DataFrame) -> DataFrame:
    """Every version that the documents list, read back."""
    return _stored_refs(versions).select("storage_name", "display_name", F.posexplode("versions").alias("place", "v")).select("storage_name", "display_name", "place", "v.*")


@query("ref_aliases", ("versions",), "SELECT storage_name, alias, version, graph_hash FROM (SELECT storage_name, channel AS alias, arg_min(version, place) AS version, arg_min(graph_hash, place) AS graph_hash FROM channels GROUP BY ALL UNION ALL SELECT storage_name, 'latest', arg_min(version, place), arg_min(graph_hash, place) FROM channels WHERE channel = 'stable' GROUP BY storage_name)", ("entries", "ranked_entries", "channels"))
def _(versions: DataFrame) -> DataFrame:
    return _stored_refs(versions).select("storage_name", F.explode("aliases").alias("alias", "e")).select("storage_name", "alias", "e.*")


@query("catalog_documents", ("versions",), "SELECT name, storage_name, version, parsed_at, nodes AS node_count, edges AS edge_count FROM ranked_entries WHERE place = 1", ("entries", "ranked_entries"))
def _(versions: DataFrame) -> DataFrame:
    spark, path = versions.sparkSession, scratch(versions.sparkSession, "catalog")
    K.write_documents(K.catalog_documents(spark.sql(_ENTRIES.replace("FROM versions", "FROM {v}"), v=versions), 3), path)
    schema = "schema_version int, name string, storage_name string, version string, parsed_at timestamp, node_count long, edge_count long"
    return spark.read.schema(schema).json(path).where("schema_version = 3").drop("schema_version")


TARGET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 4096, 2, 32
PARTS |= {
    "views": "SELECT r.page, split_part(r.page, '::', 1) AS package, CAST(strlen('{\"shown\":\"' || coalesce(v.alias, x.id) || '\",\"name\":\"' || x.name || '\",\"node_kind\":\"' || x.kind || '\",\"visibility\":\"' || x.visibility || '\"}') AS BIGINT) AS size FROM (SELECT DISTINCT page, id FROM (SELECT page, from_id AS id FROM page_edges UNION ALL SELECT page, to_id FROM page_edges) WHERE id <> page) r JOIN nodes x ON r.id = x.id LEFT JOIN (SELECT canonical, arg_min(alias, (length(alias), alias)) AS alias FROM aliases GROUP BY canonical) v ON x.id = v.canonical",
    "view_pages": "SELECT package, page AS id, CAST(sum(size) AS BIGINT) AS bytes FROM views GROUP BY package, page",
    "view_buckets": f"SELECT package, CAST(least(pow(2, ceil(log2(greatest(ceil(sum(bytes) / {TARGET_BYTES}), {LEAST_BUCKETS})))), {MOST_BUCKETS}) AS BIGINT) AS buckets FROM view_pages GROUP BY package",
    "placed_views": f"SELECT p.*, buckets, {_FNV32} % buckets AS bucket FROM view_pages p JOIN view_buckets USING (package)",
}


@query(
    "node_view_report", ("nodes", "edges", "aliases"),
    "SELECT package, buckets, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes, max(bytes) AS largest_bytes, arg_min(id, (-bytes, id)) AS largest_id, (SELECT CAST(max(b) AS BIGINT) FROM (SELECT sum(bytes) AS b FROM placed_views q WHERE q.package = p.package GROUP BY bucket)) AS largest_bucket_bytes FROM placed_views p GROUP BY package, buckets",
    ("pages", "page_edges", "views", "view_pages", "view_buckets", "placed_views"),
)
def _(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    spark, path = nodes.sparkSession, scratch(nodes.sparkSession, "views")
    related = G.related_ends(*G.page_parts(nodes, edges, page_hash=S.fnv1a32(F.col("page"))), "page_hash")
    views = K.node_views(related, nodes, G.inverse_aliases(aliases))
    K.write_node_views(views, path, TARGET_BYTES, LEAST_BUCKETS, MOST_BUCKETS)
    return K.node_view_report(spark.read.parquet(path))


@query(
    "manifest_documents", ("nodes", "edges"),
    f"SELECT package, coalesce(node_count, 0) AS node_count, coalesce(edge_count, 0) AS edge_count, kinds, buckets, tops FROM (SELECT package, string_agg(DISTINCT lpad(printf('%x', {_FNV32} % 16), 3, '0'), ' ' ORDER BY lpad(printf('%x', {_FNV32} % 16), 3, '0')) AS buckets FROM nodes GROUP BY package)"
    " LEFT JOIN (SELECT package, CAST(sum(n) AS BIGINT) AS node_count, string_agg(kind || '=' || CAST(n AS VARCHAR), ' ' ORDER BY kind) AS kinds FROM (SELECT package, kind, count(*) AS n FROM pages GROUP BY package, kind) GROUP BY package) USING (package)"
    " LEFT JOIN (SELECT split_part(from_id, '::', 1) AS package, count(*) AS edge_count FROM edges GROUP BY 1) USING (package)"
    " LEFT JOIN (SELECT package, string_agg(id || '=' || CAST((SELECT count(*) FROM relations r JOIN pages c ON r.child = c.id WHERE r.parent = p.id) AS VARCHAR), ' ' ORDER BY id) AS tops FROM pages p WHERE id NOT IN (SELECT child FROM relations) GROUP BY package) USING (package)",
    ("pages", *TREE),
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    relations = staged(G.tree_relations(nodes, edges), "relations")
    pages = nodes.where(is_local_page())
    roots = pages.select("id").join(relations.select(F.col("child").alias("id")), "id", "left_anti")
    children = relations.join(pages.select(F.col("id").alias("child")), "child", "left_semi")
    found = K.manifest_documents(nodes, edges, roots, children)
    pairs = lambda c, k, v: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), x[v].cast("string"))), " ")
    return found.select("package", "node_count", "edge_count", pairs(F.map_entries("kind_counts"), "key", "value").alias("kinds"), F.array_join("node_buckets", " ").alias("buckets"), pairs("roots", "id", "n_children").alias("tops"))


@query("united_places", ("raw_edges",), "SELECT from_id, to_id, kind, is_glob, CASE max(CASE confidence WHEN 'Runtime' THEN 3 WHEN 'Static' THEN 2 ELSE 1 END) WHEN 3 THEN 'Runtime' WHEN 2 THEN 'Static' ELSE 'Inferred' END AS confidence, min(edge_seq) AS edge_seq, coalesce(array_to_string(list_sort(list(DISTINCT edge_seq % 1000) FILTER (edge_seq % 3 > 0)), ','), '') AS lines FROM raw_edges GROUP BY from_id, to_id, kind, is_glob")
def _(raw: DataFrame) -> DataFrame:
    """Two copies of every edge with a place, two thirds of them; merging keeps each place once."""
    place = F.when(F.col("edge_seq") % 3 > 0, F.array(F.struct((F.col("edge_seq") % 1000).alias("line"), F.lit("lib.rs").alias("file"))))
    twice = raw.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    merged = A.merged_occurrences(twice.withColumn("occurrences", place))
    return merged.select("from_id", "to_id", "kind", "is_glob", "confidence", "edge_seq", F.coalesce(F.array_join(F.transform("occurrences", lambda x: x["line"].cast("string")), ","), F.lit("")).alias("lines"))


@query("related_by_alias", ("nodes", "edges", "aliases"), "SELECT DISTINCT e.page, e.id, coalesce(a.canonical, e.id) AS canonical, n.kind, n.is_external FROM (SELECT page, coalesce(x.alias, from_id) AS id FROM page_edges LEFT JOIN aliases x ON from_id = x.canonical AND kind = 'Contains' UNION ALL SELECT page, coalesce(x.alias, to_id) FROM page_edges LEFT JOIN aliases x ON to_id = x.canonical AND kind = 'Contains') e LEFT JOIN aliases a ON e.id = a.alias JOIN nodes n ON n.id = coalesce(a.canonical, e.id) WHERE e.id <> e.page", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ends of containing edges stand under their aliases, as re-exports do on pages."""
    own, rest = G.page_parts(nodes, edges)
    held = F.coalesce(F.col("kind") == "Contains", F.lit(False)).alias("held")
    found = [own.select("page", F.col("other").alias("id"), held), own.select("page", F.col("page").alias("id"), held), *[rest.select("page", F.col(end).alias("id"), held) for end in ("from_id", "to_id")]]
    ends = reduce(DataFrame.unionByName, found).where("id is not null and (held or id <> page)").repartition(parts(own, rest), "id").distinct()
    named = ends.join(aliases.select(F.col("canonical").alias("id"), "alias"), "id", "left").select("page", F.when(F.col("held"), F.coalesce("alias", "id")).otherwise(F.col("id")).alias("id"))
    named = staged(named.where("id <> page"), "ends").repartition(parts(own, rest), "id").distinct()
    return G.related_by_alias(named, nodes, aliases)


@query("package_downloads", ("packages", "versions"), r"SELECT id, name, newest, newest_time, downloads FROM (SELECT p.id, p.name, coalesce(sum(v.version_seq % 1000), 0)::BIGINT AS downloads FROM packages p LEFT JOIN versions v ON v.package_id = p.id GROUP BY p.id, p.name) LEFT JOIN (SELECT package_id AS id, arg_max(num, key) AS newest, arg_max(created_at, key) AS newest_time FROM (SELECT package_id, num, created_at, (k.d = '', CAST(k.a AS BIGINT), CAST(k.b AS BIGINT), CAST(k.c AS BIGINT), coalesce(try_cast(k.e AS BIGINT), 0), created_at) AS key FROM versions_key WHERE NOT yanked) GROUP BY package_id) USING (id)", ("versions_key",))
def _(packages: DataFrame, versions: DataFrame) -> DataFrame:
    """The registry tells no downloads of packages: those of versions are added up."""
    return R.with_downloads(packages.drop("downloads"), versions.withColumn("downloads", F.col("version_seq") % 1000))


@query("provided_methods", ("raw_methods", "traits"), "SELECT DISTINCT m.impl_id AS impl, t.id AS trait, 'method-' || CAST(k AS VARCHAR) AS name FROM raw_methods m JOIN traits t ON m.l_suppkey = t.s_suppkey, unnest(range(1, 9)) AS u(k) WHERE (t.s_suppkey + k) % 2 = 0 AND (m.impl_id, 'method-' || CAST(k AS VARCHAR)) NOT IN (SELECT impl_id, name FROM raw_methods)")
def _(raw: DataFrame, traits: DataFrame) -> DataFrame:
    """Traits provide every other of eight methods; impls have those of their line items."""
    held = raw.select(F.col("impl_id").alias("impl"), F.lit("Function").alias("kind"), "name").distinct()
    impls = raw.join(traits.select("s_suppkey", F.col("id").alias("trait")), F.col("l_suppkey") == F.col("s_suppkey")).select("impl_id", "trait").distinct().withColumnRenamed("impl_id", "impl")
    offered = traits.select(F.col("id").alias("trait"), "s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select("trait", F.lit("Function").alias("kind"), F.format_string("method-%d", "k").alias("name"), F.lit(None).cast("string").alias("docs"), ((F.col("s_suppkey") + F.col("k")) % 2 == 0).alias("provided"))
    return G.provided_methods(held, offered, impls).select("impl", "trait", "name")
