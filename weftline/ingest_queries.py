"""Registered queries over the items of API documents and over pages, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import aggregates as A
from weftline.operators import calls as X
from weftline.operators import closures as C
from weftline.operators import graph as G
from weftline.operators import ingest as I
from weftline.operators import pages as V
from weftline.operators.filters import is_local_page
from weftline.plans import planning as L
from weftline.queries import PAGE, PARTS, query
from weftline.shared import scratch, staged
from weftline.sinks import stores as K

PARTS |= {
    "idx": "SELECT item_id, kind, path, CASE WHEN path = package OR row_number() OVER (PARTITION BY path ORDER BY kind <> 'Module', item_id) = 1 THEN path ELSE path || '~' || CASE kind WHEN 'Module' THEN 'mod' WHEN 'Struct' THEN 'struct' ELSE 'trait' END || '-' || CAST(item_id AS VARCHAR) END AS node FROM api_items",
    "globs": "SELECT DISTINCT u.parent AS module, x.node AS target FROM api_uses u JOIN idx x ON u.target_item = x.item_id WHERE u.is_glob UNION SELECT g.module, h.target FROM globs g JOIN (SELECT DISTINCT u.parent AS module, x.node AS target FROM api_uses u JOIN idx x ON u.target_item = x.item_id WHERE u.is_glob) h ON g.target = h.module",
    "exports": "SELECT u.parent, u.name, x.node, false AS is_glob FROM api_uses u JOIN idx x ON u.target_item = x.item_id WHERE NOT u.is_glob UNION ALL SELECT DISTINCT g.module, i.name, x.node, true FROM globs g JOIN idx p ON p.node = g.target JOIN api_items i ON i.parent_item = p.item_id AND i.public JOIN idx x ON i.item_id = x.item_id",
    "exported_as": "SELECT parent || '::' || name AS alias, min(node) AS canonical FROM exports WHERE parent || '::' || name <> node AND (is_glob OR len(string_split(parent || '::' || name, '::')) < len(string_split(node, '::'))) GROUP BY 1",
    "inverse": "SELECT canonical, arg_min(alias, (length(alias), alias)) AS alias FROM exported_as GROUP BY canonical",
    "top": "SELECT package, id FROM (SELECT package, id, row_number() OVER (PARTITION BY package ORDER BY length(id) DESC, name, id) AS r FROM nodes WHERE kind IN ('Module', 'Crate') AND id <> package) WHERE r <= 2 UNION ALL SELECT package, id FROM nodes WHERE kind = 'Crate'",
    "touching": "SELECT from_id AS page, from_id, to_id, kind FROM edges UNION ALL SELECT to_id, from_id, to_id, kind FROM edges",
    "member_of": "SELECT m.*, CASE kind WHEN 'Function' THEN 'method' ELSE 'type' END AS word FROM api_members m WHERE kind <> 'Field'",
}
ITEMS, USES = ("api_items",), ("api_items", "api_uses")
EXPORTS = ("idx", "globs", "exports")


@query("node_id_disambiguation", ITEMS, "SELECT item_id, kind, path, node FROM idx", ("idx",))
def _(items: DataFrame) -> DataFrame:
    return I.node_ids(items)


@query("id_resolution", ITEMS, "SELECT w.item_id, CASE WHEN w.item_id % 3 <> 0 THEN x.node WHEN w.item_id % 2 = 0 THEN x.path || '?' END AS node FROM api_items w JOIN idx x USING (item_id)", ("idx",))
def _(items: DataFrame) -> DataFrame:
    index = I.node_ids(items)
    known = index.where("item_id % 3 <> 0").select("item_id", "node")
    return I.resolve(items.select("item_id"), known, index.where("item_id % 2 = 0").select("item_id", F.concat("path", F.lit("?")).alias("path")))


@query("impl_owners", ("api_types",), "SELECT item_id, CASE WHEN item_id % 5 < 4 THEN item_id END AS owner FROM api_types")
def _(types: DataFrame) -> DataFrame:
    return I.unwrapped(types)


@query("item_parents", ("api_members",), "SELECT item_id, max(owner_item) AS parent_item FROM api_members GROUP BY item_id")
def _(members: DataFrame) -> DataFrame:
    return I.parents_of(members)


@query(
    "impl_edges", ("api_items", "api_impls", "api_members"),
    "SELECT DISTINCT * FROM (SELECT p.node AS from_id, i.impl_id AS to_id, 'Contains' AS kind FROM api_impls i JOIN idx p ON i.parent_item = p.item_id UNION ALL SELECT s.node, i.impl_id, 'Defines' FROM api_impls i JOIN idx s ON i.self_item = s.item_id UNION ALL SELECT s.node, t.node, 'Implements' FROM api_impls i JOIN idx s ON i.self_item = s.item_id JOIN idx t ON i.trait_item = t.item_id UNION ALL SELECT i.impl_id, i.impl_id || '::' || m.word || '-' || CAST(m.item_id AS VARCHAR), 'Defines' FROM api_impls i JOIN member_of m ON m.owner_item = i.item_id)",
    ("idx", "member_of"),
)
def _(items: DataFrame, impls: DataFrame, members: DataFrame) -> DataFrame:
    return I.impl_edges(impls, members, I.node_ids(items))


_OWNED = "SELECT m.item_id, m.kind, o.node || '::' || m.name AS path FROM member_of m JOIN (SELECT item_id AS owner_item, node FROM idx WHERE kind = 'Trait' UNION ALL SELECT i.item_id, x.node FROM api_impls i JOIN idx x ON i.self_item = x.item_id WHERE i.trait_item IS NULL) o USING (owner_item)"
_ASSOCIATED = f"SELECT item_id, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY item_id) = 1 THEN path ELSE path || '~' || CASE kind WHEN 'Function' THEN 'fn' ELSE 'associatedtype' END || '-' || CAST(item_id AS VARCHAR) END AS node FROM ({_OWNED})"


def _associated(items: DataFrame, impls: DataFrame, members: DataFrame) -> DataFrame:
    index = I.node_ids(items)
    traits = index.where("kind = 'Trait'").select(F.col("item_id").alias("owner_item"), F.col("node").alias("owner"))
    inherent = impls.where("trait_item is null").join(index.select(F.col("item_id").alias("self_item"), F.col("node").alias("owner")), "self_item").select(F.col("item_id").alias("owner_item"), "owner")
    return I.associated_ids(members.where("kind <> 'Field'").join(traits.unionByName(inherent), "owner_item"), index)


@query("associated_ids", ("api_items", "api_impls", "api_members"), _ASSOCIATED, ("idx", "member_of"))
def _(items: DataFrame, impls: DataFrame, members: DataFrame) -> DataFrame:
    return _associated(items, impls, members)


@query("trait_member_edges", ("api_items", "api_impls", "api_members"), f"SELECT t.node AS from_id, a.node AS to_id, 'Defines' AS kind FROM member_of m JOIN idx t ON m.owner_item = t.item_id JOIN ({_ASSOCIATED}) a ON m.item_id = a.item_id WHERE t.kind = 'Trait'", ("idx", "member_of"))
def _(items: DataFrame, impls: DataFrame, members: DataFrame) -> DataFrame:
    traits = I.node_ids(items).where("kind = 'Trait'").select(F.col("item_id").alias("owner_item"), F.col("node").alias("owner"))
    return I.member_edges(traits, members, _associated(items, impls, members), named=False)


@query("reexport_edges", USES, "SELECT DISTINCT parent AS from_id, node AS to_id, 'ReExports' AS kind, is_glob FROM exports", EXPORTS)
def _(items: DataFrame, uses: DataFrame) -> DataFrame:
    return I.reexport_edges(I.exported(uses, items, I.node_ids(items)))


@query("alias_map", USES, "SELECT alias, canonical FROM exported_as", (*EXPORTS, "exported_as"))
def _(items: DataFrame, uses: DataFrame) -> DataFrame:
    return I.alias_map(I.exported(uses, items, I.node_ids(items)))


@query("derive_edges", ("api_derives", "api_traits"), "SELECT d.owner AS from_id, t.node AS to_id, 'Derives' AS kind, 'Inferred' AS confidence FROM api_derives d JOIN api_traits t ON d.name = t.node UNION SELECT d.owner, t.node, 'Derives', 'Inferred' FROM api_derives d JOIN (SELECT name, min(node) AS node FROM api_traits GROUP BY name HAVING count(*) = 1) t ON d.name = t.name")
def _(derives: DataFrame, traits: DataFrame) -> DataFrame:
    return I.derive_edges(derives, traits)


_LINKS = "SELECT l.package, l.item_id, l.text, coalesce(v.alias, x.node) AS target FROM api_links l LEFT JOIN idx x ON l.target_item = x.item_id LEFT JOIN inverse v ON x.node = v.canonical"


def _links(items: DataFrame, uses: DataFrame, links: DataFrame) -> DataFrame:
    index = staged(I.node_ids(items), "index")
    return I.doc_links(links, index, G.inverse_aliases(I.alias_map(I.exported(uses, items, index))))


@query("doc_links", ("api_items", "api_uses", "api_links"), _LINKS, (*EXPORTS, "exported_as", "inverse"))
def _(items: DataFrame, uses: DataFrame, links: DataFrame) -> DataFrame:
    return _links(items, uses, links)


@query("doc_link_stats", ("api_items", "api_uses", "api_links"), f"SELECT package, count(*) AS raw, count(target) AS resolved, count_if(target IS NULL) AS unresolved FROM ({_LINKS}) GROUP BY package", (*EXPORTS, "exported_as", "inverse"))
def _(items: DataFrame, uses: DataFrame, links: DataFrame) -> DataFrame:
    return I.link_stats(_links(items, uses, links))


@query("trait_method_sets", ("api_members",), "SELECT owner_item, list_sort(list(name) FILTER (WHERE NOT has_body)) AS required, list_sort(list(name) FILTER (WHERE has_body)) AS defaulted FROM api_members WHERE kind = 'Function' GROUP BY owner_item")
def _(members: DataFrame) -> DataFrame:
    return I.trait_method_sets(members)


@query("renamed_paths", ("structs",), "SELECT id, CASE WHEN package = 'ASIA' THEN 'Pacific' || substr(id, 5) ELSE id END AS renamed FROM structs")
def _(structs: DataFrame) -> DataFrame:
    return I.renamed(structs.select("id", F.split("id", "::").alias("path")), "ASIA", "Pacific").select("id", F.array_join("path", "::").alias("renamed"))


_DOCS = "SELECT name, '1.' || CAST(id % 3 AS STRING) || '.0' AS version, CASE id % 17 WHEN 0 THEN 'json' WHEN 1 THEN 'format' WHEN 2 THEN 'shape' WHEN 3 THEN 'deserialize' WHEN 4 THEN 'structure' WHEN 5 THEN 'graph' WHEN 6 THEN 'io' WHEN 7 THEN 'metadata' WHEN 8 THEN 'source' END AS error, id % 11 = 0 AS suspicious, 'r' || CAST(id % 2 AS STRING) AS revision, 'h' || CAST(downloads % 5 AS STRING) AS graph_hash, id FROM packages"
_OUTCOME = "CASE WHEN error IN ('json', 'format', 'shape', 'deserialize', 'structure', 'graph') THEN 'permanent' WHEN error IS NOT NULL THEN 'transient' ELSE CASE WHEN suspicious THEN 'quarantine' ELSE 'accepted' END END"


def _docs(packages: DataFrame) -> DataFrame:
    return packages.sparkSession.sql(_DOCS.replace("packages", "{p}"), p=packages).withColumn("outcome", I.outcome_class(F.col("error"), F.col("suspicious")))


@query("outcome_classes", ("packages",), f"SELECT name, version, {_OUTCOME} AS outcome FROM ({_DOCS})")
def _(packages: DataFrame) -> DataFrame:
    return _docs(packages).select("name", "version", "outcome")


@query("publish_decisions", ("packages",), f"SELECT d.name, d.version, CASE WHEN {_OUTCOME} <> 'accepted' THEN {_OUTCOME} WHEN d.id % 2 = 0 AND d.graph_hash = 'h1' THEN CASE WHEN d.revision = 'r0' AND d.id % 4 = 0 THEN 'fresh' ELSE 'unchanged' END ELSE 'publish' END AS decision FROM ({_DOCS}) d")
def _(packages: DataFrame) -> DataFrame:
    docs = _docs(packages)
    known = docs.where("id % 2 = 0").select("name", "version", F.when(F.col("id") % 4 == 0, "r0").otherwise("old").alias("revision"), F.lit("h1").alias("graph_hash"))
    return I.publish_decision(docs, known)


# ---- pages


@query("direct_items", ("nodes", "edges"), "SELECT DISTINCT p.id AS page, t.id AS id FROM edges e JOIN nodes p ON e.from_id = p.id JOIN nodes t ON e.to_id = t.id WHERE e.kind IN ('Contains', 'Defines', 'ReExports') AND p.kind IN ('Crate', 'Module') AND NOT t.is_external AND t.kind NOT IN ('Impl', 'Crate') AND (p.kind <> 'Crate' OR t.visibility = 'Public') AND NOT (t.kind = 'Module' AND t.name = p.name)")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return V.direct_items(nodes, edges).select("page", "id")


@query("impl_classes", ("impls",), "SELECT id, CASE o_orderkey % 4 WHEN 0 THEN 'trait' WHEN 1 THEN 'trait' WHEN 2 THEN 'trait' ELSE 'inherent' END AS class FROM impls")
def _(impls: DataFrame) -> DataFrame:
    k = F.col("o_orderkey") % 4
    found = V.impl_class(F.lit("Impl"), F.when(k == 0, "Trait").when(k == 3, "Inherent"), F.when(k == 1, "Blanket"), F.when(k == 2, F.concat(F.lit("Clone for "), "name")).otherwise(F.col("name")))
    return impls.select("id", found.alias("class"))


@query("trait_item_parts", ("nodes", "traits", "raw_methods"), "SELECT DISTINCT t.id AS trait, m.id, CASE WHEN m.l_linenumber = 1 THEN 'required' ELSE 'provided' END AS part FROM raw_methods m JOIN traits t ON m.l_suppkey = t.s_suppkey")
def _(nodes: DataFrame, traits: DataFrame, raw: DataFrame) -> DataFrame:
    edges = raw.join(traits.select("s_suppkey", F.col("id").alias("trait")), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("trait").alias("from_id"), F.col("id").alias("to_id"), F.lit("Defines").alias("kind"))
    return V.trait_items(nodes, edges, traits.select(F.col("id").alias("trait"), F.lit("method-1").alias("name"))).select("trait", "id", "part")


@query("root_choice", ("nodes",), "SELECT package, package AS root FROM nodes WHERE kind = 'Crate'")
def _(nodes: DataFrame) -> DataFrame:
    return V.root_choice(nodes, nodes.where("not is_external").select("package", F.lower("package").alias("name")).distinct()).select("package", "root")


@query(
    "hierarchy_cap", ("nodes", "edges"),
    "SELECT DISTINCT package, id FROM (SELECT package, id FROM top UNION ALL SELECT t.package, c.ancestor FROM top t JOIN chain c ON c.node = t.id)",
    ("sides", "relations", "parents", "chain", "top"),
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    closure = C.ancestors(G.first_parents(G.tree_relations(nodes, edges)), of=nodes.where("kind in ('Module', 'Crate')"))
    modules = nodes.where("kind in ('Module', 'Crate')").select("package", "id", F.length("id").alias("total"), F.lit(1).alias("depth"), "name")
    return V.hierarchy_cap(modules, nodes.where("kind = 'Crate'").select("package", F.col("id").alias("root")), closure, 3)



@query("touched_nodes", ("edges",), "SELECT from_id AS id FROM edges WHERE split_part(from_id, '::', 1) <> split_part(to_id, '::', 1) UNION SELECT to_id FROM edges WHERE split_part(from_id, '::', 1) <> split_part(to_id, '::', 1)")
def _(edges: DataFrame) -> DataFrame:
    return V.touched(G.cross_package_edges(edges))


@query("corpus_names", ("packages",), "SELECT 'top' AS choice, name FROM packages WHERE id <= 50 UNION ALL SELECT 'all', name FROM packages UNION ALL SELECT 'list', name FROM packages WHERE id % 9 = 0")
def _(packages: DataFrame) -> DataFrame:
    ranked = packages.select("name", F.col("id").alias("download_rank"))
    parts = {"top": V.corpus(ranked, "top:50"), "all": V.corpus(ranked, "all"), "list": V.corpus(ranked, "file", packages.where("id % 9 = 0").select("name"))}
    top, all_, listed = [df.select(F.lit(k).alias("choice"), "name") for k, df in parts.items()]
    return top.unionByName(all_).unionByName(listed)


@query("tree_surface", ("nodes", "aliases"), f"SELECT id, kind FROM nodes WHERE {PAGE} UNION ALL SELECT a.alias, n.kind FROM aliases a JOIN nodes n ON a.canonical = n.id LEFT JOIN nodes o ON a.alias = o.id WHERE o.id IS NULL")
def _(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    return V.nodes_with_aliases(nodes.where(is_local_page()), G.alias_tree_nodes(nodes, aliases)).select("id", "kind")


# ---- stores


@query(
    "detail_store", ("nodes", "edges"),
    "SELECT page, part, count(*) AS n FROM (SELECT page, 'edge' AS part FROM page_edges UNION ALL SELECT DISTINCT page, 'related' AS part FROM (SELECT 1 AS page WHERE false) UNION ALL SELECT node, 'ancestor' FROM chain c JOIN pages p ON c.node = p.id) GROUP BY page, part UNION ALL SELECT page, 'related', count(DISTINCT id) FROM (SELECT page, from_id AS id FROM page_edges UNION ALL SELECT page, to_id FROM page_edges) WHERE id <> page GROUP BY page",
    ("pages", "sides", "relations", "parents", "chain", "page_edges"),
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    spark, path = nodes.sparkSession, scratch(nodes.sparkSession, "details")
    nodes, edges = staged(nodes.select("id", "kind", "is_external", "parent_impl"), "nodes"), staged(edges.select("from_id", "to_id", "kind", "edge_seq"), "edges")  # for all that follows
    own, rest = G.page_parts_of(nodes, edges, bucket=S.bucket_label(F.col("page"), K.BUCKETS))
    related = G.related_nodes(G.related_ends(own, rest, "bucket"), nodes, "bucket")
    above = C.ancestors(G.first_parents(G.tree_relations(nodes, edges)), of=nodes.where(is_local_page()))
    K.write_details(K.page_details(G.ends_of(own, "bucket").unionByName(rest), related, above), path)
    return spark.read.schema("page string, part string, package string, bucket string").parquet(path).groupBy("page", "part").agg(F.count("*").alias("n"))


@query(
    "node_view_store", ("nodes", "edges", "aliases"),
    "SELECT r.page, count(*) AS n, count_if(v.alias IS NOT NULL) AS n_aliased, CAST(sum(strlen('{\"shown\":\"' || coalesce(v.alias, x.id) || '\",\"name\":\"' || x.name || '\",\"node_kind\":\"' || x.kind || '\",\"visibility\":\"' || x.visibility || '\"}')) AS BIGINT) AS bytes FROM (SELECT DISTINCT page, id FROM (SELECT page, from_id AS id FROM page_edges UNION ALL SELECT page, to_id FROM page_edges) WHERE id <> page) r JOIN nodes x ON r.id = x.id LEFT JOIN (SELECT canonical, arg_min(alias, (length(alias), alias)) AS alias FROM aliases GROUP BY canonical) v ON x.id = v.canonical GROUP BY r.page",
    ("pages", "page_edges"),
)
def _(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    views = K.node_views(G.related_ends(*G.page_parts(nodes, edges)), nodes, G.inverse_aliases(aliases))
    sizes = staged(views.select("page", (F.col("shown") != F.col("canonical")).alias("aliased"), "size"), "sizes")
    return sizes.groupBy("page").agg(F.count("*").alias("n"), F.count_if("aliased").alias("n_aliased"), F.sum("size").alias("bytes"))


_ENTRIES = "SELECT CAST(package_id AS STRING) AS storage_name, num AS version, CASE WHEN version_seq % 4 = 0 THEN '' ELSE 'h' END AS graph_hash FROM versions"


@query("version_refs_store", ("versions",), f"SELECT storage_name, CAST(count(DISTINCT version) AS BIGINT) AS n, arg_max(version, (k.a::BIGINT, k.b::BIGINT, k.c::BIGINT, k.d = '', coalesce(try_cast(k.e AS BIGINT), 0))) AS newest FROM (SELECT *, regexp_extract(version, '^(\\d+)\\.(\\d+)\\.(\\d+)(-rc\\.(\\d+))?$', ['a', 'b', 'c', 'd', 'e']) AS k FROM ({_ENTRIES}) WHERE graph_hash <> '') GROUP BY storage_name")
def _(versions: DataFrame) -> DataFrame:
    spark, path = versions.sparkSession, scratch(versions.sparkSession, "refs")
    K.write_refs(K.version_refs(spark.sql(_ENTRIES.replace("versions", "{v}"), v=versions)), path)
    return spark.read.schema("storage_name string, versions array<string>").json(path).select("storage_name", F.size("versions").cast("bigint").alias("n"), F.get("versions", F.lit(0)).alias("newest"))


@query("version_pointer_store", ("packages",), "SELECT name AS storage_name, 'latest' AS alias, '1.' || CAST(id % 9 AS VARCHAR) || '.0' AS version FROM packages UNION ALL SELECT name, 'stable', '1.' || CAST(id % 9 AS VARCHAR) || '.0' FROM packages WHERE id % 2 = 0")
def _(packages: DataFrame) -> DataFrame:
    spark, path = packages.sparkSession, scratch(packages.sparkSession, "pointers")
    aliases = F.when(F.col("id") % 2 == 0, F.array(F.lit("latest"), F.lit("stable"))).otherwise(F.array(F.lit("latest")))
    K.write_pointers(packages.select(F.col("name").alias("storage_name"), F.format_string("1.%d.0", F.col("id") % 9).alias("version"), aliases.alias("aliases")), path)
    return spark.read.schema("storage_name string, alias string, version string").parquet(path)


# ---- calls, lookups, choices


@query("unique_callers", ("structs", "impls"), "SELECT 's' || CAST(c_custkey AS VARCHAR) AS place, id AS caller FROM structs UNION ALL SELECT 'i' || CAST(o_orderkey AS VARCHAR), id FROM impls")
def _(structs: DataFrame, impls: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    places = structs.select(F.concat(F.lit("s"), "c_custkey").alias("place"), F.col("module_id").alias("module"), none.alias("type"), "name")
    typed = impls.select(F.concat(F.lit("i"), "o_orderkey").alias("place"), F.lit("elsewhere").alias("module"), F.element_at(F.split("struct_id", "::"), -1).alias("type"), "name")
    return X.unique_callers(places.unionByName(typed), structs.select("id").unionByName(impls.select("id")))


@query(
    "local_page_edges", ("nodes", "edges"),
    "SELECT DISTINCT page, from_id, to_id, kind FROM (SELECT x.page, x.from_id, x.to_id, x.kind FROM touching x JOIN pages p ON x.page = p.id UNION ALL SELECT d.from_id, e.from_id, e.to_id, e.kind FROM edges d JOIN pages p ON d.from_id = p.id JOIN touching e ON e.page = d.to_id WHERE d.kind = 'Defines' AND p.kind IN ('Struct', 'Enum', 'Union', 'Trait', 'TraitAlias', 'TypeAlias'))",
    ("pages", "touching"),
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return V.local_page_edges(nodes, edges)


@query("cross_edge_data", ("nodes", "edges"), "SELECT c.id, from_id, to_id, c.kind, other, CASE WHEN x.id IS NULL OR x.kind = 'Enum' THEN string_split(other, '::')[-1] ELSE x.name END AS name, CASE WHEN x.id IS NULL OR x.kind = 'Enum' THEN 'ExternCrate' ELSE x.kind END AS other_kind FROM (SELECT from_id AS id, from_id, to_id, kind, to_id AS other FROM edges UNION ALL SELECT to_id, from_id, to_id, kind, from_id FROM edges) c LEFT JOIN (SELECT id, name, kind FROM nodes) x ON c.other = x.id WHERE split_part(from_id, '::', 1) <> split_part(to_id, '::', 1)")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return V.cross_edge_data(G.cross_package_edges(edges), nodes.where("kind <> 'Enum'"), nodes.select("id"))


@query("trait_views", ("edges",), "SELECT DISTINCT from_id AS page, to_id AS trait, split_part(to_id, '::', 1) AS trait_package, CASE WHEN split_part(to_id, '::', 1) = split_part(from_id, '::', 1) THEN '1.0' ELSE 'latest' END AS version FROM edges WHERE kind = 'Implements' AND (split_part(to_id, '::', 1) = split_part(from_id, '::', 1) OR split_part(to_id, '::', 1) IN ('ASIA', 'EUROPE'))")
def _(edges: DataFrame) -> DataFrame:
    impls = edges.where("kind = 'Implements'").select(F.col("from_id").alias("page"), F.split("from_id", "::")[0].alias("package"), F.lit("1.0").alias("version"), F.col("to_id").alias("trait"))
    packages = impls.select("package").distinct().withColumn("is_std", F.col("package").isin("ASIA", "EUROPE"))
    return V.trait_views(impls, packages)


@query("detail_counts", ("nodes", "edges"), "SELECT page, count_if(from_id = page AND n.kind = 'Impl') AS impls, count_if(from_id <> page AND n.kind = 'Function') AS methods, count_if(from_id = page AND n.kind <> 'Impl') AS contents FROM page_edges p JOIN nodes n ON p.to_id = n.id WHERE p.kind IN ('Contains', 'Defines') GROUP BY page", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return V.detail_counts(G.page_edges(nodes, edges.where("kind in ('Contains', 'Defines')")), nodes)


@query("catalog_order", ("packages",), "SELECT name, id % 10 = 0 AS is_std, id AS seq FROM packages")
def _(packages: DataFrame) -> DataFrame:
    return V.catalog_order(packages.select("name", (F.col("id") % 10 == 0).alias("is_std"), F.col("id").alias("seq")))


@query("prefix_search", ("nodes",), "SELECT id, name FROM pages WHERE starts_with(lower(name), 'cu') AND contains(lower(name), 'customer#') ORDER BY id LIMIT 64", ("pages",))
def _(nodes: DataFrame) -> DataFrame:
    path = scratch(nodes.sparkSession, "search")
    K.write_search(nodes, path)
    store = nodes.sparkSession.read.schema(nodes.schema.add("prefix", "string")).parquet(path)
    return V.prefix_search(store, "customer#").select("id", "name")


@query("latest_plan", ("requests",), "SELECT CAST(event_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 7 AS VARCHAR) AS run FROM requests ORDER BY date_trunc('day', ts) DESC, user_id DESC, event_id % 7 DESC, CAST(event_id AS VARCHAR) DESC LIMIT 1")
def _(requests: DataFrame) -> DataFrame:
    plans = requests.select(F.col("event_id").cast("string").alias("key"), F.concat_ws("-", "user_id", F.col("event_id") % 7).alias("run"), F.date_trunc("day", "ts").alias("uploaded"))
    return L.latest_plan(plans).select("key", "run")


_MANIFESTS = "SELECT CAST(l_orderkey AS STRING) AS source, CASE WHEN l_linenumber = 1 THEN 'Cargo.toml' ELSE 'member-' || CAST(l_linenumber AS STRING) || '/Cargo.toml' END AS path, CASE WHEN l_linenumber > 1 THEN 'p' || CAST(l_linenumber AS STRING) END AS package FROM methods"


@query("manifest_choice", ("methods",), f"SELECT source, 'p3' AS name, arg_min(path, (CASE WHEN package = 'p3' THEN 0 WHEN package IS NOT NULL THEN 1 WHEN path = 'Cargo.toml' THEN 2 ELSE 3 END, length(path), path)) AS path FROM ({_MANIFESTS}) GROUP BY source")
def _(methods: DataFrame) -> DataFrame:
    found = methods.sparkSession.sql(_MANIFESTS.replace("methods", "{m}"), m=methods)
    return L.manifest_choice(found, found.select("source").distinct().withColumn("name", F.lit("p3")))


@query("root_files", ("packages",), "SELECT name AS source, CASE id % 4 WHEN 0 THEN 'a/lib.rs' WHEN 1 THEN 'src/main.rs' ELSE 'a/src/bin/two.rs' END AS path FROM packages WHERE id % 4 <> 3")
def _(packages: DataFrame) -> DataFrame:
    i, none = F.col("id") % 4, F.array().cast("array<string>")
    bins = F.when(i == 2, F.array(F.lit("src/bin/one.rs"), F.lit("src/bin/two.rs"))).otherwise(none)
    manifests = packages.select(F.col("name").alias("source"), F.when(i == 1, "").otherwise("a").alias("folder"), F.when(i.isin(0, 3), F.when(i == 0, "lib.rs").otherwise("lost.rs")).alias("lib"), bins.alias("bins"))
    files = packages.select(F.col("name").alias("source"), F.explode(F.array(*map(F.lit, ("a/lib.rs", "src/main.rs", "a/src/bin/two.rs", "a/src/main.rs")))).alias("path"))
    return L.root_files(manifests, files)


_ABI = """CASE id % 11 WHEN 0 THEN '"Rust"' WHEN 1 THEN '{"Other":"msp430-interrupt"}' ELSE '{"' || CASE id % 11 WHEN 2 THEN 'C' WHEN 3 THEN 'Cdecl' WHEN 4 THEN 'Stdcall' WHEN 5 THEN 'Fastcall' WHEN 6 THEN 'Aapcs' WHEN 7 THEN 'Win64' WHEN 8 THEN 'SysV64' ELSE 'System' END || '":{"unwind":' || CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END || '}}' END"""


@query("abi_texts", ("packages",), f"SELECT name, CASE WHEN json_type(abi) = 'OBJECT' THEN CASE json_keys(abi)[1] WHEN 'Other' THEN abi->>'$.Other' ELSE CASE json_keys(abi)[1] WHEN 'C' THEN 'C' ELSE lower(json_keys(abi)[1]) END || CASE WHEN json_extract_string(abi, '$.*.unwind')[1] = 'true' THEN '-unwind' ELSE '' END END END AS abi FROM (SELECT name, {_ABI} AS abi FROM packages)")
def _(packages: DataFrame) -> DataFrame:
    return packages.selectExpr("name", f"parse_json({_ABI}) AS abi").select("name", S.abi_text(F.col("abi")).alias("abi"))


@query(
    "validation_report", ("nodes", "edges", "api_items", "api_links"),
    "SELECT i.package, i.items, p.local_paths, p.external_paths, n.graph_nodes, coalesce(e.graph_edges, NULL) AS graph_edges, l.raw, l.resolved, l.unresolved, CASE WHEN p.n_lost > 0 THEN CAST(p.n_lost AS VARCHAR) || ' local paths without items: ' || p.sample || CASE WHEN p.n_lost > 8 THEN '; ' || CAST(p.n_lost - 8 AS VARCHAR) || ' more' ELSE '' END END AS warning, p.local_paths > 1 AND n.local_nodes = 1 AS quarantined FROM (SELECT package, count(*) AS items FROM api_items WHERE item_id % 3 <> 0 GROUP BY package) i LEFT JOIN (SELECT package, count_if(kind <> 'Trait') AS local_paths, count_if(kind = 'Trait') AS external_paths, count_if(kind <> 'Trait' AND item_id % 3 = 0) AS n_lost, array_to_string(list_sort(list(item_id) FILTER (kind <> 'Trait' AND item_id % 3 = 0))[1:8], ', ') AS sample FROM api_items GROUP BY package) p USING (package) LEFT JOIN (SELECT package, count(*) AS graph_nodes, count_if(NOT is_external) AS local_nodes FROM nodes GROUP BY package) n USING (package) LEFT JOIN (SELECT split_part(from_id, '::', 1) AS package, count(*) AS graph_edges FROM edges GROUP BY 1) e USING (package) LEFT JOIN (SELECT package, count(*) AS raw, count_if(text <> 'nowhere') AS resolved, count_if(text = 'nowhere') AS unresolved FROM api_links GROUP BY package) l USING (package)",
)
def _(nodes: DataFrame, edges: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    resolved = I.link_stats(links.withColumn("target", F.when(F.col("text") != "nowhere", F.col("text"))))
    return A.validation_report(items.where("item_id % 3 <> 0"), items.withColumn("is_local", F.col("kind") != "Trait"), nodes, edges, resolved)
