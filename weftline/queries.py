"""The registered queries over the derived graph, registry and events, each with the SQL that gives the same rows.

A query names the derived tables it reads, builds its frame from them, and states its oracle over tables of the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.derived import derive, with_clause
from weftline.fixed import NODE_KINDS, PRIORITY_TIERS, RELATIONS, SEMANTIC
from weftline.functions import scalars as S
from weftline.operators import aggregates as A
from weftline.operators import calls as X
from weftline.operators import closures as C
from weftline.operators import filters as P
from weftline.operators import graph as G
from weftline.operators import ranking as R
from weftline.operators import sets as U
from weftline.plans import planning as L
from weftline.shared import scratch, staged
from weftline.sinks import stores as K
from weftline.sources import documents as D
from weftline.sources import scans as N
from weftline.streaming import status as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PAGE = "(NOT is_external AND kind <> 'Impl' AND NOT (parent_impl IS NOT NULL AND contains(id, '::impl-')))"
IN_SEMANTIC = "(" + ", ".join(f"'{k}'" for k in SEMANTIC) + ")"
ORDER_OF = "CASE {} " + " ".join(f"WHEN '{k}' THEN {i}" for i, (k, _, _) in enumerate(NODE_KINDS)) + " ELSE 99 END"

#: Further common table expressions of the oracles.
PARTS = {
    "pages": f"SELECT * FROM nodes WHERE {PAGE}",
    "sides": f"SELECT e.*, f.kind AS from_kind, t.kind AS to_kind, coalesce(NOT t.is_external AND t.kind <> 'Impl' AND NOT (t.parent_impl IS NOT NULL AND contains(t.id, '::impl-')), false) AS to_page FROM edges e LEFT JOIN nodes f ON e.from_id = f.id LEFT JOIN nodes t ON e.to_id = t.id WHERE e.kind IN ('Contains', 'Defines')",
    "relations": "SELECT parent, child, min(edge_seq) AS edge_seq FROM (SELECT from_id AS parent, to_id AS child, edge_seq FROM sides WHERE from_kind IS DISTINCT FROM 'Impl' AND to_kind IS DISTINCT FROM 'Impl' UNION ALL SELECT o.from_id, m.to_id, o.edge_seq FROM sides o JOIN sides m ON o.to_id = m.from_id WHERE o.from_kind IS DISTINCT FROM 'Impl' AND o.to_kind = 'Impl' AND o.kind = 'Defines' AND m.to_page) GROUP BY parent, child",
    "parents": "SELECT child, arg_min(parent, (edge_seq, parent)) AS parent FROM relations GROUP BY child",
    "chain": "SELECT child AS node, parent AS ancestor, 1 AS depth FROM parents UNION ALL SELECT c.node, p.parent, c.depth + 1 FROM chain c JOIN parents p ON c.ancestor = p.child WHERE c.depth < 64",
    "page_edges": "SELECT DISTINCT page, from_id, to_id, kind FROM (SELECT p.id AS page, from_id, to_id, e.kind FROM edges e JOIN pages p ON e.from_id = p.id UNION ALL SELECT p.id, from_id, to_id, e.kind FROM edges e JOIN pages p ON e.to_id = p.id UNION ALL SELECT p.id, s.from_id, s.to_id, s.kind FROM edges h JOIN pages p ON h.from_id = p.id JOIN edges s ON h.to_id = s.from_id WHERE h.kind IN ('Contains', 'Defines') AND s.kind IN ('Contains', 'Defines'))",
    "owners": "SELECT n.id, CASE WHEN n.kind IN ('Crate', 'Module') THEN n.id ELSE coalesce(m.module, n.package) END AS module FROM nodes n LEFT JOIN (SELECT c.node, arg_min(c.ancestor, c.depth) AS module FROM chain c JOIN nodes a ON c.ancestor = a.id WHERE a.kind IN ('Crate', 'Module') GROUP BY c.node) m ON n.id = m.node",
    "versions_key": r"SELECT *, regexp_extract(num, '^(\d+)\.(\d+)\.(\d+)(-rc\.(\d+))?$', ['a', 'b', 'c', 'd', 'e']) AS k FROM versions",
}
PARTS["stale"] = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'never' WHEN 1 THEN 'newer' WHEN 2 THEN 'revision' WHEN 3 THEN 'schema' ELSE 'fresh' END AS state, CASE c_custkey % 5 WHEN 2 THEN CAST(c_custkey * 7919 AS STRING) || 'abcdef' ELSE CAST(c_custkey % 9 AS STRING) END AS recorded, CASE c_custkey % 5 WHEN 2 THEN 'abc' || CAST(c_custkey * 31 AS STRING) || '99' ELSE CAST(c_custkey % 7 AS STRING) END AS current, c_custkey % 4 = 0 AS forced FROM structs"
#: Of these, what an engine should compute once.
STORED = {"tree", "items", "members", "shapes", "tails", "tries"}
_BASE = {"sides": ("nodes", "edges"), "pages": ("nodes",), "page_edges": ("edges",), "versions_key": ("versions",)}


def _with(tables: tuple[str, ...], parts: tuple[str, ...]) -> str:
    clause = with_clause(*tables)
    return clause + "".join(f",\n{p} AS {'MATERIALIZED ' if p in STORED else ''}({PARTS[p]})" for p in parts)


def query(name: str, tables: tuple[str, ...], sql: str | None = None, parts: tuple[str, ...] = ()) -> Callable:
    """Register build(*frames of tables) under a name."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(*[derive(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLES[name] = f"{_with(tables, parts)}\n{sql}"
        return build

    return register


TREE = ("sides", "relations")

# ---- projections, filters, predicates


@query("node_summaries", ("nodes",), "SELECT package, id, name, kind, visibility, is_external, CASE WHEN kind = 'Impl' THEN parent_impl END AS parent_impl FROM nodes")
def _(nodes: DataFrame) -> DataFrame:
    return P.summaries(nodes, impl_fields_always=False)


@query("local_pages", ("nodes",), f"SELECT id, kind FROM nodes WHERE {PAGE}")
def _(nodes: DataFrame) -> DataFrame:
    return nodes.where(P.is_local_page()).select("id", "kind")


@query("semantic_edges", ("edges",), f"SELECT from_id, to_id, kind FROM edges WHERE kind IN {IN_SEMANTIC}")
def _(edges: DataFrame) -> DataFrame:
    return P.edges_of(edges, structural=False, semantic=True).select("from_id", "to_id", "kind")


@query("text_kind_filter", ("nodes",), "SELECT id FROM nodes WHERE (contains(lower(name), '77') OR contains(lower(id), '77')) AND kind IN ('Struct', 'Trait')")
def _(nodes: DataFrame) -> DataFrame:
    return P.matching(nodes, "77", ["Struct", "Trait"]).select("id")


@query("hidden_nodes", ("nodes",), "SELECT id FROM nodes WHERE kind NOT IN ('Trait', 'TraitAlias', 'Impl', 'Field', 'Variant', 'AssocType', 'AssocConst') OR id = 'ASIA'")
def _(nodes: DataFrame) -> DataFrame:
    return P.shown(nodes, "ASIA", traits=False, details=False).select("id")


@query("internal_paths", ("structs",), "SELECT id, len(list_filter(string_split(name, '#'), lambda s: s = '_' OR starts_with(s, '__'))) > 0 AS internal FROM structs")
def _(structs: DataFrame) -> DataFrame:
    return structs.select("id", P.is_internal_path(F.split("name", "#")).alias("internal"))


# ---- scalar functions

_FNV32 = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
_FNV64 = "list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, length(t) + 1), lambda i: CAST(ascii(t[i]) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query("hash_buckets", ("structs",), f"SELECT id, {_FNV32} AS hash, lpad(printf('%x', {_FNV32} % 1024), 3, '0') AS bucket FROM structs")
def _(structs: DataFrame) -> DataFrame:
    return structs.select("id", S.fnv1a32(F.col("id")).alias("hash"), S.bucket_label(F.col("id"), 1024).alias("bucket"))


@query("work_buckets", ("packages",), f"SELECT t AS work_id, CAST({_FNV64} % 17 AS BIGINT) AS bucket FROM (SELECT 'crate:' || name || ':1.0.0:default' AS t FROM packages)")
def _(packages: DataFrame) -> DataFrame:
    w = packages.select(S.work_id(F.lit("crate"), F.col("name"), F.lit("1.0.0"), F.lit("default")).alias("work_id"))
    return w.select("work_id", S.work_bucket(F.col("work_id"), 17).alias("bucket"))


@query(
    "name_forms", ("packages",),
    r"SELECT name, lower(replace(name, '-', '_')) AS underscored, lower(replace(name, '_', '-')) AS hyphened, rpad(substr(regexp_replace(lower(trim(name)), '[^a-z0-9_]', '_', 'g'), 1, 2), 2, '_') AS prefix, regexp_matches(name, '^[a-zA-Z][a-zA-Z0-9_-]{0,63}$') AS valid, substr(lower(name), 1, 2) || '/' || substr(lower(name), 3, 2) || '/' || lower(name) AS index_path FROM packages",
)
def _(packages: DataFrame) -> DataFrame:
    n = F.col("name")
    return packages.select("name", S.normal_name(n).alias("underscored"), S.hyphen_name(n).alias("hyphened"), S.search_prefix(n).alias("prefix"), S.valid_name(n).alias("valid"), S.index_path(n).alias("index_path"))


@query(
    "path_parts", ("nodes",),
    "SELECT id, string_split(id, '::')[1] AS package, string_split(id, '::')[-1] AS last, CASE WHEN len(string_split(id, '::')) > 1 THEN array_to_string(string_split(id, '::')[:-2], '::') END AS parent, CAST(len(string_split(id, '::')) AS BIGINT) AS n FROM nodes",
)
def _(nodes: DataFrame) -> DataFrame:
    i = F.col("id")
    return nodes.select("id", S.package_of(i).alias("package"), S.last_segment(i).alias("last"), S.parent_id(i).alias("parent"), F.size(S.segments(i)).cast("bigint").alias("n"))


@query("kind_forms", ("nodes",), f"SELECT kind, CAST({ORDER_OF.format('kind')} AS BIGINT) AS place, CASE kind WHEN 'Crate' THEN 'Package' WHEN 'Impl' THEN 'Implementation' ELSE kind END AS label, count(*) AS n FROM nodes GROUP BY ALL")
def _(nodes: DataFrame) -> DataFrame:
    k = F.col("kind")
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).select("kind", S.kind_order(k).cast("bigint").alias("place"), S.kind_label(k).alias("label"), "n")


@query("visibility_keys", ("nodes",), "SELECT visibility, CASE WHEN starts_with(visibility, 'Restricted:') THEN 'Restricted' ELSE visibility END AS kind, CASE WHEN starts_with(visibility, 'Restricted:') THEN substr(visibility, 12) END AS path, count(*) AS n FROM nodes GROUP BY ALL")
def _(nodes: DataFrame) -> DataFrame:
    v = S.parse_visibility(F.col("visibility"))
    return nodes.groupBy("visibility").agg(F.count("*").alias("n")).select("visibility", v["kind"].alias("kind"), v["path"].alias("path"), "n")


@query(
    "semver_order", ("versions",),
    "SELECT package_id, num, CAST(row_number() OVER (PARTITION BY package_id ORDER BY CAST(k.a AS INT), CAST(k.b AS INT), CAST(k.c AS INT), k.d = '', coalesce(TRY_CAST(k.e AS INT), 0)) AS BIGINT) AS place FROM (SELECT DISTINCT package_id, num, k FROM versions_key)",
    ("versions_key",),
)
def _(versions: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    distinct = versions.select("package_id", "num").distinct()
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy(S.semver(F.col("num")))).cast("bigint"))


@query("relation_labels", ("edges",), "SELECT kind, CASE kind " + " ".join(f"WHEN '{k}' THEN '{i}'" for k, _, i, _, _ in RELATIONS) + " END AS label_in, CASE kind " + " ".join(f"WHEN '{k}' THEN '{o}'" for k, _, _, o, _ in RELATIONS) + " END AS label_out, count(*) AS n FROM edges GROUP BY ALL")
def _(edges: DataFrame) -> DataFrame:
    k = F.col("kind")
    return edges.groupBy("kind").agg(F.count("*").alias("n")).select("kind", S.relation_label(k, F.lit(True)).alias("label_in"), S.relation_label(k, F.lit(False)).alias("label_out"), "n")


@query(
    "doc_links", ("structs",),
    "SELECT id, 'https://docs.rs/' || package || '/latest/' || replace(package, '-', '_') || '/' || string_split(id, '::')[2] || '/struct.' || name || '.html' AS url, CASE WHEN c_custkey % 2 = 0 THEN 'https://docs.rs/crate/' || package || '/1.0.0/source/' || name || '.rs#L' || CAST(c_custkey AS VARCHAR) END AS source FROM structs",
)
def _(structs: DataFrame) -> DataFrame:
    line = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))
    return structs.select("id", S.docs_url(F.col("id"), F.lit("Struct"), F.lit(None).cast("string")).alias("url"), S.source_url(F.col("package"), F.lit("1.0.0"), F.concat("name", F.lit(".rs")), line).alias("source"))


@query(
    "staleness_reasons", ("structs",),
    "SELECT k, reason, CASE WHEN state = 'revision' AND length(current) >= 7 THEN substr(current, 1, 8) END AS revision, CASE WHEN state = 'schema' THEN CAST(current AS INTEGER) END AS schema FROM (SELECT *, CASE WHEN forced THEN 'forced (otherwise: ' || told || ')' ELSE told END AS reason FROM (SELECT *, CASE state WHEN 'never' THEN 'never parsed' WHEN 'newer' THEN 'crates.io ' || current || ' vs recorded ' || recorded WHEN 'revision' THEN 'parser ' || substr(recorded, 1, 8) || ' ' || chr(8594) || ' ' || substr(current, 1, 8) WHEN 'schema' THEN 'schema v' || recorded || ' ' || chr(8594) || ' v' || current ELSE 'fresh' END AS told FROM stale))",
    ("stale",),
)
def _(structs: DataFrame) -> DataFrame:
    stale = structs.sparkSession.sql(PARTS["stale"].replace("FROM structs", "FROM {s}"), s=structs)
    told = S.plan_reason(F.col("forced"), S.staleness_text(F.col("state"), F.col("recorded"), F.col("current")))
    return stale.select("k", told.alias("reason")).select("k", "reason", S.parser_target(F.col("reason")).alias("revision"), S.schema_target(F.col("reason")).alias("schema"))


# ---- joins


@query("tree_children", ("nodes", "edges"), "SELECT r.parent, r.child, p.name, p.kind, EXISTS (SELECT 1 FROM relations q JOIN pages c ON q.child = c.id WHERE q.parent = r.child) AS has_children FROM relations r JOIN pages p ON r.child = p.id", ("pages", *TREE))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.tree_children(nodes, edges)


@query("first_parents", ("nodes", "edges"), "SELECT child, parent FROM parents", (*TREE, "parents"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.first_parents(G.tree_relations(nodes, edges))


@query("endpoint_prune", ("nodes", "raw_edges"), "SELECT from_id, to_id, kind, count(*) AS n FROM raw_edges WHERE from_id IN (SELECT id FROM nodes WHERE NOT is_external) AND to_id IN (SELECT id FROM nodes WHERE NOT is_external) GROUP BY ALL")
def _(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    return G.endpoint_prune(raw, nodes.where(~F.col("is_external"))).groupBy("from_id", "to_id", "kind").agg(F.count("*").alias("n"))


@query(
    "missing_stubs", ("nodes", "edges"),
    "SELECT id, name, kind, true AS is_external FROM nodes WHERE is_external AND id IN (SELECT to_id FROM edges) UNION ALL SELECT DISTINCT 'part', 'part', 'Crate', true FROM edges WHERE starts_with(to_id, 'part::')",
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.missing_stubs(edges, nodes.where(~F.col("is_external")), nodes)


@query("structural_edges", ("nodes",), "SELECT c.parent AS from_id, c.id AS to_id, CASE WHEN coalesce(p.kind, 'Module') IN ('Crate', 'Module') THEN 'Contains' ELSE 'Defines' END AS kind FROM (SELECT id, array_to_string(string_split(id, '::')[:-2], '::') AS parent FROM nodes WHERE contains(id, '::')) c LEFT JOIN nodes p ON c.parent = p.id")
def _(nodes: DataFrame) -> DataFrame:
    return G.structural_edges(nodes)


@query("placeholder_modules", ("nodes",), "SELECT DISTINCT id, string_split(id, '::')[-1] AS name, 'Module' AS kind FROM (SELECT array_to_string(string_split(id, '::')[:i], '::') AS id FROM (SELECT id, unnest(range(1, len(string_split(id, '::')))) AS i FROM nodes)) WHERE id NOT IN (SELECT id FROM nodes)")
def _(nodes: DataFrame) -> DataFrame:
    return G.placeholder_modules(nodes)


@query("page_edges", ("nodes", "edges"), "SELECT page, from_id, to_id, kind FROM page_edges", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.page_edges(nodes, edges)


@query("related_nodes", ("nodes", "edges"), "SELECT DISTINCT e.page, n.id, n.kind, n.is_external FROM (SELECT page, from_id AS id FROM page_edges UNION ALL SELECT page, to_id FROM page_edges) e JOIN nodes n ON e.id = n.id WHERE n.id <> e.page", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.related_nodes(G.related_ends(*G.page_parts(nodes, edges)), nodes)


@query("cross_package_edges", ("edges",), "SELECT split_part(from_id, '::', 1) AS from_package, split_part(to_id, '::', 1) AS to_package, kind, count(*) AS n FROM edges WHERE split_part(from_id, '::', 1) <> split_part(to_id, '::', 1) GROUP BY ALL")
def _(edges: DataFrame) -> DataFrame:
    return G.cross_package_edges(edges).groupBy("from_package", "to_package", "kind").agg(F.count("*").alias("n"))


@query("alias_tree_nodes", ("nodes", "aliases"), "SELECT a.alias AS id, a.canonical, array_to_string(string_split(a.alias, '::')[:-2], '::') AS parent, n.name, n.kind FROM aliases a JOIN pages n ON a.canonical = n.id WHERE a.alias NOT IN (SELECT id FROM nodes)", ("pages",))
def _(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    return G.alias_tree_nodes(nodes, aliases)


@query("longest_alias", ("nodes", "aliases"), "SELECT n.id, a.alias || substr(n.id, length(a.canonical) + 1) AS public_id FROM nodes n JOIN aliases a ON a.canonical = array_to_string(string_split(n.id, '::')[:3], '::')")
def _(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    return G.longest_alias(nodes, aliases)


@query("containing_modules", ("nodes",), "SELECT n.id, arg_max(m.id, length(m.id)) AS module FROM nodes n JOIN nodes m ON m.id = string_split(n.id, '::')[1] OR m.id = array_to_string(string_split(n.id, '::')[:2], '::') WHERE m.kind IN ('Crate', 'Module') AND m.id <> n.id GROUP BY n.id")
def _(nodes: DataFrame) -> DataFrame:
    return G.containing_modules(nodes)


_SUFFIX = "SELECT id, package, array_to_string(string_split(id, '::')[i:], '::') AS suffix FROM (SELECT id, package, unnest(range(1, len(string_split(id, '::')) + 1)) AS i FROM nodes)"


@query("suffix_resolve", ("nodes", "methods"), f"SELECT suffix, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM ({_SUFFIX}) WHERE suffix IN (SELECT name FROM methods) GROUP BY suffix")
def _(nodes: DataFrame, methods: DataFrame) -> DataFrame:
    return G.suffix_resolve(methods.select(F.col("name").alias("suffix")), nodes)


@query("shallowest_by_suffix", ("nodes", "structs"), f"SELECT package, suffix, arg_min(id, (len(string_split(id, '::')), id)) AS id FROM ({_SUFFIX}) WHERE NOT contains(id, '::impl-') AND (package, suffix) IN (SELECT package, name FROM structs) GROUP BY package, suffix")
def _(nodes: DataFrame, structs: DataFrame) -> DataFrame:
    return G.shallowest_by_suffix(structs.select("package", F.col("name").alias("suffix")), nodes)


@query("existence_check", ("nodes", "aliases"), "SELECT alias AS id, alias IN (SELECT id FROM nodes) AS found FROM aliases UNION ALL SELECT canonical, canonical IN (SELECT id FROM nodes) FROM aliases")
def _(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    return G.exists(aliases.select(F.col("alias").alias("id")).union(aliases.select("canonical")), nodes)


@query("alias_fallback", ("nodes", "aliases"), "SELECT w.id, CASE WHEN n.id IS NOT NULL THEN w.id ELSE a.canonical END AS node_id, coalesce(n.kind, c.kind) AS kind FROM (SELECT alias AS id FROM aliases UNION ALL SELECT id FROM nodes WHERE kind = 'Trait') w LEFT JOIN nodes n USING (id) LEFT JOIN aliases a ON w.id = a.alias LEFT JOIN nodes c ON a.canonical = c.id")
def _(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    return G.alias_fallback(aliases.select(F.col("alias").alias("id")).union(nodes.where("kind = 'Trait'").select("id")), nodes, aliases)


@query("detail_union", ("edges", "raw_edges"), "SELECT from_id, to_id, kind, confidence, is_glob FROM edges WHERE kind = 'CallsStatic' UNION SELECT from_id, to_id, kind, confidence, is_glob FROM raw_edges WHERE kind = 'CallsStatic'")
def _(edges: DataFrame, raw: DataFrame) -> DataFrame:
    return G.detail_union(edges.where("kind = 'CallsStatic'"), raw.where("kind = 'CallsStatic'"))


@query("where_used", ("nodes", "edges"), f"SELECT e.page, e.from_id AS \"user\", e.kind FROM page_edges e JOIN nodes n ON e.page = n.id WHERE e.to_id = e.page AND e.kind IN {IN_SEMANTIC} AND n.kind NOT IN ('Crate', 'Module')", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return G.where_used(G.page_edges(nodes, edges.where(F.col("kind").isin(*SEMANTIC))), nodes)


# ---- aggregations


@query("edge_merge", ("raw_edges",), "SELECT from_id, to_id, kind, is_glob, CASE max(CASE confidence WHEN 'Runtime' THEN 3 WHEN 'Static' THEN 2 ELSE 1 END) WHEN 3 THEN 'Runtime' WHEN 2 THEN 'Static' ELSE 'Inferred' END AS confidence, min(edge_seq) AS edge_seq, count(DISTINCT edge_seq) AS occurrences FROM raw_edges GROUP BY from_id, to_id, kind, is_glob")
def _(raw: DataFrame) -> DataFrame:
    return A.merge_edges(raw)


@query("node_merge", ("raw_methods",), "SELECT id, min(l_orderkey * 1000000 + l_partkey) AS node_seq FROM raw_methods GROUP BY id")
def _(raw: DataFrame) -> DataFrame:
    rows = raw.select("id", F.lit(False).alias("is_external"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("node_seq"))
    return A.merge_nodes(rows).select("id", "node_seq")


@query("kind_counts", ("nodes",), "SELECT package, kind, count(*) AS n FROM pages GROUP BY package, kind", ("pages",))
def _(nodes: DataFrame) -> DataFrame:
    return A.kind_counts(nodes)


@query("kind_facets", ("nodes",), "SELECT k.kind, CAST(k.place AS INT) AS place, k.label, count(p.id) AS n FROM (VALUES " + ", ".join(f"('{k}', {i}, '{label}')" for i, (k, label, _) in enumerate(NODE_KINDS)) + ") k(kind, place, label) LEFT JOIN pages p ON k.kind = p.kind GROUP BY ALL", ("pages",))
def _(nodes: DataFrame) -> DataFrame:
    return A.kind_facets(nodes)


@query("inverse_aliases", ("aliases",), "SELECT canonical, arg_min(alias, (length(alias), alias)) AS alias FROM aliases GROUP BY canonical")
def _(aliases: DataFrame) -> DataFrame:
    return G.inverse_aliases(aliases)


@query("trait_metadata", ("edges",), "SELECT from_id AS id, list_sort(list_distinct(list(to_id))) AS traits, count(DISTINCT to_id) AS n_traits FROM edges WHERE kind = 'Implements' GROUP BY from_id")
def _(edges: DataFrame) -> DataFrame:
    return A.trait_metadata(edges)


_LABELS = "CASE WHEN to_id = page THEN CASE e.kind " + " ".join(f"WHEN '{k}' THEN '{i}'" for k, _, i, _, _ in RELATIONS) + " END ELSE CASE e.kind " + " ".join(f"WHEN '{k}' THEN '{o}'" for k, _, _, o, _ in RELATIONS) + " END END"
_PLACES = "CASE e.kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, _, _, _, n in RELATIONS) + " END"


@query(
    "relationship_groups", ("nodes", "edges"),
    f"SELECT page, CASE WHEN to_id = page THEN 'in' ELSE 'out' END AS direction, {_LABELS} AS label, n.id AS other, n.name, count(*) AS n, CAST(min({_PLACES}) AS INT) AS place FROM page_edges e JOIN nodes n ON n.id = CASE WHEN to_id = page THEN from_id ELSE to_id END WHERE (from_id = page OR to_id = page) AND n.kind <> 'Impl' GROUP BY ALL",
    ("pages", "page_edges"),
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return A.relationship_groups(staged(G.own_edges(nodes, edges), "own"), nodes)


@query(
    "ego", ("nodes", "edges"),
    "SELECT page, CASE WHEN to_id = page THEN from_id ELSE to_id END AS neighbour, CASE WHEN to_id = page THEN 'in' ELSE 'out' END AS direction, list_sort(list_distinct(list(kind))) AS kinds, bool_or(is_glob) AS is_glob, CASE max(CASE confidence WHEN 'Inferred' THEN 3 WHEN 'Runtime' THEN 2 ELSE 1 END) WHEN 3 THEN 'Inferred' WHEN 2 THEN 'Runtime' ELSE 'Static' END AS confidence FROM (SELECT p.id AS page, e.* FROM edges e JOIN pages p ON e.from_id = p.id OR e.to_id = p.id) WHERE from_id <> to_id GROUP BY ALL",
    ("pages",),
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return A.ego(G.own_edges(nodes, edges, "confidence", "is_glob"))


@query("module_counts", ("nodes", "edges"), "SELECT m.id AS module, (SELECT count(*) FROM owners o WHERE o.module = m.id) AS direct, (SELECT count(*) FROM nodes c WHERE c.kind = 'Module' AND starts_with(c.id, m.id || '::')) AS children FROM nodes m WHERE m.kind IN ('Crate', 'Module')", (*TREE, "parents", "chain", "owners"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return A.module_counts(C.nearest_modules(G.first_parents(G.tree_relations(nodes, edges)), nodes), nodes)


_MATRIX = "SELECT f.module AS from_module, t.module AS to_module, count(*) AS total, " + ", ".join(f"count_if(e.kind = '{k}') AS {k}" for k in SEMANTIC) + f" FROM edges e JOIN owners f ON e.from_id = f.id JOIN owners t ON e.to_id = t.id WHERE e.kind IN {IN_SEMANTIC} GROUP BY f.module, t.module"


@query("module_matrix", ("nodes", "edges"), _MATRIX, (*TREE, "parents", "chain", "owners"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return A.module_matrix(edges, C.nearest_modules(G.first_parents(G.tree_relations(nodes, edges)), nodes))


@query("edge_totals", ("nodes", "edges"), f"SELECT count(*) AS all_edges, count_if(kind IN {IN_SEMANTIC}) AS semantic_edges, (SELECT count(*) FROM nodes WHERE NOT is_external) AS internal_nodes FROM edges")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return A.edge_totals(nodes, edges)


@query(
    "quality_gates", ("gate_packages", "gate_nodes", "gate_edges"),
    "SELECT graph, n_nodes, n_local, n_dangling, has_root, CASE WHEN n_nodes = 0 THEN 'rejected: empty graph' WHEN n_dangling > 0 THEN 'rejected: dangling edge' WHEN NOT has_root THEN 'rejected: no root' WHEN n_local = 0 THEN 'rejected: no local nodes' WHEN local_paths = 0 THEN 'rejected: no local items' WHEN local_paths > 1 AND n_local = 1 THEN 'quarantined' ELSE 'accepted' END AS outcome"
    " FROM (SELECT p.graph, p.local_paths, (SELECT count(*) FROM gate_nodes n WHERE n.graph = p.graph) AS n_nodes, (SELECT count(*) FROM gate_nodes n WHERE n.graph = p.graph AND NOT is_external) AS n_local,"
    " (SELECT count(*) FROM gate_edges e WHERE e.graph = p.graph AND ((e.graph, e.from_id) NOT IN (SELECT graph, id FROM gate_nodes) OR (e.graph, e.to_id) NOT IN (SELECT graph, id FROM gate_nodes))) AS n_dangling,"
    " EXISTS (SELECT 1 FROM gate_nodes n WHERE n.graph = p.graph AND kind = 'Crate' AND NOT is_external AND lower(replace(id, '-', '_')) = lower(replace(p.name, '-', '_'))) AS has_root FROM gate_packages p)",
)
def _(packages: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return A.quality_gates(packages, nodes, edges)


@query("publish_gate", ("nodes",), "SELECT package, count(*) AS n_nodes, count_if(NOT is_external) AS n_local, count_if(is_external) AS n_external, NOT (count(*) > 1 AND count_if(NOT is_external) <= 1 AND count_if(is_external) > 0) AS publish FROM nodes GROUP BY package")
def _(nodes: DataFrame) -> DataFrame:
    return A.publish_gate(nodes)


@query("member_groups", ("nodes",), "SELECT parent_impl, list(id ORDER BY name, id) AS members FROM nodes WHERE parent_impl IS NOT NULL GROUP BY parent_impl")
def _(nodes: DataFrame) -> DataFrame:
    return A.member_groups(nodes)


# ---- rankings, searches, caps


@query("download_rank", ("packages",), "SELECT id, name, downloads, CAST(row_number() OVER (ORDER BY downloads DESC, name) AS INT) AS rank FROM packages")
def _(packages: DataFrame) -> DataFrame:
    return R.download_rank(packages)


_KEY = "(CAST(k.a AS INT), CAST(k.b AS INT), CAST(k.c AS INT), k.d = '', coalesce(TRY_CAST(k.e AS INT), 0), created_at)"


@query("newest_versions", ("versions",), f"SELECT package_id, arg_max(num, ((k.d = ''), {_KEY})) FILTER (NOT yanked) AS newest, arg_max(created_at, ((k.d = ''), {_KEY})) FILTER (NOT yanked) AS newest_time FROM versions_key GROUP BY package_id", ("versions_key",))
def _(versions: DataFrame) -> DataFrame:
    return R.newest_versions(versions)


@query("newest_with_prereleases", ("versions",), f"SELECT package_id, arg_max(num, {_KEY}) FILTER (NOT yanked) AS newest, arg_max(created_at, {_KEY}) FILTER (NOT yanked) AS newest_time FROM versions_key GROUP BY package_id", ("versions_key",))
def _(versions: DataFrame) -> DataFrame:
    return R.newest_versions(versions, include_pre=True)


@query("node_search", ("nodes",), "SELECT id, name, kind, CAST(score AS INT) AS score FROM (SELECT *, CASE WHEN lower(name) = 'impl-1' THEN 0 WHEN starts_with(lower(name), 'impl-1') THEN 1 WHEN ends_with(lower(id), '::impl-1') THEN 2 WHEN contains(lower(name), 'impl-1') THEN 3 WHEN contains(lower(id), 'impl-1') THEN 4 END AS score FROM nodes WHERE kind <> 'Impl') WHERE score IS NOT NULL ORDER BY score, id LIMIT 200")
def _(nodes: DataFrame) -> DataFrame:
    return R.search(nodes, "Impl-1", 200)


PARTS |= {
    "shelf": "SELECT CASE id % 3 WHEN 1 THEN name WHEN 2 THEN 'bolt-' || CAST(id AS STRING) END AS id, CASE id % 2 WHEN 0 THEN name ELSE upper(name) END AS name, CAST(id % 2 AS STRING) AS version, CASE id % 5 WHEN 0 THEN 'Fits a Bolt' WHEN 1 THEN 'for all' END AS description FROM packages UNION ALL SELECT name, name || '-twin', '1', 'twin' FROM packages WHERE id % 7 = 0",
    "tools": "SELECT replace(lower(package), ' ', '_') || '_bolt' AS name, 'Basics of ' || lower(package) AS description, CAST(min(n_nationkey) AS BIGINT) AS seq FROM modules GROUP BY package",
}
_SEARCHES = {"bolt": ("bolt", None), "Middle-East  Bolt@nightly": ("middle_east_bolt", "nightly"), "@beta": ("", "beta"), "basics-of asia": ("basics_of_asia", None)}


def _search_sql(asked: str, needle: str, channel: str | None) -> str:
    q = asked.strip().lower()
    hit = f"contains(name, '{needle}') OR contains(lower(name || ' ' || replace(name, '_', '-') || ' ' || description), replace('{needle}', '_', ' '))" if needle else "true"
    tools = f"SELECT replace(name, '_', '-') AS id, name, channel AS version, description || ' (' || channel || ')' AS description, 0 AS part, seq * 3 + at AS score, '' AS b FROM tools, (SELECT unnest(['stable', 'beta', 'nightly']) AS channel, unnest([0, 1, 2]) AS at) WHERE ({hit})" + (f" AND channel = '{channel}'" if channel else "")
    n, i = "lower(name)", "lower(coalesce(id, name))"
    shelf = f"SELECT * FROM (SELECT id, name, version, description, 1, CASE WHEN {n} = '{q}' OR {i} = '{q}' THEN 0 WHEN starts_with({n}, '{q}') OR starts_with({i}, '{q}') THEN 1 WHEN contains({n}, '{q}') OR contains({i}, '{q}') THEN 2 WHEN contains(lower(description), '{q}') THEN 3 END AS score, {n} FROM shelf) WHERE score IS NOT NULL"
    return f"SELECT '{asked}' AS asked, id, name, version, description, part, score FROM (SELECT * FROM ({tools.replace(' at FROM', ' place FROM').replace('3 + at', '3 + place').replace('AS at)', 'AS place)')} UNION ALL {shelf}) QUALIFY row_number() OVER (PARTITION BY coalesce(id, name), version ORDER BY part, score, b, name, version) = 1 ORDER BY part, score, b, name, version LIMIT 300)"


@query("package_search", ("packages", "modules"), " UNION ALL ".join(f"SELECT * FROM ({_search_sql(asked, *means)})" for asked, means in _SEARCHES.items()), ("shelf", "tools"))
def _(packages: DataFrame, modules: DataFrame) -> DataFrame:
    made = lambda part, name, df: df.sparkSession.sql(PARTS[part].replace(f"FROM {name}", "FROM {t}"), t=df)
    shelf, tools = made("shelf", "packages", packages), made("tools", "modules", modules)
    found = [R.search_packages(shelf, tools, asked, 300).select(F.lit(asked).alias("asked"), "id", "name", "version", "description", "part", "score") for asked in _SEARCHES]
    return reduce(DataFrame.unionByName, found)


@query("best_parents", ("nodes", "edges"), "SELECT to_id AS child, arg_min(from_id, (CASE n.kind WHEN 'Crate' THEN 0 WHEN 'Module' THEN 10 ELSE 20 END + CASE WHEN e.kind = 'Contains' THEN 0 ELSE 1 END, edge_seq, from_id)) AS parent FROM edges e JOIN nodes n ON e.from_id = n.id WHERE e.kind IN ('Contains', 'Defines') GROUP BY to_id")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return R.best_parents(edges, nodes)


_ENDS = "SELECT page, CASE WHEN from_id = page THEN to_id ELSE from_id END AS neighbour, to_id = page AS incoming FROM page_edges WHERE from_id <> to_id AND (from_id = page OR to_id = page)"
_CAPPED = f"SELECT * FROM (SELECT page, neighbour, n, row_number() OVER (PARTITION BY page ORDER BY n DESC, neighbour) AS place FROM (SELECT page, neighbour, count(*) AS n FROM ({_ENDS}) GROUP BY ALL)) WHERE place <= 28"


@query("neighbour_cap", ("nodes", "edges"), f"SELECT page, neighbour, n, CAST(place AS INT) AS place FROM ({_CAPPED})", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return R.neighbour_cap(G.own_edges(nodes, edges), 30)


@query("neighbour_overflow", ("nodes", "edges"), f"SELECT page, count(*) AS dropped, CAST(sum(i) AS BIGINT) AS dropped_in, CAST(sum(o) AS BIGINT) AS dropped_out FROM (SELECT page, neighbour, max(CASE WHEN incoming THEN 1 ELSE 0 END) AS i, max(CASE WHEN incoming THEN 0 ELSE 1 END) AS o FROM ({_ENDS}) WHERE (page, neighbour) NOT IN (SELECT page, neighbour FROM ({_CAPPED})) GROUP BY ALL) GROUP BY page", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return R.overflow(G.own_edges(nodes, edges), 30)


@query("edge_cap", ("nodes", "edges"), f"SELECT page, from_id, to_id, kind, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN from_id = page OR to_id = page THEN 0 ELSE 1 END, {_PLACES}, from_id, to_id, kind) AS place FROM page_edges e) WHERE place <= 80", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return R.edge_cap(G.page_edges(nodes, edges), 80)


@query("first_users", ("nodes", "edges"), f"SELECT page, \"user\", CAST(place AS INT) AS place FROM (SELECT page, \"user\", row_number() OVER (PARTITION BY page ORDER BY \"user\") AS place FROM (SELECT DISTINCT e.page, e.from_id AS \"user\" FROM page_edges e JOIN nodes n ON e.page = n.id WHERE e.to_id = e.page AND e.kind IN {IN_SEMANTIC} AND n.kind NOT IN ('Crate', 'Module'))) WHERE place <= 8", ("pages", "page_edges"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return R.first_users(G.where_used(G.page_edges(nodes, edges.where(F.col("kind").isin(*SEMANTIC))), nodes))


@query("page_window", ("packages",), "SELECT id, name, downloads FROM packages ORDER BY downloads DESC, name LIMIT 50 OFFSET 100")
def _(packages: DataFrame) -> DataFrame:
    return R.page_of(packages.withColumn("less", -F.col("downloads")), ["less", "name"], 3, 50).drop("less")


# ---- graph and recursive operations


@query("ancestors", ("nodes", "edges"), "SELECT node, ancestor, CAST(depth AS INT) AS depth FROM chain", (*TREE, "parents", "chain"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return C.ancestors(G.first_parents(G.tree_relations(nodes, edges)))


@query("roots", ("nodes", "edges"), "SELECT package, id, name, kind FROM pages WHERE id NOT IN (SELECT child FROM parents WHERE parent IN (SELECT id FROM pages))", ("pages", *TREE, "parents"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return C.roots(nodes, G.first_parents(G.tree_relations(nodes, edges)))


@query("owner_modules", ("nodes", "edges"), "SELECT id, module FROM owners", (*TREE, "parents", "chain", "owners"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return C.nearest_modules(G.first_parents(G.tree_relations(nodes, edges)), nodes)


@query("module_depths", ("nodes", "edges"), "SELECT n.id AS module, count(a.id) AS depth FROM nodes n LEFT JOIN chain c ON n.id = c.node LEFT JOIN nodes a ON c.ancestor = a.id AND a.kind IN ('Crate', 'Module') WHERE n.kind IN ('Crate', 'Module') GROUP BY n.id", (*TREE, "parents", "chain"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    modules = nodes.where("kind in ('Crate', 'Module')")
    return C.module_depths(C.ancestors(G.first_parents(G.tree_relations(nodes, edges)), of=modules), nodes)


@query("subtree_totals", ("nodes", "edges"), "SELECT m.id AS module, count(o.id) AS total FROM nodes m LEFT JOIN owners o ON o.module = m.id OR starts_with(o.module, m.id || '::') WHERE m.kind IN ('Crate', 'Module') GROUP BY m.id", (*TREE, "parents", "chain", "owners"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parents = staged(G.first_parents(G.tree_relations(nodes, edges)), "parents")
    counts = A.module_counts(C.nearest_modules(parents, nodes), nodes)
    return C.subtree_totals(counts, C.ancestors(parents, of=nodes.where("kind in ('Crate', 'Module')")))


_HOPS = "WITH both_ways AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges), h0 AS (SELECT id AS seed, id, 0 AS distance FROM nodes WHERE kind = 'Module'), h1 AS (SELECT DISTINCT seed, b AS id, 1 AS distance FROM h0 JOIN both_ways ON id = a WHERE (seed, b) NOT IN (SELECT seed, id FROM h0)), h2 AS (SELECT DISTINCT seed, b AS id, 2 AS distance FROM h1 JOIN both_ways ON id = a WHERE (seed, b) NOT IN (SELECT seed, id FROM h0 UNION ALL SELECT seed, id FROM h1)) SELECT seed, id, CAST(distance AS INT) AS distance FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"


@query("hop_neighbourhood", ("nodes", "edges"), _HOPS)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return C.neighbourhood(edges, nodes.where("kind = 'Module'"), 2)


ORACLES["hop_neighbourhood"] = ORACLES["hop_neighbourhood"].replace("\nWITH both_ways", ",\nboth_ways", 1)


@query("reachable_edges", ("nodes", "edges"), "SELECT parent, child FROM relations WHERE parent IN (SELECT id FROM nodes WHERE kind = 'Crate' UNION SELECT node FROM chain JOIN nodes ON ancestor = id WHERE kind = 'Crate') AND child IN (SELECT id FROM nodes WHERE kind = 'Crate' UNION SELECT node FROM chain JOIN nodes ON ancestor = id WHERE kind = 'Crate')", (*TREE, "parents", "chain"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    relations = staged(G.tree_relations(nodes, edges), "relations")
    parents = G.first_parents(relations)
    return C.reachable_edges(relations, parents, nodes.where("kind = 'Crate'"), C.ancestors(parents)).select("parent", "child")


@query("matching_tree", ("nodes", "edges"), "SELECT DISTINCT id FROM (SELECT id FROM nodes WHERE contains(lower(id), 'impl-77') UNION ALL SELECT ancestor FROM chain WHERE contains(lower(node), 'impl-77'))", (*TREE, "parents", "chain"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    matches = staged(P.matching(nodes, "impl-77").select("id"), "matches")
    return C.matching_with_ancestors(matches, C.ancestors(G.first_parents(G.tree_relations(nodes, edges)), of=matches))


@query("structural_tree", ("nodes", "edges"), "SELECT from_id, to_id, e.kind FROM edges e JOIN nodes f ON from_id = f.id JOIN nodes t ON to_id = t.id WHERE e.kind IN ('Contains', 'Defines') AND NOT f.is_external AND NOT t.is_external")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return C.structural_tree(nodes, edges)


# ---- set operations


@query("touching_edges", ("nodes", "edges"), "SELECT id, from_id, to_id, e.kind FROM edges e JOIN nodes n ON from_id = id WHERE n.kind = 'Trait' UNION SELECT id, from_id, to_id, e.kind FROM edges e JOIN nodes n ON to_id = id WHERE n.kind = 'Trait'")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return U.touching_edges(edges, nodes.where("kind = 'Trait'").select("id"))


@query(
    "ordered_union", ("versions",),
    "SELECT package_id, num, CAST(place AS INT) AS place FROM (SELECT package_id, num, row_number() OVER (PARTITION BY package_id ORDER BY o, num) AS place FROM (SELECT package_id, num, min((CASE WHEN yanked THEN 1 ELSE 0 END, version_seq)) AS o FROM versions GROUP BY package_id, num)) WHERE place <= 10",
)
def _(versions: DataFrame) -> DataFrame:
    return U.ordered_union(versions.where("not yanked"), versions.where("yanked"), "package_id", "num", "version_seq", 10)


@query("missing_packages", ("packages", "versions"), "SELECT name FROM packages WHERE id NOT IN (SELECT package_id FROM versions WHERE NOT yanked AND num LIKE '1.%')")
def _(packages: DataFrame, versions: DataFrame) -> DataFrame:
    return U.difference(packages, versions.where("not yanked and num like '1.%'").select(F.col("package_id").alias("id")), "id").select("name")


@query("first_rows", ("raw_methods",), "SELECT id, min(l_partkey) AS l_partkey FROM raw_methods WHERE l_linenumber > 2 AND id NOT IN (SELECT id FROM raw_methods WHERE l_linenumber <= 2) GROUP BY id UNION ALL SELECT id, max(l_partkey) FROM raw_methods WHERE l_linenumber <= 2 GROUP BY id")
def _(raw: DataFrame) -> DataFrame:
    old = raw.where("l_linenumber <= 2").groupBy("id").agg(F.max("l_partkey").alias("l_partkey"))
    return U.first_rows(old, raw.where("l_linenumber > 2").select("id", "l_partkey"), ["id"], "l_partkey")


# ---- planning

_RANKS = "list_position([" + ", ".join(f"'{t}'" for t in PRIORITY_TIERS) + "], tier)"
_STATE = f"""
wanted AS (SELECT id, name, downloads, CAST(row_number() OVER (ORDER BY downloads DESC, name) AS INT) AS download_rank, CAST(1 + id % 3 AS VARCHAR) || '.0.0' AS version, id % 11 = 0 AS forced FROM packages),
recorded AS (SELECT name, CAST(1 + id % 2 AS VARCHAR) || '.0.0' AS recorded_version, CASE WHEN id % 5 = 0 THEN 'rev-old' ELSE 'rev-new' END AS parser_revision, CASE WHEN id % 7 = 0 THEN 1 ELSE 2 END AS schema_version FROM packages WHERE id % 4 <> 0),
states AS (SELECT w.*, CASE WHEN r.name IS NULL THEN 'never' WHEN recorded_version <> version THEN 'newer' WHEN parser_revision <> 'rev-new' THEN 'revision' WHEN schema_version <> 2 THEN 'schema' ELSE 'fresh' END AS state FROM wanted w LEFT JOIN recorded r ON w.name = r.name),
modes AS (SELECT unnest(['daily', 'backfill']) AS mode),
tiers AS (SELECT *, CASE WHEN forced THEN 'forced' WHEN state IN ('revision', 'schema') THEN CASE WHEN download_rank <= 5000 THEN 'top-download-stale' ELSE 'catalog-stale' END WHEN state = 'newer' THEN CASE WHEN download_rank <= 5000 THEN 'newer-version' ELSE 'catalog-newer' END WHEN state = 'never' THEN CASE WHEN mode = 'daily' OR download_rank <= 5000 THEN 'never-parsed-backfill' ELSE 'long-tail-backfill' END END AS tier FROM (SELECT * REPLACE (download_rank * 3 AS download_rank) FROM states), modes),
lanes AS (SELECT *, CASE WHEN tier = 'forced' THEN -1 WHEN tier IN ('top-download-stale', 'newer-version') THEN 0 WHEN tier IN ('catalog-stale', 'catalog-newer') THEN 1 ELSE 2 END AS lane FROM tiers WHERE tier IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY mode, lane ORDER BY {_RANKS}, download_rank, name, version) - 1 AS r FROM lanes),
patterns AS (SELECT 'daily' AS mode, [0, 0, 1, 0, 2, 0, 1, 0, 2, 1] AS pattern UNION ALL SELECT 'backfill', [2, 2, 1, 2, 0, 2, 1, 2, 0, 2]),
slots AS (SELECT p.*, CASE WHEN lane < 0 THEN r ELSE r // len(own) END AS cycle, CASE WHEN lane < 0 THEN -1 ELSE own[r % len(own) + 1] END AS slot FROM (SELECT p.*, list_filter(range(1, 11), lambda i: pattern[i] = lane) AS own FROM placed p JOIN patterns USING (mode)) p)
"""


def _work(packages: DataFrame, mode: str = "daily") -> DataFrame:
    """Packages as wanted versions against made records, with state, tier and rank."""
    i = F.col("id")
    wanted = R.download_rank(packages).withColumn("download_rank", F.col("rank") * 3).drop("rank").withColumns({"version": F.concat((1 + i % 3).cast("string"), F.lit(".0.0")), "forced": i % 11 == 0})
    recorded = packages.where("id % 4 <> 0").select("name", F.concat((1 + i % 2).cast("string"), F.lit(".0.0")).alias("version"), F.when(i % 5 == 0, "rev-old").otherwise("rev-new").alias("parser_revision"), F.when(i % 7 == 0, 1).otherwise(2).alias("schema_version"))
    s = L.staleness(wanted, recorded, "rev-new", 2, latest=True)
    return s.withColumn("tier", L.priority(F.col("state"), F.col("forced"), F.col("download_rank"), mode))


def _todo(packages: DataFrame, mode: str) -> DataFrame:
    return _work(packages, mode).where("tier is not null")


def _plan_sql(name: str, select: str) -> None:
    ORACLES[name] = with_clause("packages") + "," + _STATE + select


@query("staleness", ("packages",))
def _(packages: DataFrame) -> DataFrame:
    return _work(packages).select("name", "version", "state", "tier")


_plan_sql("staleness", "SELECT name, version, state, tier FROM tiers WHERE mode = 'daily'")


@query("version_staleness", ("packages",), "SELECT name, version, CASE WHEN id % 4 = 0 THEN 'never' WHEN id % 5 = 0 THEN 'revision' WHEN id % 7 = 0 THEN 'schema' ELSE 'fresh' END AS state FROM (SELECT id, name, '1.' || CAST(id % 4 AS VARCHAR) || '.0' AS version FROM packages)")
def _(packages: DataFrame) -> DataFrame:
    """Two records for each name: the wanted version (but for each fourth) and another."""
    i = F.col("id")
    wanted = packages.select("id", "name", F.format_string("1.%d.0", i % 4).alias("version"))
    own = wanted.where("id % 4 <> 0").select("name", "version", F.when(i % 5 == 0, "old").otherwise("now").alias("parser_revision"), F.when(i % 7 == 0, 1).otherwise(2).alias("schema_version"))
    other = packages.select("name", F.lit("0.9.0").alias("version"), F.lit("now").alias("parser_revision"), F.lit(2).alias("schema_version"))
    return L.staleness(wanted, own.unionByName(other), "now", 2).select("name", "version", "state")


@query("work_plan", ("packages",))
def _(packages: DataFrame) -> DataFrame:
    """The first items of a daily and of a backfill plan."""
    plans = [L.select_work(_todo(packages, mode), 150, mode).select(F.lit(mode).alias("mode"), "name", "version", "tier", "lane") for mode in ("daily", "backfill")]
    return plans[0].unionByName(plans[1])


_plan_sql("work_plan", "SELECT mode, name, version, tier, CAST(lane AS INT) AS lane FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY lane >= 0, cycle, slot) AS place FROM slots) WHERE place <= 150")


@query("shard_counts", ("packages",), f"SELECT s.shard, count(b.shard) AS n FROM (SELECT unnest(range(17)) AS shard) s LEFT JOIN (SELECT CAST({_FNV64} % 17 AS BIGINT) AS shard FROM (SELECT 'crate:' || name || ':1.0.0:default' AS t FROM packages)) b USING (shard) GROUP BY s.shard")
def _(packages: DataFrame) -> DataFrame:
    return L.shard_counts(packages.select(S.work_id(F.lit("crate"), F.col("name"), F.lit("1.0.0"), F.lit("default")).alias("work_id")), 17)


_DELTAS = "SELECT l_partkey % 8 AS shard, CAST(l_partkey AS VARCHAR) AS name, CAST(l_linenumber AS VARCHAR) AS version, CASE l_returnflag WHEN 'A' THEN CASE l_suppkey % 3 WHEN 0 THEN 'parser-bumped' ELSE 'published' END WHEN 'N' THEN 'fresh' ELSE CASE l_suppkey % 4 WHEN 0 THEN 'permanent' WHEN 1 THEN 'quarantine' ELSE 'transient' END END AS outcome, CASE WHEN l_returnflag = 'R' AND l_suppkey % 5 > 0 THEN 'error ' || CAST(l_suppkey AS VARCHAR) END AS error, CASE WHEN l_returnflag = 'A' OR l_suppkey % 7 = 0 THEN 'h' || CAST(l_orderkey AS VARCHAR) END AS graph_hash, CASE WHEN l_returnflag = 'A' OR l_suppkey % 7 = 0 THEN CAST(l_quantity AS BIGINT) END AS nodes, CASE WHEN l_suppkey % 2 = 0 THEN 'backfill' END AS tier, l_orderkey * 1000000000 + l_suppkey * 10000 + CAST(l_quantity AS BIGINT) * 100 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS seq"


def _deltas(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(*[x.strip() for x in _split_select(_DELTAS)])


def _split_select(sql: str) -> list[str]:
    """The items of a select list; commas inside parentheses don't part them."""
    out, depth = [""], 0
    for c in sql.removeprefix("SELECT "):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.replace("VARCHAR", "STRING") for x in out]


@query("run_summary", ("raw_methods",), f"SELECT shard, count(*) AS processed, count_if(outcome IN ('published', 'parser-bumped')) AS published, count_if(outcome = 'fresh') AS fresh, count_if(outcome NOT IN ('published', 'parser-bumped', 'fresh')) AS failed FROM ({_DELTAS} FROM raw_methods) GROUP BY ROLLUP (shard)")
def _(raw: DataFrame) -> DataFrame:
    return L.run_summary(_deltas(raw))


@query(
    "delta_merge", ("raw_methods",),
    f"SELECT coalesce(i.name, d.name) AS name, coalesce(i.version, d.version) AS version, coalesce(d.graph_hash, i.graph_hash, '') AS graph_hash, coalesce(d.nodes, i.nodes) AS nodes, coalesce(d.tier, i.tier) AS tier, CASE WHEN d.last_seq IS NOT NULL AND (ok_seq IS NULL OR ok_seq < last_seq) THEN outcome END AS failure, CASE WHEN d.last_seq IS NOT NULL AND (ok_seq IS NULL OR ok_seq < last_seq) THEN coalesce(error, '') END AS failure_error FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS name, CAST(l_linenumber + 2 AS VARCHAR) AS version, 'old' AS graph_hash, CAST(1 AS BIGINT) AS nodes, 'long-tail' AS tier FROM raw_methods) i FULL JOIN (SELECT name, version, max(seq) FILTER (outcome IN ('published', 'parser-bumped', 'fresh')) AS ok_seq, max(seq) AS last_seq, arg_max(outcome, seq) AS outcome, arg_max(error, (seq, coalesce(error, ''))) AS error0, list(error ORDER BY seq DESC)[1] AS error, arg_max(graph_hash, seq) FILTER (graph_hash IS NOT NULL AND outcome IN ('published', 'parser-bumped', 'fresh')) AS graph_hash, arg_max(nodes, seq) FILTER (nodes IS NOT NULL AND outcome IN ('published', 'parser-bumped', 'fresh')) AS nodes, arg_max(tier, seq) FILTER (tier IS NOT NULL) AS tier FROM (SELECT * FROM ({_DELTAS} FROM raw_methods) QUALIFY row_number() OVER (PARTITION BY name, version, seq ORDER BY outcome, error NULLS FIRST, graph_hash NULLS FIRST) = 1) GROUP BY ALL) d ON i.name = d.name AND i.version = d.version",
)
def _(raw: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    one = F.row_number().over(Window.partitionBy("name", "version", "seq").orderBy("outcome", F.asc_nulls_first("error"), F.asc_nulls_first("graph_hash")))
    deltas = _deltas(raw).withColumn("one", one).where("one = 1")
    index = raw.select(F.col("l_partkey").cast("string").alias("name"), (F.col("l_linenumber") + 2).cast("string").alias("version"), F.lit("old").alias("graph_hash"), F.lit(1).cast("bigint").alias("nodes"), F.lit("long-tail").alias("tier")).distinct()
    return L.merge_deltas(index, deltas)


_CHANNELS = "SELECT CAST(package_id AS STRING) AS name, CASE version_seq % 3 WHEN 0 THEN replace(num, '-rc.', '-beta.') WHEN 1 THEN replace(num, '-rc.', '-nightly.') ELSE num END AS version, CASE WHEN package_id % 3 = 0 THEN 'sysroot' ELSE 'docs.rs' END AS source FROM versions"
PARTS |= {
    "in_channels": r"SELECT *, (CAST(k.a AS INT), CAST(k.b AS INT), CAST(k.c AS INT), k.d = '', k.d, coalesce(TRY_CAST(k.e AS INT), 0)) AS key, CASE WHEN source <> 'sysroot' THEN 'stable' WHEN contains(version, 'beta') THEN 'beta' WHEN contains(version, 'nightly') THEN 'nightly' ELSE 'stable' END AS channel FROM (SELECT *, regexp_extract(version, '^(\d+)\.(\d+)\.(\d+)(?:-([a-z]+)\.(\d+))?$', ['a', 'b', 'c', 'd', 'e']) AS k FROM (" + _CHANNELS + "))",
}


@query("channel_aliases", ("versions",), "SELECT name, channel AS alias, arg_max(version, key) AS version FROM in_channels GROUP BY ALL UNION ALL SELECT name, 'latest', arg_max(version, key) FROM in_channels WHERE channel = 'stable' GROUP BY name", ("in_channels",))
def _(versions: DataFrame) -> DataFrame:
    """A third of the packages are the toolchain's, with all channels; others may have such versions, but no channels."""
    return R.channel_aliases(versions.sparkSession.sql(_CHANNELS.replace("FROM versions", "FROM {v}"), v=versions))


# ---- keyed state

_EVENTS = "SELECT name, '1' AS version, CASE event_type WHEN 'view' THEN 'queue' WHEN 'signup' THEN 'begin' ELSE 'record' END AS kind, event_id % 11 = 0 AS forced, status, step, CASE WHEN status = 'failed' THEN 'e' || CAST(event_id AS STRING) END AS error, CASE WHEN event_id % 7 > 0 THEN 'r' || CAST(event_id % 3 AS STRING) END AS request_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS moment, event_id AS seq FROM requests"
_QUEUED = "s.status IS NULL OR (s.status <> 'processing' AND e.moment > s.updated_at)"
_BEGUN = "s.status IS NULL OR e.forced OR NOT (s.status = 'ready' OR (s.status = 'processing' AND s.request_id IS NOT NULL AND s.request_id IS DISTINCT FROM e.request_id))"
_COUNTS = f"CASE e.kind WHEN 'queue' THEN {_QUEUED} WHEN 'begin' THEN {_BEGUN} ELSE s.status IS NULL OR e.request_id IS NULL OR s.request_id IS NULL OR s.request_id = e.request_id END"
_NEW = lambda column, record, register: f"CASE WHEN NOT ({_COUNTS}) THEN s.{column} WHEN e.kind = 'record' THEN {record} ELSE {register} END"
PARTS |= {
    "e": f"SELECT *, row_number() OVER (PARTITION BY name ORDER BY moment, seq) AS r FROM ({_EVENTS})",
    "s": "SELECT DISTINCT name, CAST(0 AS BIGINT) AS r, NULL::VARCHAR AS status, NULL::VARCHAR AS step, NULL::VARCHAR AS error, NULL::VARCHAR AS request_id, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at, CAST(0 AS BIGINT) AS sequence FROM e UNION ALL SELECT s.name, e.r, "
    + ", ".join([
        _NEW("status", "e.status", "'processing'"), _NEW("step", "e.step", "CASE e.kind WHEN 'queue' THEN 'queued' ELSE 'workflow-started' END"), _NEW("error", "e.error", "NULL"), _NEW("request_id", "coalesce(e.request_id, s.request_id)", "e.request_id"),
        _NEW("created_at", "coalesce(s.created_at, e.moment)", "CASE WHEN s.request_id = e.request_id THEN s.created_at ELSE e.moment END"), _NEW("updated_at", "e.moment", "e.moment"), f"s.sequence + CASE WHEN NOT ({_COUNTS}) THEN 0 WHEN e.kind = 'begin' THEN 2 ELSE 1 END",
    ])
    + " FROM s JOIN e ON s.name = e.name AND e.r = s.r + 1",
}
STORED |= {"e"}


@query("final_status", ("requests",), "SELECT name, '1' AS version, status, step, error, request_id, created_at, updated_at, sequence FROM (SELECT *, max(r) OVER (PARTITION BY name) AS last FROM s) WHERE r = last", ("e", "s"))
def _(requests: DataFrame) -> DataFrame:
    """Rival requests, forced ones and events without one, with ties in time."""
    return T.final_status(requests.sparkSession.sql(_EVENTS.replace("FROM requests", "FROM {requests}"), requests=requests).withColumnRenamed("moment", "at"))


PARTS["stalled"] = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'ready' ELSE 'processing' END AS status, CASE event_id % 8 WHEN 0 THEN 'finalizing' WHEN 1 THEN 'parsing' END AS step, CASE user_id % 7 WHEN 0 THEN 'active' WHEN 1 THEN 'success' WHEN 2 THEN 'unknown' WHEN 3 THEN 'failure' END AS run, event_id * 13 % 500 AS age, user_id % 5 = 0 AS has_artifact, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS runs_active FROM requests"


@query("timeouts", ("requests",), "SELECT event_id, CASE WHEN status <> 'processing' OR coalesce(step = 'finalizing', false) THEN 'keep' WHEN run IS NOT NULL THEN CASE run WHEN 'active' THEN 'keep' WHEN 'unknown' THEN CASE WHEN age < 375 THEN 'keep' ELSE 'failed' END WHEN 'success' THEN CASE WHEN has_artifact THEN 'ready' ELSE 'failed' END ELSE 'failed' END WHEN age < 20 THEN 'keep' WHEN has_artifact THEN 'ready' WHEN age < 30 OR (runs_active IS DISTINCT FROM false AND age < 375) THEN 'keep' ELSE 'failed' END AS verdict FROM stalled", ("stalled",))
def _(requests: DataFrame) -> DataFrame:
    stalled = requests.sparkSession.sql(PARTS["stalled"].replace("FROM requests", "FROM {r}"), r=requests)
    return stalled.select("event_id", T.timeout_verdict(*map(F.col, ("status", "step", "run", "age", "has_artifact", "runs_active"))).alias("verdict"))


@query("incremental_tree", ("nodes", "edges"), "SELECT child, parent FROM parents", (*TREE, "parents"))
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    relations = staged(G.tree_relations(nodes, edges), "relations")  # read three times
    cut = 2_500_000_000_000
    first = relations.where(F.col("edge_seq") < cut).groupBy("child").agg(F.min(F.struct("edge_seq", "parent")).alias("m")).select("child", "m.parent", "m.edge_seq")
    return T.tree_update(first, relations.where(F.col("edge_seq") >= cut)).select("child", "parent")


# ---- sources and sinks: written, read back


@query("node_store", ("nodes",), f"SELECT package, lpad(printf('%x', {_FNV32} % 16), 3, '0') AS bucket, count(*) AS n FROM nodes GROUP BY ALL")
def _(nodes: DataFrame) -> DataFrame:
    path = scratch(nodes.sparkSession, "nodes")
    K.write_nodes(nodes, path)
    return nodes.sparkSession.read.option("recursiveFileLookup", False).schema(nodes.schema.add("bucket", "string")).parquet(path).groupBy("package", "bucket").agg(F.count("*").alias("n"))


@query("search_store", ("nodes",), "SELECT rpad(substr(regexp_replace(lower(trim(name)), '[^a-z0-9_]', '_', 'g'), 1, 2), 2, '_') AS prefix, count(*) AS n FROM pages GROUP BY ALL", ("pages",))
def _(nodes: DataFrame) -> DataFrame:
    path = scratch(nodes.sparkSession, "search")
    K.write_search(nodes, path)
    return nodes.sparkSession.read.schema(nodes.schema.add("prefix", "string")).parquet(path).groupBy("prefix").agg(F.count("*").alias("n"))


@query("kind_store", ("nodes",), "SELECT id, kind FROM pages WHERE kind = 'Struct'", ("pages",))
def _(nodes: DataFrame) -> DataFrame:
    path = scratch(nodes.sparkSession, "kinds")
    K.write_kinds(nodes, path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path).where("kind = 'Struct'").select("id", "kind")


@query("alias_store", ("aliases",), "SELECT alias, replace(canonical, '::', '/') AS path FROM aliases")
def _(aliases: DataFrame) -> DataFrame:
    path = scratch(aliases.sparkSession, "aliases")
    K.write_aliases(aliases, path)
    return aliases.sparkSession.read.schema("alias string, canonical string, path string, bucket string").parquet(path).select("alias", "path")


@query(
    "children_store", ("nodes", "edges"),
    f"SELECT parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY {ORDER_OF.format('p.kind')}, name, child) AS INTEGER) AS place, child, name, EXISTS (SELECT 1 FROM relations x JOIN pages y ON x.child = y.id WHERE x.parent = r.child) AS has_children FROM relations r JOIN pages p ON r.child = p.id",
    ("pages", *TREE),
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    path = scratch(nodes.sparkSession, "children")
    K.write_children(G.tree_children(nodes, edges), path)
    store = nodes.sparkSession.read.parquet(path)
    return K.read_children(store, store)


@query("manifests", ("nodes", "edges"), f"SELECT package, n_nodes, n_pages, n_buckets, coalesce(n_edges, 0) AS n_edges FROM (SELECT package, count(*) AS n_nodes, count_if({PAGE}) AS n_pages, count(DISTINCT {_FNV32} % 16) AS n_buckets FROM nodes GROUP BY package) LEFT JOIN (SELECT split_part(from_id, '::', 1) AS package, count(*) AS n_edges FROM edges GROUP BY 1) USING (package)")
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return K.manifest(nodes, edges)


@query("build_report", ("nodes",), "SELECT package, count(*) AS entries, CAST(sum(s) AS BIGINT) AS bytes, max(s) AS largest, arg_min(id, (-s, id)) AS largest_id FROM (SELECT package, id, CAST(strlen('{\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"kind\":\"' || kind || '\",\"visibility\":\"' || visibility || '\"}') AS BIGINT) AS s FROM nodes) GROUP BY package")
def _(nodes: DataFrame) -> DataFrame:
    return K.build_report(nodes)


@query("bucket_counts", ("nodes",), "SELECT package, CAST(least(pow(2, ceil(log2(greatest(ceil(count(*) / 100), 3)))), 64) AS BIGINT) AS buckets FROM nodes GROUP BY package")
def _(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("package").agg(F.count("*").alias("n")).select("package", S.bucket_count(F.col("n"), 100, 3, 64).alias("buckets"))


@query("changed_shards", ("nodes",), f"SELECT count(DISTINCT {_FNV32} % 64) AS n FROM nodes WHERE kind = 'Module'")
def _(nodes: DataFrame) -> DataFrame:
    spark = nodes.sparkSession
    old = K.write_changed(nodes, ["id"], 64, None, scratch(spark, "shards"))
    changed = nodes.withColumn("name", F.when(F.col("kind") == "Module", F.upper(F.concat("name", F.lit("!")))).otherwise(F.col("name")))
    new = K.write_changed(changed, ["id"], 64, old, scratch(spark, "shards"))
    return new.join(old.select("path"), "path", "left_anti").agg(F.count("*").alias("n"))


@query(
    "graph_hashes", ("nodes", "edges"),
    "SELECT package, count(*) AS n, sha256(" + " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT)) AS VARCHAR)" for at in (1, 16, 31)) + ") AS graph_hash FROM (SELECT package, sha256('{\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"kind\":\"' || kind || '\",\"visibility\":\"' || visibility || '\"}') AS h FROM nodes"
    " UNION ALL SELECT split_part(from_id, '::', 1), sha256('{\"from_id\":\"' || from_id || '\",\"to_id\":\"' || to_id || '\",\"kind\":\"' || kind || '\",\"confidence\":\"' || confidence || '\"}') FROM edges) GROUP BY package",
)
def _(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return K.graph_hashes(nodes, edges)


@query("latest_upsert", ("raw_methods",), "SELECT id, max(l_orderkey * 1000000 + l_partkey) AS v FROM raw_methods GROUP BY id")
def _(raw: DataFrame) -> DataFrame:
    rows = raw.select("id", (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("v"))
    return U.latest_rows(rows.where("v % 2 = 0"), rows.where("v % 2 = 1"), ["id"], "v")


@query("partition_replace", ("edges",), "SELECT split_part(from_id, '::', 1) AS package, CASE WHEN split_part(from_id, '::', 1) = 'ASIA' THEN count(*) // 2 * 0 + count_if(kind = 'Contains') ELSE count(*) END AS n FROM edges GROUP BY 1")
def _(edges: DataFrame) -> DataFrame:
    path, keyed = scratch(edges.sparkSession, "cross"), edges.withColumn("package", S.package_of(F.col("from_id")))
    K.replace_partitions(keyed, path, ["package"])
    K.replace_partitions(keyed.where("package = 'ASIA' and kind = 'Contains'"), path, ["package"])
    return edges.sparkSession.read.parquet(path).groupBy("package").agg(F.count("*").alias("n"))


@query("registry_csv", ("packages", "versions"), "SELECT p.name, p.downloads, count(v.num) AS n, count_if(v.yanked) AS n_yanked FROM packages p LEFT JOIN versions v ON p.id = v.package_id GROUP BY ALL")
def _(packages: DataFrame, versions: DataFrame) -> DataFrame:
    spark = packages.sparkSession
    one, two = scratch(spark, "packages"), scratch(spark, "versions")
    packages.write.csv(one, header=True)
    orphans = versions.withColumn("package_id", -1 - F.col("package_id"))  # their packages aren't there
    versions.unionByName(orphans).select("package_id", "num", F.when(F.col("yanked"), "t").otherwise("f").alias("yanked"), "created_at").write.csv(two, header=True)
    p = N.packages_csv(spark, one)
    v = N.versions_csv(spark, two, p)
    return p.join(v.withColumnRenamed("package_id", "id").drop("downloads"), "id", "left").groupBy("name", "downloads").agg(F.count("num").alias("n"), F.count_if("yanked").alias("n_yanked"))


@query("run_delta_logs", ("raw_methods",), f"SELECT outcome, count(*) AS n FROM ({_DELTAS} FROM raw_methods) GROUP BY outcome")
def _(raw: DataFrame) -> DataFrame:
    path = scratch(raw.sparkSession, "runs")
    _deltas(raw).drop("seq").write.json(path)
    return N.run_deltas(raw.sparkSession, path).groupBy("outcome").agg(F.count("*").alias("n"))


@query("version_pointers", ("versions",), "SELECT storage_name, wanted, version FROM (SELECT CAST(package_id AS VARCHAR) AS storage_name, 'latest' AS wanted, arg_max(num, version_seq) AS version FROM versions GROUP BY package_id)")
def _(versions: DataFrame) -> DataFrame:
    refs = versions.groupBy(F.col("package_id").cast("string").alias("storage_name")).agg(F.max_by("num", "version_seq").alias("version")).select("storage_name", F.lit("latest").alias("alias_or_version"), "version", F.lit("h").alias("graph_hash"))
    return N.resolve_versions(refs.select("storage_name", F.lit("latest").alias("wanted")), refs).drop("graph_hash")


_SLICE = "replace(module_id, '::', '-') || '-' || CAST(c_custkey // 100 AS VARCHAR)"


def _api_documents(modules: DataFrame, structs: DataFrame) -> DataFrame:
    """One API document for each hundred structs of a module, as JSON text: the module and functions that name the next one."""
    sid, slice_ = (F.col("c_custkey") + 1000).cast("string"), F.concat_ws("-", F.replace("module_id", F.lit("::"), F.lit("-")), F.expr("c_custkey div 100").cast("string")).alias("slice")
    entry = lambda key, name, inner: F.concat(F.lit('"'), key, F.lit('":{"name":"'), name, F.lit('","visibility":"default","docs":"about '), name, F.lit('","inner":'), inner, F.lit("}"))
    function = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.struct((F.col("c_custkey") + 1001).alias("id"), F.lit('say "id": 7').alias("path")).alias("resolved_path"))).alias("inputs")).alias("sig")).alias("function")))
    held = structs.groupBy("package", "module_id", slice_).agg(F.sort_array(F.collect_list(sid)).alias("ids"), F.array_sort(F.collect_list(entry(sid, F.col("name"), function))).alias("entries"))
    both = held.join(modules.select(F.col("id").alias("module_id"), "n_nationkey", "name"), "module_id")
    module = entry(F.col("n_nationkey").cast("string"), F.col("name"), F.to_json(F.struct(F.struct(F.col("ids").alias("items")).alias("module"))))
    index = F.concat(F.lit('{"root":0,"format_version":57,"index":{'), module, F.lit(","), F.array_join("entries", ","), F.lit("}"))
    return both.select(F.concat(index, F.lit(',"paths":{"0":{"crate_id":0,"path":["'), "package", F.lit('"],"kind":"module"}},"external_crates":{"1":{"name":"std"}}}')).alias("value"), "slice")


def _read_back(modules: DataFrame, structs: DataFrame) -> DataFrame:
    spark, path = modules.sparkSession, scratch(modules.sparkSession, "documents")
    _api_documents(modules, structs).write.json(path)
    lines = spark.read.schema("value string, slice string").json(path).select(F.col("slice").alias("file"), F.try_parse_json("value").alias("doc"))
    return D.gate(lines).where("outcome = 'accepted'")


@query("document_items", ("modules", "structs"), f"SELECT DISTINCT {_SLICE} AS file, CAST(n_nationkey AS VARCHAR) AS item_id, m.name, 'module' AS kind FROM structs s JOIN modules m ON module_id = m.id UNION ALL SELECT {_SLICE}, CAST(c_custkey + 1000 AS VARCHAR), name, 'function' FROM structs")
def _(modules: DataFrame, structs: DataFrame) -> DataFrame:
    return D.item_nodes(D.items(_read_back(modules, structs))).select("file", "item_id", "name", "kind")


@query("document_children", ("modules", "structs"), f"SELECT {_SLICE} AS file, CAST(m.n_nationkey AS VARCHAR) AS parent, CAST(s.c_custkey + 1000 AS VARCHAR) AS child FROM structs s JOIN modules m ON s.module_id = m.id")
def _(modules: DataFrame, structs: DataFrame) -> DataFrame:
    return D.children(D.items(_read_back(modules, structs))).select("file", "parent", "child")


@query("document_type_uses", ("modules", "structs"), f"SELECT {_SLICE} AS file, CAST(c_custkey + 1000 AS VARCHAR) AS owner, CAST(c_custkey + 1001 AS VARCHAR) AS used FROM structs")
def _(modules: DataFrame, structs: DataFrame) -> DataFrame:
    return D.type_uses(D.items(_read_back(modules, structs)))


# ---- calls

#: What every call's path names, and every suffix of every function that is not its whole path.
PARTS |= {
    "called": "SELECT *, regexp_extract(path || '::', '^((?:super::)*)(?:(crate|self|Self)::)?(.*)$', ['ups', 'word', 'rest']) AS p FROM api_calls",
    "anchored": "SELECT package, caller, module, line, p.ups = '' AND p.word = '' AS plain, rtrim(p.rest, ':') AS rest, CASE WHEN p.word = 'crate' THEN '' WHEN p.word = '' AND p.ups <> '' THEN coalesce(array_to_string(list_slice(string_split(module, '::'), 1, greatest(len(string_split(module, '::')) - CAST(len(p.ups) / 7 AS INTEGER), 0)), '::'), '') ELSE module END AS base FROM called",
    "tries": "SELECT package, caller, line, rest AS suffix FROM anchored WHERE plain UNION SELECT package, caller, line, CASE base WHEN '' THEN rest ELSE base || '::' || rest END FROM anchored",
    "tails": "SELECT package, id, is_method, substr(id, place + 2) AS suffix FROM (SELECT *, unnest(list_filter(range(1, len(id)), lambda x: substr(id, x, 2) = '::')) AS place FROM api_functions)",
    "typed_tries": "SELECT DISTINCT package, caller, method, type, unnest(CASE WHEN starts_with(type, 'crate::') THEN [substr(type, 8)] ELSE [replace(type, 'self::', ''), module || '::' || replace(type, 'self::', '')] END) || '::' || method AS suffix FROM api_calls WHERE type IS NOT NULL",
    "by_type": "SELECT t.package, t.caller, t.method, t.type, f.id FROM typed_tries t JOIN (SELECT package, suffix, min(id) AS id FROM tails WHERE is_method GROUP BY ALL HAVING count(*) = 1) f USING (package, suffix)",
    "by_method": "SELECT * FROM by_type UNION SELECT DISTINCT c.package, c.caller, c.method, c.type, f.id FROM api_calls c JOIN (SELECT package, suffix AS method, min(id) AS id FROM tails WHERE is_method GROUP BY ALL HAVING count(*) = 1) f USING (package, method) LEFT JOIN by_type b ON b.package = c.package AND b.caller = c.caller AND b.method = c.method AND b.type IS NOT DISTINCT FROM c.type WHERE b.caller IS NULL",
}
_SPAN = "named_struct('file', module || '.rs', 'line', line) AS span"
_FIT = "SELECT t.*, f.id, count(*) OVER (PARTITION BY t.package, t.caller, t.line, t.suffix) AS n FROM tries t JOIN tails f USING (package, suffix)"


@query("call_resolution", ("api_calls", "api_functions"), f"SELECT package, caller, id AS target, line, 'Static' AS confidence FROM ({_FIT}) WHERE n = 1 AND caller <> id GROUP BY ALL", ("called", "anchored", "tries", "tails"))
def _(calls: DataFrame, functions: DataFrame) -> DataFrame:
    found = X.resolve(calls.selectExpr("package", "caller", "module", "path", _SPAN), functions)
    return found.select("package", "caller", "target", F.col("span.line").alias("line"), "confidence")


@query("call_candidates", ("api_calls", "api_functions"), f"SELECT package, caller AS from_id, id AS to_id, CASE WHEN min(n) = 1 THEN 'Static' ELSE 'Inferred' END AS confidence, count(DISTINCT line) AS n_places FROM ({_FIT}) WHERE caller <> id GROUP BY package, caller, id", ("called", "anchored", "tries", "tails"))
def _(calls: DataFrame, functions: DataFrame) -> DataFrame:
    edges = X.call_edges(X.resolve(calls.selectExpr("package", "caller", "module", "path", _SPAN), functions, ambiguous=True))
    return edges.select("package", "from_id", "to_id", "confidence", F.size("occurrences").cast("long").alias("n_places"))


@query("method_candidates", ("api_calls", "api_functions"), "SELECT c.package, c.caller, m.id AS target, 'Static' AS confidence, c.line FROM api_calls c JOIN by_method m ON m.package = c.package AND m.caller = c.caller AND m.method = c.method AND m.type IS NOT DISTINCT FROM c.type WHERE c.caller <> m.id", ("tails", "typed_tries", "by_type", "by_method"))
def _(calls: DataFrame, functions: DataFrame) -> DataFrame:
    found = X.resolve_methods(calls.selectExpr("package", "caller", "module", "type", "method AS name", _SPAN), functions.where("is_method"))
    return found.select("package", "caller", "target", "confidence", F.col("span.line").alias("line"))


from weftline import document_queries, ingest_queries, scan_queries, view_queries  # noqa: E402, F401  they register their queries
