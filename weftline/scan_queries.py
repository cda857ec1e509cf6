"""Registered queries for readers, small column functions and plan rules, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import aggregates as A
from weftline.operators import filters as P
from weftline.operators import graph as G
from weftline.operators import ranking as R
from weftline.plans import planning as L
from weftline.queries import PARTS, query
from weftline.shared import scratch
from weftline.sinks import stores as K
from weftline.sources import scans as N
from weftline.streaming import status as T

# ---- column functions


@query("label_forms", ("packages",), "SELECT id, lpad(printf('%x', id % 300), 3, '0') AS shard, name || '::' || CASE id % 3 WHEN 0 THEN 'a::b' WHEN 1 THEN 'b' ELSE 'x' END AS joined, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 1 + id % 7 END AS n_lines, sha256(name) AS digest FROM packages")
def _(packages: DataFrame) -> DataFrame:
    i, k = F.col("id"), F.col("id") % 3
    path = F.when(k == 0, F.array(F.col("name"), F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("b"))).otherwise(F.array(F.col("name"), F.lit("x")))
    start, end = F.when(i % 4 != 0, 10), F.when(i % 4 == 1, F.lit(3)).otherwise(10 + i % 7)
    return packages.select("id", S.shard_label(i % 300, 300).alias("shard"), S.join_path(F.col("name"), path).alias("joined"), S.line_count(start, end).cast("bigint").alias("n_lines"), F.sha2("name", 256).alias("digest"))


@query(
    "text_forms", ("packages",),
    "SELECT id, '#[derive(' || 'A' || n || ', x::B' || n || ' )]' AS attribute, ['A' || n, 'x::B' || n] AS derives, 'run-' || n || '-1-x' AS run, 'owner/' || name AS repository, name || '-' || n IN ('x') OR regexp_matches('1.' || n || '.0-rc.1', '^[0-9]') AS valid, 'fn f' || n || '() {}' || chr(10) || '#[a]' || chr(10) || '#b' AS code, CASE k % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'toml' ELSE 'rust' END AS language, CASE WHEN k % 2 = 0 THEN 'nightly' END AS channel, 'my_std_' || n AS query, CASE WHEN k % 2 = 0 THEN [n] ELSE ['z'] END AS preferred FROM (SELECT id, name, CAST(id % 41 AS VARCHAR) AS n, id % 41 AS k FROM packages)",
)
def _(packages: DataFrame) -> DataFrame:
    n, k = (F.col("id") % 41).cast("string"), F.col("id") % 41
    attribute = F.concat(F.lit("#[derive(A"), n, F.lit(", x::B"), n, F.lit(" )]"))
    code = F.concat(F.lit("# hidden\nfn f"), n, F.lit("() {}\n#\n  # also hidden\n#[a]\n##b"))
    fence = F.when(k % 3 == 0, "rust,no_run").when(k % 3 == 1, "toml,ignore").otherwise("edition2021 should_panic")
    asked = F.concat(F.lit(" My_STD-"), n, F.when(k % 2 == 0, "@nightly").otherwise(""))
    return packages.select(
        "id", attribute.alias("attribute"), S.derive_names(attribute).alias("derives"), S.run_id(F.concat(F.lit("run/"), n, F.lit("/1 x"))).alias("run"), S.repository_of(F.concat(F.lit("git+https://github.com/owner/"), "name", F.lit(".git#"))).alias("repository"),
        S.valid_version(F.concat(F.lit("1."), n, F.lit(".0-rc.1"))).alias("valid"), S.shown_code(code).alias("code"), S.fence_language(fence)["language"].alias("language"),
        S.toolchain_query(asked)["channel"].alias("channel"), S.toolchain_query(asked)["name"].alias("query"), S.prefer_non_empty(F.when(k % 2 == 0, F.array(n)).otherwise(F.array().cast("array<string>")), F.array(F.lit("z"))).alias("preferred"),
    )


PARTS["impls_told"] = "SELECT id, package, node_seq % 7 = 0 AS synthetic, node_seq % 5 = 0 AS negative, node_seq % 3 = 0 AS blanket, CASE WHEN node_seq % 2 = 0 THEN 'T' END AS trait, CASE node_seq % 4 WHEN 0 THEN 'ready' ELSE 'processing' END AS status, CASE node_seq % 6 WHEN 0 THEN 'waiting-capacity' WHEN 1 THEN 'waiting-github-capacity' WHEN 2 THEN 'waiting-rate-limit' WHEN 3 THEN 'parsing' WHEN 4 THEN 'queued' END AS step FROM nodes"


@query("rule_forms", ("nodes",), "SELECT id, CASE WHEN synthetic THEN 'synthetic' WHEN negative THEN 'negative' WHEN blanket THEN 'blanket' WHEN trait IS NOT NULL THEN 'trait' ELSE 'inherent' END AS category, status = 'processing' AND step IS DISTINCT FROM 'waiting-capacity' AND step IS DISTINCT FROM 'waiting-github-capacity' AND step IS DISTINCT FROM 'waiting-rate-limit' AS uses FROM impls_told WHERE package IN ('ASIA', 'EUROPE')", ("impls_told",))
def _(nodes: DataFrame) -> DataFrame:
    members = nodes.sparkSession.createDataFrame([("ASIA",), ("EUROPE",)], "package string")
    told = P.members_only(nodes.sparkSession.sql(PARTS["impls_told"].replace("FROM nodes", "FROM {n}"), n=nodes), members)
    return told.select("id", P.impl_category(*map(F.col, ("synthetic", "negative", "blanket", "trait"))).alias("category"), P.uses_capacity(F.col("status"), F.col("step")).alias("uses"))


# ---- readers and writers


@query("name_list", ("packages",), "SELECT name FROM packages WHERE id % 3 <> 0")
def _(packages: DataFrame) -> DataFrame:
    path = scratch(packages.sparkSession, "names")
    packages.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("# "), "name")).otherwise(F.concat(F.lit("  "), "name", F.lit(" "))).alias("value")).write.text(path)
    return N.name_list(packages.sparkSession, path)


@query("version_lines", ("versions",), "SELECT 'p' || CAST(g AS VARCHAR) AS name, num AS version, CAST(r AS INTEGER) AS place FROM (SELECT package_id % 25 AS g, num, row_number() OVER (PARTITION BY package_id % 25 ORDER BY version_seq DESC, num DESC) AS r FROM versions WHERE NOT yanked) WHERE r <= 60")
def _(versions: DataFrame) -> DataFrame:
    """An index file for each of 25 names, its lines in the order of the versions' numbers; the newest 60 of each."""
    path = scratch(versions.sparkSession, "lines")
    rows = versions.select((F.col("package_id") % 25).alias("g"), F.concat(F.lit("p"), (F.col("package_id") % 25).cast("string")).alias("name"), F.col("num").alias("vers"), "yanked", "version_seq")
    rows.repartition("g").sortWithinPartitions("g", "version_seq", "vers").drop("version_seq").write.partitionBy("g").json(path)
    return N.version_lines(versions.sparkSession, path, 60)


@query("freshness_records", ("packages",), "SELECT name, '1.0' AS version, 'h' || CAST(id AS VARCHAR) AS graph_hash, downloads AS nodes FROM packages")
def _(packages: DataFrame) -> DataFrame:
    path = scratch(packages.sparkSession, "freshness")
    packages.select("name", F.lit("1.0").alias("version"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("graph_hash"), F.col("downloads").alias("nodes"), F.lit(1).alias("unknown")).write.json(path)
    return N.freshness_records(packages.sparkSession, path).select("name", "version", "graph_hash", "nodes")


_ENTRY = "SELECT CAST(package_id AS STRING) AS storage_name, CAST(package_id AS STRING) AS name, '1.' || CAST(version_seq % 1000 AS STRING) || '.0' AS version, CASE WHEN version_seq % 3 = 0 THEN '' ELSE 'h' END AS graph_hash, CAST('2026-01-01' AS TIMESTAMP) AS parsed_at, version_seq % 1000 AS minor FROM versions"


@query("catalog_store", ("versions",), f"SELECT storage_name AS name, '1.' || CAST(max(minor) AS VARCHAR) || '.0' AS version FROM ({_ENTRY}) WHERE graph_hash <> '' GROUP BY storage_name")
def _(versions: DataFrame) -> DataFrame:
    spark, path = versions.sparkSession, scratch(versions.sparkSession, "catalog")
    K.write_catalog(R.newest_of_each(spark.sql(_ENTRY.replace("versions", "{v}"), v=versions), "storage_name"), path, 3)
    return N.catalog(spark, path, 3).select("name", "version")


@query("aggregate_index", ("packages",), "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(downloads) AS BIGINT) AS downloads FROM packages")
def _(packages: DataFrame) -> DataFrame:
    manifest = K.write_changed(packages, ["name"], 8, None, scratch(packages.sparkSession, "index"))
    return N.aggregate_index(packages.sparkSession, manifest.select("path", F.col("n").alias("rows"))).agg(F.count("*").alias("n"), F.sum("downloads").alias("downloads"))


@query("workspace_nodes", ("nodes",), "SELECT id, id LIKE '%Supplier%' AS is_external FROM nodes WHERE kind IN ('Struct', 'Trait')")
def _(nodes: DataFrame) -> DataFrame:
    own = nodes.where("kind in ('Struct', 'Trait')").select("id", F.lit(False).alias("is_external"))
    return N.workspace_nodes(own, own.where("id like '%Supplier%'").withColumn("is_external", F.lit(True)))


@query("run_log", ("packages",), "SELECT name, CAST(2 AS BIGINT) AS n FROM packages")
def _(packages: DataFrame) -> DataFrame:
    path = scratch(packages.sparkSession, "log")
    rows = packages.select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("work_id"), "name", F.lit("published").alias("outcome"))
    for _ in range(2):
        K.append_log(rows, path)
    return N.run_deltas(packages.sparkSession, path).groupBy("name").agg(F.count("*").alias("n"))


@query("freshness_upsert", ("packages",), "SELECT name, 'latest' AS key, CASE WHEN id % 2 = 0 THEN '1.10.0' ELSE '1.9.0' END AS version FROM packages UNION ALL SELECT name, '1.9.0', '1.9.0' FROM packages UNION ALL SELECT name, '1.10.0', '1.10.0' FROM packages WHERE id % 2 = 0 UNION ALL SELECT name, '1.2.0', '1.2.0' FROM packages WHERE id % 2 <> 0")
def _(packages: DataFrame) -> DataFrame:
    before = K.record_versions(None, packages.select("name", F.lit("1.9.0").alias("version")))
    return K.record_versions(before, packages.select("name", F.when(F.col("id") % 2 == 0, "1.10.0").otherwise("1.2.0").alias("version")))


# ---- plan and status rules


PARTS |= {
    "corpus": "SELECT CASE id % 2 WHEN 0 THEN upper(name) ELSE replace(name, '-', '_') END AS name, id AS place FROM packages WHERE id % 3 = 0 UNION ALL SELECT name, id + 7 FROM packages WHERE id % 6 = 0 UNION ALL SELECT 'absent-' || name, id FROM packages WHERE id % 10 = 0",
    "forced_names": "SELECT replace(name, '-', '_') AS name FROM packages WHERE id % 5 = 0",
}


@query("candidates", ("packages",), "SELECT p.name, c.place, f.key IS NOT NULL AS forced FROM packages p LEFT JOIN (SELECT replace(lower(name), '-', '_') AS key, min(place) AS place FROM corpus GROUP BY 1) c ON replace(lower(p.name), '-', '_') = c.key LEFT JOIN (SELECT DISTINCT replace(lower(name), '-', '_') AS key FROM forced_names) f ON replace(lower(p.name), '-', '_') = f.key WHERE c.key IS NOT NULL OR f.key IS NOT NULL", ("corpus", "forced_names"))
def _(packages: DataFrame) -> DataFrame:
    return L.candidates(_made(packages, "corpus"), packages, _made(packages, "forced_names")).select("name", "place", "forced")


PARTS |= {
    "plans": "SELECT name, CAST(id % 3 AS STRING) AS version, CASE id % 8 WHEN 0 THEN 'parser old00000 -> abcdef01' WHEN 1 THEN 'forced (otherwise: parser abc1234 -> 1234567)' WHEN 2 THEN 'schema v1 -> v2' WHEN 3 THEN 'schema v1 -> v3' WHEN 4 THEN 'never parsed' WHEN 5 THEN 'crates.io 2 vs recorded 1' WHEN 6 THEN 'parser x -> short' ELSE 'fresh' END AS reason, CASE WHEN id % 5 > 0 THEN CAST('2026-01-02' AS TIMESTAMP) END AS planned_at, CASE id % 7 WHEN 0 THEN 'newer-version' WHEN 1 THEN 'never-parsed-backfill' ELSE 'catalog-stale' END AS tier FROM packages",
    "records": "SELECT name, CASE id % 11 WHEN 0 THEN '9' ELSE CAST(id % 3 AS STRING) END AS version, CASE id % 9 WHEN 0 THEN 'abcdef0123' WHEN 1 THEN '' WHEN 2 THEN '1234567' WHEN 3 THEN '123456' ELSE 'ffffffff' END AS parser_revision, CAST(id % 4 AS INT) AS schema_version, CASE id % 13 WHEN 0 THEN NULL WHEN 1 THEN CAST('2026-01-03' AS TIMESTAMP) WHEN 2 THEN CAST('2026-01-02' AS TIMESTAMP) ELSE CAST('2026-01-01' AS TIMESTAMP) END AS parsed_at FROM packages WHERE id % 6 <> 0",
    "states_now": "SELECT name, CAST(id % 3 AS STRING) AS version, CASE id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' WHEN 2 THEN 'ready' ELSE 'queued' END AS status, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST('2026-01-02' AS TIMESTAMP) WHEN 2 THEN CAST('2026-01-03' AS TIMESTAMP) ELSE CAST('2026-01-01' AS TIMESTAMP) END AS updated_at FROM packages WHERE id % 7 <> 0",
    "targets": r"SELECT *, nullif(regexp_extract(reason, 'parser \S+ -> ([0-9a-f]{7,40})', 1), '') AS parser, nullif(regexp_extract(reason, 'schema v\d+ -> v(\d+)', 1), '') AS schema FROM plans",
    "met": "SELECT p.*, CASE WHEN r.name IS NULL THEN false WHEN parser IS NOT NULL THEN starts_with(parser_revision, parser) OR coalesce(parsed_at >= planned_at, false) WHEN schema IS NOT NULL THEN schema_version = CAST(schema AS INTEGER) OR coalesce(parsed_at >= planned_at, false) WHEN tier IN ('newer-version', 'never-parsed-backfill') OR contains(reason, 'never parsed') OR contains(reason, 'crates.io') OR planned_at IS NULL THEN true ELSE coalesce(parsed_at >= planned_at, false) END AS satisfied FROM targets p LEFT JOIN records r ON p.name = r.name AND p.version = r.version",
}


def _made(packages: DataFrame, part: str) -> DataFrame:
    return packages.sparkSession.sql(PARTS[part].replace("FROM packages", "FROM {p}"), p=packages)


@query("satisfied_plans", ("packages",), "SELECT name, version, satisfied FROM met", ("plans", "records", "targets", "met"))
def _(packages: DataFrame) -> DataFrame:
    return L.satisfied(_made(packages, "plans"), _made(packages, "records")).select("name", "version", "satisfied")


@query("already_handled", ("packages",), "SELECT m.name, m.version, coalesce(status = 'processing', false) OR satisfied OR coalesce(status = 'failed' AND coalesce(updated_at >= planned_at, true), false) OR coalesce(status = 'ready' AND coalesce(updated_at >= planned_at, true) AND parser IS NULL AND schema IS NULL, false) AS handled FROM met m LEFT JOIN states_now s ON m.name = s.name AND m.version = s.version", ("plans", "records", "states_now", "targets", "met"))
def _(packages: DataFrame) -> DataFrame:
    plan = L.satisfied(_made(packages, "plans"), _made(packages, "records"))
    return L.already_handled(plan, _made(packages, "states_now")).select("name", "version", "handled")


@query("stale_failures", ("packages",), "SELECT name FROM packages WHERE id % 2 = 0 AND id % 3 <> 0")
def _(packages: DataFrame) -> DataFrame:
    rows = packages.select("id", "name", F.lit("1").alias("version"))
    return L.stale_failures(rows.where("id % 2 = 0"), rows.where("id % 3 = 0")).select("name")


PARTS |= {
    "running": "SELECT event_id, CAST(event_id AS STRING) AS name, '1' AS version, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'ready' ELSE 'failed' END AS status, CASE event_id % 3 WHEN 0 THEN 'finalizing' WHEN 1 THEN 'parsing' END AS step FROM requests",
    "artifacts": "SELECT CAST(event_id AS STRING) AS name, CASE user_id % 2 WHEN 0 THEN '1' ELSE '2' END AS version FROM requests WHERE user_id % 5 > 0",
}


@query("finalised", ("requests",), "SELECT r.event_id, CASE WHEN status = 'processing' AND step = 'finalizing' AND EXISTS (SELECT 1 FROM artifacts a WHERE a.name = r.name AND a.version = r.version) THEN 'ready' ELSE status END AS status FROM running r", ("running", "artifacts"))
def _(requests: DataFrame) -> DataFrame:
    made = lambda part: requests.sparkSession.sql(PARTS[part].replace("FROM requests", "FROM {r}"), r=requests)
    return T.finalised(made("running"), made("artifacts")).select("event_id", "status")


@query("matrix_cap", ("nodes",), "SELECT package, module FROM (SELECT package, id AS module, row_number() OVER (PARTITION BY package ORDER BY id <> package, length(id) DESC, id) AS r FROM nodes WHERE kind IN ('Crate', 'Module')) WHERE r <= 4")
def _(nodes: DataFrame) -> DataFrame:
    totals = nodes.where("kind in ('Crate', 'Module')").select("package", F.col("id").alias("module"), F.lit(1).alias("depth"), F.length("id").alias("total"))
    return R.matrix_modules(totals, 4).select("package", "module")


@query("reexport_projection", ("nodes", "aliases"), "SELECT split_part(id, '::', 1) AS from_id, coalesce(a.alias, n.id) AS to_id, 'ReExports' AS kind FROM nodes n LEFT JOIN aliases a ON a.canonical = n.id AND n.kind = 'Struct' WHERE n.kind IN ('Struct', 'Trait')")
def _(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    edges = nodes.where("kind in ('Struct', 'Trait')").select(S.package_of(F.col("id")).alias("from_id"), F.col("id").alias("to_id"), F.lit("ReExports").alias("kind"))
    return G.project_reexports(edges, aliases)


@query("trait_documentation", ("raw_methods",), "SELECT DISTINCT id, CASE WHEN l_linenumber % 2 = 0 THEN 'own' WHEN l_linenumber % 4 = 1 THEN 'from the trait' END AS docs FROM raw_methods")
def _(raw: DataFrame) -> DataFrame:
    members = raw.select("id", F.lit("T").alias("trait"), F.lit("Function").alias("kind"), "name", F.when(F.col("l_linenumber") % 2 == 0, "own").alias("docs")).distinct()
    trait = raw.where("l_linenumber % 4 = 1").select(F.lit("T").alias("trait"), F.lit("Function").alias("kind"), "name", F.lit("from the trait").alias("docs")).distinct()
    return G.trait_documentation(members, trait).select("id", "docs")


@query("edge_occurrences", ("raw_edges",), "SELECT from_id, to_id, kind, is_glob, count(DISTINCT edge_seq) AS occurrences FROM raw_edges GROUP BY ALL")
def _(raw: DataFrame) -> DataFrame:
    """Equal occurrences are one: the table twice gives the same."""
    twice = raw.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return A.merge_edges(twice).select("from_id", "to_id", "kind", "is_glob", "occurrences")


@query("package_enrichment", ("nodes",), "SELECT id, CASE WHEN id IN ('ASIA', 'EUROPE') THEN 'about ' || id ELSE 'own' END AS docs FROM nodes WHERE kind = 'Crate'")
def _(nodes: DataFrame) -> DataFrame:
    packages = nodes.where("kind = 'Crate'").select("id", "package", F.when(~F.col("id").isin("ASIA", "EUROPE"), "own").alias("docs"))
    roots = packages.select("package", F.concat(F.lit("about "), "id").alias("docs"))
    return A.enriched(packages, roots, ["docs"]).select("id", "docs")
