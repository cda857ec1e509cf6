"""A code graph, a package registry and an event log derived from the star-schema tables, in SQL that runs in Spark and elsewhere.

Regions are packages, nations modules, customers structs, suppliers traits, orders impls, line items methods and parts
external enums; sequence numbers are made from keys, so they need no global numbering.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import parts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

SQL = {
    "modules": """
SELECT n_nationkey, r_name || '::' || n_name AS id, n_name AS name, r_name AS package FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "structs": """
SELECT c_custkey, m.id || '::' || c_name AS id, c_name AS name, package, m.id AS module_id, c_acctbal FROM {customer} JOIN {modules} m ON c_nationkey = n_nationkey""",
    "traits": """
SELECT s_suppkey, m.id || '::' || s_name AS id, s_name AS name, package, m.id AS module_id FROM {supplier} JOIN {modules} m ON s_nationkey = n_nationkey""",
    "impls": """
SELECT o_orderkey, s.id || '::impl-' || CAST(o_orderkey AS STRING) AS id, 'impl-' || CAST(o_orderkey AS STRING) AS name, package, s.id AS struct_id FROM {orders} JOIN {structs} s ON o_custkey = c_custkey""",
    "raw_methods": """
SELECT i.id || '::method-' || CAST(l_linenumber AS STRING) AS id, 'method-' || CAST(l_linenumber AS STRING) AS name, package, i.id AS impl_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_shipdate FROM {lineitem} JOIN {impls} i ON l_orderkey = o_orderkey""",
    "methods": """
SELECT DISTINCT id, name, package, impl_id, l_orderkey, l_linenumber FROM {raw_methods}""",
    "externals": """
SELECT p_partkey, 'part::' || p_brand || '::' || CAST(p_partkey AS STRING) AS id, CAST(p_partkey AS STRING) AS name FROM {part}""",
    "nodes": """
SELECT r_name AS id, r_name AS name, 'Crate' AS kind, 'Public' AS visibility, false AS is_external, CAST(NULL AS STRING) AS parent_impl, r_name AS package, CAST(r_regionkey AS BIGINT) AS node_seq FROM {region}
UNION ALL SELECT id, name, 'Module', 'Public', false, NULL, package, 1000000000000 + CAST(n_nationkey AS BIGINT) FROM {modules}
UNION ALL SELECT id, name, 'Struct', CASE WHEN c_custkey % 5 = 0 THEN 'Crate' ELSE 'Public' END, false, NULL, package, 2000000000000 + c_custkey FROM {structs}
UNION ALL SELECT id, name, 'Trait', 'Public', false, NULL, package, 3000000000000 + s_suppkey FROM {traits}
UNION ALL SELECT id, name, 'Impl', 'Inherited', false, NULL, package, 4000000000000 + o_orderkey FROM {impls}
UNION ALL SELECT id, name, 'Function', CASE WHEN l_linenumber % 3 = 0 THEN 'Restricted:' || package ELSE 'Public' END, false, impl_id, package, 5000000000000 + l_orderkey * 100 + l_linenumber FROM {methods}
UNION ALL SELECT id, name, 'Enum', 'Public', true, NULL, 'part', 6000000000000 + p_partkey FROM {externals}""",
    "raw_edges": """
SELECT package AS from_id, id AS to_id, 'Contains' AS kind, 'Static' AS confidence, false AS is_glob, 1000000000000 + CAST(n_nationkey AS BIGINT) AS edge_seq FROM {modules}
UNION ALL SELECT module_id, id, 'Contains', 'Static', false, 2000000000000 + c_custkey FROM {structs}
UNION ALL SELECT module_id, id, 'Contains', 'Static', false, 3000000000000 + s_suppkey FROM {traits}
UNION ALL SELECT struct_id, id, 'Defines', 'Static', false, 4000000000000 + o_orderkey FROM {impls}
UNION ALL SELECT impl_id, id, 'Defines', 'Static', false, 5000000000000 + l_orderkey * 100 + l_linenumber FROM {methods}
UNION ALL SELECT m.id, e.id, 'UsesType', 'Static', l_linenumber % 2 = 0, 6000000000000 + l_orderkey * 100 + l_linenumber FROM {raw_methods} m JOIN {externals} e ON l_partkey = p_partkey
UNION ALL SELECT i.struct_id, t.id, 'Implements', 'Static', false, 7000000000000 + min(l_orderkey) FROM {raw_methods} m JOIN {impls} i ON m.impl_id = i.id JOIN {traits} t ON l_suppkey = s_suppkey GROUP BY i.struct_id, t.id
UNION ALL SELECT m.impl_id, t.id, 'CallsStatic', CASE l_returnflag WHEN 'A' THEN 'Static' WHEN 'N' THEN 'Inferred' ELSE 'Runtime' END, false, 8000000000000 + l_orderkey * 100 + l_linenumber FROM {raw_methods} m JOIN {traits} t ON l_suppkey = s_suppkey""",
    "edges": """
SELECT from_id, to_id, kind, CASE max(CASE confidence WHEN 'Runtime' THEN 3 WHEN 'Static' THEN 2 ELSE 1 END) WHEN 3 THEN 'Runtime' WHEN 2 THEN 'Static' ELSE 'Inferred' END AS confidence, is_glob, min(edge_seq) AS edge_seq
FROM {raw_edges} GROUP BY from_id, to_id, kind, is_glob""",
    "api_items": """
SELECT package, 1000000000000 + CAST(n_nationkey AS BIGINT) AS item_id, 'Module' AS kind, name, id AS path, true AS public, CAST(NULL AS BIGINT) AS parent_item FROM {modules}
UNION ALL SELECT package, 2000000000000 + c_custkey, 'Struct', name, CASE c_custkey % 50 WHEN 0 THEN module_id WHEN 1 THEN module_id || '::Shared' WHEN 2 THEN package ELSE id END, c_custkey % 5 <> 0, 1000000000000 + CAST(c_nationkey AS BIGINT) FROM {structs} JOIN (SELECT c_custkey AS key, c_nationkey FROM {customer}) c ON c_custkey = key
UNION ALL SELECT package, 3000000000000 + s_suppkey, 'Trait', name, CASE s_suppkey % 20 WHEN 1 THEN module_id || '::Shared' ELSE id END, true, 1000000000000 + CAST(s_nationkey AS BIGINT) FROM {traits} JOIN (SELECT s_suppkey AS key, s_nationkey FROM {supplier}) s ON s_suppkey = key""",
    "api_impls": """
SELECT i.package, 4000000000000 + o_orderkey AS item_id, i.id AS impl_id, 2000000000000 + cust AS self_item, CASE WHEN o_orderkey % 2 = 0 THEN 3000000000001 + o_orderkey % 12 END AS trait_item, 1000000000000 + CAST(c_nationkey AS BIGINT) AS parent_item
FROM {impls} i JOIN (SELECT o_orderkey AS key, o_custkey AS cust FROM {orders}) o ON o_orderkey = key JOIN {customer} ON cust = c_custkey""",
    "api_members": """
SELECT 4000000000000 + l_orderkey AS owner_item, 5000000000000 + l_orderkey * 100 + l_linenumber AS item_id, name, CASE l_linenumber % 4 WHEN 0 THEN 'AssocType' WHEN 1 THEN 'Field' ELSE 'Function' END AS kind, l_linenumber % 2 = 0 AS has_body FROM {methods}
UNION ALL SELECT DISTINCT 3000000000000 + l_suppkey, 7000000000000 + l_suppkey * 100 + l_linenumber, 'member-' || CAST(l_linenumber AS STRING), CASE l_linenumber % 4 WHEN 0 THEN 'AssocType' ELSE 'Function' END, (l_suppkey + l_linenumber) % 3 = 0 FROM {lineitem}""",
    "api_uses": """
SELECT package, package AS parent, 2000000000000 + c_custkey AS target_item, name, false AS is_glob FROM {structs} WHERE c_custkey % 4 = 0
UNION ALL SELECT package, package, 1000000000000 + CAST(n_nationkey AS BIGINT), name, true FROM {modules} WHERE n_nationkey % 2 = 0
UNION ALL SELECT package, id, 1000000000000 + CAST((n_nationkey + 1) % 25 AS BIGINT), name, true FROM {modules} WHERE n_nationkey % 3 = 0
UNION ALL SELECT package, id, 2000000000001 + CAST(n_nationkey AS BIGINT), 'Renamed', false FROM {modules}""",
    "gate_packages": """
SELECT n_name AS graph, replace(lower(n_name), '_', '-') AS name, CASE n_nationkey % 9 WHEN 6 THEN 0 WHEN 7 THEN 5 ELSE 3 END AS local_paths FROM {nation}""",
    "gate_nodes": """
SELECT n_name AS graph, n_name AS id, CASE n_nationkey % 9 WHEN 3 THEN 'Module' ELSE 'Crate' END AS kind, n_nationkey % 9 = 4 AS is_external FROM {nation} WHERE n_nationkey % 9 <> 8
UNION ALL SELECT n_name, n_name || '::' || c_name, 'Struct', n_nationkey % 9 = 5 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey % 9 NOT IN (7, 8)""",
    "gate_edges": """
SELECT n_name AS graph, n_name AS from_id, n_name || '::' || c_name AS to_id FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey % 9 NOT IN (7, 8)
UNION ALL SELECT n_name, n_name || '::lost', n_name FROM {nation} WHERE n_nationkey % 9 = 2
UNION ALL SELECT n_name, n_name, n_name || '::lost' FROM {nation} WHERE n_nationkey % 9 = 1""",
    "api_functions": """
SELECT DISTINCT s.package, s.id || '::m' || CAST(l_partkey % 400 AS STRING) AS id, 'm' || CAST(l_partkey % 400 AS STRING) AS name, true AS is_method FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {structs} s ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT package, module_id || '::f' || CAST(c_custkey % 97 AS STRING), 'f' || CAST(c_custkey % 97 AS STRING), false FROM {structs}
UNION ALL SELECT DISTINCT package, package || '::g' || CAST(c_custkey % 11 AS STRING), 'g' || CAST(c_custkey % 11 AS STRING), false FROM {structs}""",
    "api_calls": """
SELECT s.package, s.id || '::m' || CAST(l_partkey % 400 AS STRING) AS caller, m.name AS module, s.name AS type_name, 'm' || CAST(l_suppkey * 7 % 450 AS STRING) AS method,
  CASE (l_orderkey + l_linenumber) % 10 WHEN 0 THEN '' WHEN 1 THEN o.name || '::' WHEN 2 THEN 'super::' WHEN 3 THEN 'super::super::' WHEN 4 THEN 'crate::' || o.name || '::' WHEN 5 THEN 'self::' WHEN 6 THEN 'nowhere::' WHEN 7 THEN 'crate::' WHEN 8 THEN s.name || '::' ELSE 'super::self::' || o.name || '::' END
  || CASE (l_orderkey + l_linenumber) % 10 WHEN 8 THEN 'm' || CAST(l_partkey % 400 AS STRING) WHEN 2 THEN 'g' || CAST(l_partkey % 11 AS STRING) WHEN 3 THEN 'g' || CAST(l_partkey % 11 AS STRING) WHEN 7 THEN 'g' || CAST(l_partkey % 11 AS STRING) ELSE 'f' || CAST(l_partkey % 97 AS STRING) END AS path,
  CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN s.name WHEN 2 THEN 'crate::' || m.name || '::' || s.name ELSE 'self::' || s.name END AS type, l_linenumber AS line
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {structs} s ON o_custkey = c_custkey JOIN {modules} m ON s.module_id = m.id JOIN {modules} o ON o.n_nationkey = l_orderkey % 25""",
    "api_types": """
SELECT c_custkey AS item_id, replace(replace(replace(CASE c_custkey % 5 WHEN 0 THEN '<"resolved_path":<"path":"x","id":N>>' WHEN 1 THEN '<"borrowed_ref":<"type":<"resolved_path":<"id":N>>>>'
  WHEN 2 THEN '<"raw_pointer":<"type":<"slice":<"resolved_path":<"id":N>>>>>' WHEN 3 THEN '<"array":<"type":<"borrowed_ref":<"type":<"qualified_path":<"self_type":<"resolved_path":<"id":N>>>>>>,"len":"3">>' ELSE '<"primitive":"u8">' END,
  'N', CAST(c_custkey AS STRING)), '<', chr(123)), '>', chr(125)) AS type FROM {customer}""",
    "api_links": """
SELECT package, item_id, 'own' AS text, item_id AS target_item FROM {api_items}
UNION ALL SELECT package, item_id, 'other', 2000000000000 + item_id % 1000 FROM {api_items}
UNION ALL SELECT package, item_id, 'nowhere', 9000000000000 + item_id FROM {api_items}""",
    "api_traits": """
SELECT s_suppkey, id AS node, CASE WHEN s_suppkey % 4 = 0 THEN 'Common' ELSE name END AS name FROM {traits}""",
    "api_derives": """
SELECT s.id AS owner, CASE c_custkey % 3 WHEN 0 THEN 'Common' WHEN 1 THEN t.name ELSE t.node END AS name FROM {structs} s JOIN {api_traits} t ON s_suppkey = 1 + c_custkey % 10""",
    "aliases": """
SELECT package || '::' || name AS alias, id AS canonical FROM {structs}""",
    "packages": """
SELECT p_partkey AS id, replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) AS name, CAST(round(p_retailprice * 100) AS BIGINT) AS downloads FROM {part}""",
    "versions": """
SELECT l_partkey AS package_id, CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_orderkey % 10 AS STRING)
  || CASE WHEN l_linestatus = 'O' THEN '-rc.' || CAST(l_linenumber AS STRING) ELSE '' END AS num, l_returnflag = 'R' AS yanked, l_shipdate AS created_at, l_orderkey * 100 + l_linenumber AS version_seq FROM {lineitem}""",
    "requests": """
SELECT event_id, ts, user_id, 'package-' || CAST(user_id AS STRING) AS name, event_type,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'ready' ELSE 'failed' END AS status,
  CASE event_type WHEN 'signup' THEN 'fetching' WHEN 'click' THEN 'parsing' END AS step, value FROM {events}""",
}


def _needs(name: str) -> list[str]:
    """The derived tables that one needs, those first that others rest on."""
    out: list[str] = []
    for inner in re.findall(r"\{(\w+)\}", SQL[name]):
        if inner in SQL:
            out += [*(x for x in _needs(inner) if x not in out), inner]
    return list(dict.fromkeys(out))


def _methods(impls: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Line items dealt by order before their ids are made: numbers are compared for the distinct rows, and the join needs no further shuffle."""
    n = parts(lineitem)
    lines = lineitem.select("l_orderkey", "l_linenumber").repartition(n, "l_orderkey").distinct()
    found = lines.join(_dealt(impls, n).distinct(), F.col("l_orderkey") == F.col("o_orderkey"))
    return found.selectExpr(f"{_METHOD} AS id", "'method-' || CAST(l_linenumber AS STRING) AS name", "package", f"{_IMPL} AS impl_id", "l_orderkey", "l_linenumber")


_IMPL = "struct_id || '::impl-' || CAST(o_orderkey AS STRING)"
_METHOD = _IMPL + " || '::method-' || CAST(l_linenumber AS STRING)"
_RANK = "CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 3 END"
_CONFIDENCE = "CASE {} WHEN 3 THEN 'Runtime' WHEN 2 THEN 'Static' ELSE 'Inferred' END"


def _dealt(impls: DataFrame, n: int) -> DataFrame:
    """Impls by order, without the ids that are made of other columns."""
    return impls.select("o_orderkey", "struct_id", "package").repartition(n, "o_orderkey")


def _edges(frames: dict[str, DataFrame], merged: bool) -> DataFrame:
    """The rows of SQL["edges"] (merged) or SQL["raw_edges"], by keys. Ids below an impl tell its order, so edges from impls and methods merge where
    their order's line items are; ids as text are made after that. Every kind is a branch of its own, so a filter by kind leaves only its joins."""
    n, lines = parts(frames["lineitem"]), frames["lineitem"]
    impls = _dealt(frames["impls"], n)
    impls = impls.distinct() if merged else impls
    owned = lambda rows: rows.join(impls, F.col("l_orderkey") == F.col("o_orderkey"))
    ids = lambda table, key, name: frames[table].select(F.col(key).alias("key"), F.col("id").alias(name))
    edge = lambda rows, from_id, to_id, kind, seq, confidence="'Static'", is_glob="false": rows.selectExpr(f"{from_id} AS from_id", f"{to_id} AS to_id", f"'{kind}' AS kind", f"{confidence} AS confidence", f"{is_glob} AS is_glob", f"{seq} AS edge_seq")
    one = lambda rows, *keys: rows.groupBy(*keys).agg(F.max("rank").alias("rank"), F.min("seq").alias("seq")) if merged else rows

    held = [
        edge(frames["modules"], "package", "id", "Contains", "1000000000000 + CAST(n_nationkey AS BIGINT)"), edge(frames["structs"], "module_id", "id", "Contains", "2000000000000 + c_custkey"),
        edge(frames["traits"], "module_id", "id", "Contains", "3000000000000 + s_suppkey"),
    ]
    contains = reduce(DataFrame.unionByName, held)
    contains = contains.groupBy("from_id", "to_id", "kind", "confidence", "is_glob").agg(F.min("edge_seq").alias("edge_seq")) if merged else contains
    members = edge(_methods(frames["impls"], lines), "impl_id", "id", "Defines", "5000000000000 + l_orderkey * 100 + l_linenumber")
    uses = lines.select("l_orderkey", "l_linenumber", "l_partkey").join(ids("externals", "p_partkey", "used"), F.col("l_partkey") == F.col("key"))
    uses = uses.selectExpr("l_orderkey", "l_linenumber", "used", "2 AS rank", "l_orderkey * 100 + l_linenumber AS seq").repartition(n, "l_orderkey")
    used = edge(owned(one(uses, "l_orderkey", "l_linenumber", "used")), _METHOD, "used", "UsesType", "6000000000000 + seq", is_glob="l_linenumber % 2 = 0")
    calls = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").join(ids("traits", "s_suppkey", "called"), F.col("l_suppkey") == F.col("key"))
    calls = calls.selectExpr("l_orderkey", "called", f"{_RANK} AS rank", "l_orderkey * 100 + l_linenumber AS seq").repartition(n, "l_orderkey")
    called = edge(owned(one(calls, "l_orderkey", "called")), _IMPL, "called", "CallsStatic", "8000000000000 + seq", _CONFIDENCE.format("rank"))
    done = owned(calls.select("l_orderkey", "called")).where("struct_id is not null").groupBy("struct_id", "called").agg(F.min("l_orderkey").alias("seq"))
    implemented = edge(done, "struct_id", "called", "Implements", "7000000000000 + seq")
    found = reduce(DataFrame.unionByName, [contains, edge(impls, "struct_id", _IMPL, "Defines", "4000000000000 + o_orderkey"), members, used, implemented, called])
    if not merged:
        return found
    rank = F.max(F.expr("CASE confidence WHEN 'Runtime' THEN 3 WHEN 'Static' THEN 2 ELSE 1 END")).alias("rank")
    unnamed = found.where("from_id is null").groupBy("from_id", "to_id", "kind", "is_glob").agg(rank, F.min("edge_seq").alias("edge_seq"))  # of no order
    return found.where("from_id is not null").unionByName(unnamed.selectExpr("from_id", "to_id", "kind", _CONFIDENCE.format("rank") + " AS confidence", "is_glob", "edge_seq"))


#: Tables that Spark makes by keys; SQL above states their rows.
_KEYED = {
    "methods": (("impls", "lineitem"), lambda frames: _methods(frames["impls"], frames["lineitem"])),
    "raw_edges": (("modules", "structs", "traits", "impls", "externals", "lineitem"), lambda frames: _edges(frames, merged=False)),
    "edges": (("modules", "structs", "traits", "impls", "externals", "lineitem"), lambda frames: _edges(frames, merged=True)),
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a frame; only the input tables it rests on are read."""
    frames: dict[str, DataFrame] = {}

    def frame(table: str) -> DataFrame:
        if table not in frames:
            if table not in SQL:
                frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            elif table in _KEYED:
                needs, build = _KEYED[table]
                frames[table] = build({n: frame(n) for n in needs})
            else:
                frames[table] = spark.sql(SQL[table], **{n: frame(n) for n in set(re.findall(r"\{(\w+)\}", SQL[table]))})
        return frames[table]

    return frame(name)


def with_clause(*names: str) -> str:
    """The same tables as common table expressions."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_needs(n), n] if x not in order]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', SQL[n]).strip()})" for n in order)
