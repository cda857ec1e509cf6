"""Registered queries over whole API documents in mixed formats, each with SQL over the documents' JSON that states the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import api_texts  # noqa: F401  it adds the documents to the derived tables
from weftline.functions.attributes import INLINE, INTERNAL, OPTIMIZE, STABILITIES, attribute_text
from weftline.queries import PARTS, query
from weftline.shared import staged
from weftline.sources import documents as D
from weftline.sources import gates as W
from weftline.sources import typetree as Y
from weftline.sources import upgrades as J

_OWN = "|".join(rf"{kind}\.{part}" for kind, parts in Y.PARTS.items() for part in parts)
PARTS |= {
    "tree": "SELECT i.file, i.item_id, t.id AS seq, t.key, t.path, t.atom, t.type, substr(t.fullkey, 3) AS below FROM items i, json_tree(i.item->'inner') t",
    "ids": "SELECT file, item_id, below, CAST(atom AS VARCHAR) AS used FROM tree WHERE key = 'id'",
    "listed": "SELECT file, item_id, below, CAST(atom AS VARCHAR) AS held FROM tree WHERE type <> 'NULL' AND ends_with(below, ']')",
    "held": r"SELECT file, item_id, held FROM listed WHERE regexp_matches(below, '^(struct\.kind\.(plain\.fields|tuple)|union\.fields)\[\d+\]$') UNION ALL SELECT e.file, e.item_id, v.held FROM listed e JOIN listed v ON e.file = v.file AND e.held = v.item_id WHERE regexp_matches(e.below, '^enum\.variants\[\d+\]$') AND regexp_matches(v.below, '^variant\.kind\.(struct\.fields|tuple)\[\d+\]$')",
    "items": "SELECT d.file, d.version, e.key AS item_id, e.value AS item FROM api_docs d, json_each(d.value, '$.index') e",
    "given": "SELECT file, version, item_id, CAST(a.key AS INTEGER) AS place, a.value AS given, json_type(a.value) AS kind, json_keys(a.value)[1] AS name, json_extract(a.value, '$.*')[1] AS held FROM items, json_each(item, '$.attrs') a",
    "fixed": """SELECT *, CASE WHEN version < 54 THEN given->>'$' WHEN kind = 'VARCHAR' THEN NULL WHEN name = 'other' THEN held->>'$'
  WHEN name IN ('export_name', 'link_section') AND json_type(held) = 'VARCHAR' THEN NULL WHEN name = 'must_use' AND json_type(held) = 'OBJECT' THEN NULL WHEN name = 'target_feature' AND json_type(held->'enable') = 'ARRAY' THEN NULL
  WHEN name = 'repr' AND held->>'kind' IN ('rust', 'c', 'transparent', 'simd') THEN NULL ELSE CAST(given AS VARCHAR) END AS other FROM given""",
    "lines": r"SELECT *, array_to_string(list_filter(list_transform(string_split(replace(replace(other, '<cfg_attr_trace>', 'cfg_attr'), '<cfg_trace>', 'cfg'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS line FROM fixed",
    "payloads": r"SELECT *, CASE WHEN other IS NOT NULL AND starts_with(line, '#[attr = ') AND ends_with(line, ']') THEN substr(line, 10, length(line) - 10) END AS p FROM lines",
    "snakes": r"""SELECT *, lower(regexp_replace(regexp_replace(p, '^Lang\(|\)$', '', 'g'), '([a-z])([A-Z])', '\1_\2', 'g')) AS snake, regexp_extract(p, 'feature: "([^"]*)"', 1) AS feature, regexp_extract(p, 'major: ([^,]*),', 1) || '.' || regexp_extract(p, 'minor: ([^,]*),', 1) || '.' || rtrim(regexp_extract(p, 'patch: ([^ ]*) ', 1), '})') AS since, rtrim(trim(regexp_extract(p, 'issue: ([^}]*)}', 1)), ',)') AS issue, regexp_extract(p, 'reason: Some\("(.*?)"\)', 1) AS why FROM payloads""",
}
_SHOWN = " ".join(f"WHEN p = 'Inline({k})' THEN '{v}'" for k, v in INLINE.items()) + " " + " ".join(f"WHEN p = 'Optimize({k})' THEN '{v}'" for k, v in OPTIMIZE.items())
_TEXT = rf"""CASE
  WHEN other IS NOT NULL AND p IS NULL THEN line
  WHEN p IS NOT NULL THEN CASE WHEN regexp_matches(p, '^({"|".join(INTERNAL)})(\(|$)') OR p IN ('Inline(No)', 'Optimize(None)') THEN NULL WHEN starts_with(p, 'Lang(') THEN '#[lang = "' || snake || '"]'
    WHEN starts_with(p, 'RustcDiagnosticItem(') THEN '#[rustc_diagnostic_item = ' || regexp_extract(p, '\((.*)\)', 1) || ']'
    WHEN regexp_matches(p, '^({"|".join(STABILITIES)}) ') AND contains(p, 'level: Stable ') AND feature <> '' THEN '#[stable(feature = "' || feature || '", since = "' || since || '")]'
    WHEN regexp_matches(p, '^({"|".join(STABILITIES)}) ') AND contains(p, 'level: Unstable ') AND feature <> '' THEN '#[unstable(feature = "' || feature || '"' || CASE WHEN issue IN ('', 'None') THEN '' ELSE ', issue = "' || issue || '"' END || CASE WHEN why = '' THEN '' ELSE ', reason = "' || why || '"' END || ')]'
    {_SHOWN} WHEN starts_with(p, 'Inline(') THEN '#[inline]' WHEN starts_with(p, 'Optimize(') THEN '#[' || lower(p) || ']' WHEN regexp_matches(p, '^[A-Z][A-Za-z0-9_]*$') THEN '#[' || snake || ']' ELSE '#[' || p || ']' END
  WHEN kind = 'VARCHAR' THEN '#[' || (given->>'$') || ']'
  WHEN name = 'must_use' THEN '#[must_use' || coalesce(' = "' || (held->>'reason') || '"', '') || ']'
  WHEN name = 'repr' THEN '#[repr(C, ' || (held->>'int') || ', align(' || (held->>'align') || '))]'
  WHEN name = 'target_feature' THEN '#[target_feature(' || array_to_string(list_transform(CAST(held->'enable' AS VARCHAR[]), lambda x: 'enable = "' || x || '"'), ', ') || ')]'
  ELSE '#[' || name || ' = "' || (held->>'$') || '"]' END"""


def _parsed(docs: DataFrame) -> DataFrame:
    return staged(docs.select("file", F.try_parse_json("value").alias("doc"), F.col("version").alias("format_version")), "api_docs")


@query(
    "type_uses", ("api_docs",),
    rf"SELECT DISTINCT * FROM (SELECT file, item_id AS owner, used FROM ids WHERE regexp_matches(below, '^({_OWN})[.\[]') UNION ALL SELECT h.file, h.item_id, i.used FROM held h JOIN ids i ON h.file = i.file AND h.held = i.item_id WHERE starts_with(i.below, 'struct_field')) WHERE owner <> used",
    ("items", "tree", "ids", "listed", "held"),
)
def _(docs: DataFrame) -> DataFrame:
    return Y.owner_uses(staged(D.items(_parsed(docs)), "items"))


_KEPT = r"NOT regexp_matches(t.below, '\.generic_params\[|\.constraints\[\d+\]\.args\.')"


@query(
    "resolved_references", ("api_docs",),
    f"SELECT t.file, t.item_id, CAST(row_number() OVER (PARTITION BY t.file, t.item_id ORDER BY t.seq) - 1 AS INTEGER) AS place, string_split(t.atom->>'$', '::')[-1] AS display, i.used AS id FROM tree t JOIN (SELECT file, item_id, path, CAST(atom AS VARCHAR) AS used FROM tree WHERE key = 'id') i ON t.file = i.file AND t.item_id = i.item_id AND t.path = i.path WHERE t.key = 'path' AND regexp_matches(t.below, '^(struct_field|type_alias\\.type)[.\\[]') AND {_KEPT}",
    ("items", "tree"),
)
def _(docs: DataFrame) -> DataFrame:
    types = D.items(_parsed(docs)).select("file", "item_id", F.coalesce(F.try_variant_get("item", "$.inner.struct_field", "variant"), F.try_variant_get("item", "$.inner.type_alias.type", "variant")).alias("type"))
    return Y.resolved_references(types.where("type is not null"), ["file", "item_id"])


@query("attribute_texts", ("api_docs",), f"SELECT * FROM (SELECT file, item_id, place, {_TEXT} AS text FROM snakes) WHERE text IS NOT NULL", ("items", "given", "fixed", "lines", "payloads", "snakes"))
def _(docs: DataFrame) -> DataFrame:
    found = J.upgraded_items(_parsed(docs)).select("file", "item_id", F.posexplode("attrs").alias("place", "attr"))
    return found.select("file", "item_id", "place", attribute_text(F.col("attr")).alias("text")).where("text is not null")


def _level(name: str) -> str:
    part = lambda p: f"(item->>'$.{name}.{p}')"
    level = f"CASE WHEN json_type(item, '$.{name}.level') = 'OBJECT' THEN 'stable' ELSE {part('level')} END"
    return f"{part('feature')} AS {name}_feature, {level} AS {name}_level, CASE WHEN {level} = 'stable' THEN coalesce({part('level.stable.since')}, {part('since')}) END AS {name}_since"


@query(
    "upgraded_items", ("api_docs",),
    f"SELECT file, item_id, {_level('stability')}, {_level('const_stability')}, item->>'$.inner.function.default_unstable.feature' AS default_unstable, coalesce(a.attrs, '') AS attrs FROM items LEFT JOIN (SELECT file, item_id, string_agg(CASE WHEN other IS NOT NULL THEN CAST(json_object('other', other) AS VARCHAR) ELSE CAST(given AS VARCHAR) END, ' ' ORDER BY place) AS attrs FROM fixed GROUP BY file, item_id) a USING (file, item_id)",
    ("items", "given", "fixed"),
)
def _(docs: DataFrame) -> DataFrame:
    found = J.upgraded_items(_parsed(docs))
    levels = [F.col(f"{n}.{p}").alias(f"{n}_{p}") for n in ("stability", "const_stability") for p in ("feature", "level", "since")]
    return found.select("file", "item_id", *levels, "default_unstable", F.array_join(F.transform("attrs", lambda a: F.to_json(a)), " ").alias("attrs"))


@query("upgraded_packages", ("api_docs",), "SELECT file, CASE WHEN version < 44 THEN 'unknown' ELSE d.value->>'$.target.triple' END AS triple, CASE WHEN version < 44 THEN 0 ELSE json_array_length(d.value, '$.target.target_features') END::INTEGER AS n_features, CAST(e.key AS INTEGER) AS package_no, e.value->>'name' AS name, CASE WHEN version < 57 THEN '' ELSE e.value->>'path' END AS path FROM api_docs d, json_each(d.value, '$.external_crates') e")
def _(docs: DataFrame) -> DataFrame:
    parsed = _parsed(docs)
    whole = J.upgraded_documents(parsed).select("file", F.col("target_triple").alias("triple"), F.size("target_features").alias("n_features"))
    return whole.join(J.packages(parsed).select("file", "package_no", "name", "path"), "file")


def _number(field: str) -> str:
    return f"CASE WHEN json_type(value, '$.{field}') IS NULL THEN '{field}: missing' WHEN json_type(value, '$.{field}') <> 'UBIGINT' THEN '{field}: not an unsigned integer' WHEN CAST(value->>'$.{field}' AS HUGEINT) > 4294967295 THEN '{field}: out of range' END"


def _object(field: str) -> str:
    return f"CASE WHEN json_type(value, '$.{field}') IS NULL THEN '{field}: missing' WHEN json_type(value, '$.{field}') <> 'OBJECT' THEN '{field}: not an object' END"


PARTS |= {
    "objects": "SELECT file, value FROM api_mixed_docs WHERE CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE false END",
    "shapes": f"SELECT file, value, list_filter([coalesce({_number('format_version')}, CASE WHEN NOT CAST(value->>'$.format_version' AS BIGINT) BETWEEN 35 AND 61 THEN 'format_version: ' || (value->>'$.format_version') || ' is not supported' END), {_number('root')}, {_object('index')}, {_object('paths')}, {_object('external_crates')}], lambda x: x IS NOT NULL) AS found FROM objects",
    "shaped": "SELECT file, value FROM shapes WHERE len(found) = 0",
    "members": "SELECT file, e.key AS item_id, e.value AS item FROM shaped, json_each(shaped.value, '$.index') e",
    "unnamed": """SELECT file, arg_min('path ' || p.key || ': package ' || (p.value->>'crate_id') || ' has no name', CAST(p.key AS BIGINT)) AS reason FROM shaped, json_each(shaped.value, '$.paths') p WHERE p.value->>'crate_id' <> '0' AND coalesce(trim(json_extract_string(shaped.value, '$.external_crates."' || (p.value->>'crate_id') || '".name')), '') = '' GROUP BY file""",
    "lost": "SELECT m.file, arg_min('module ' || m.item_id || ': no item ' || m.child, (CAST(m.item_id AS BIGINT), CAST(m.child AS BIGINT))) AS reason FROM (SELECT file, item_id, unnest(CAST(item->'$.inner.module.items' AS VARCHAR[])) AS child FROM members WHERE item->>'crate_id' = '0' AND json_type(item, '$.inner.module.items') = 'ARRAY') m LEFT JOIN members c ON m.file = c.file AND m.child = c.item_id WHERE c.file IS NULL GROUP BY m.file",
    "rooted": "SELECT s.file, CASE WHEN NOT EXISTS (SELECT 1 FROM members f WHERE f.file = s.file) THEN 'index: empty' WHEN m.file IS NULL THEN 'root: no item ' || (value->>'root') WHEN coalesce(m.item->>'$.inner.module.is_crate', 'false') <> 'true' THEN 'root: item ' || (value->>'root') || ' is not a package''s module' END AS reason FROM shaped s LEFT JOIN members m ON s.file = m.file AND s.value->>'root' = m.item_id",
}


@query(
    "document_gates", ("api_mixed_docs",),
    "SELECT d.file, CASE WHEN NOT json_valid(d.value) THEN 'not JSON' WHEN o.file IS NULL THEN 'not an object' ELSE array_to_string(list_concat(s.found, list_filter([r.reason, u.reason, l.reason], lambda x: x IS NOT NULL)), '; ') END AS reasons FROM api_mixed_docs d LEFT JOIN objects o USING (file) LEFT JOIN shapes s USING (file) LEFT JOIN rooted r USING (file) LEFT JOIN unnamed u USING (file) LEFT JOIN lost l USING (file)",
    ("objects", "shapes", "shaped", "members", "unnamed", "lost", "rooted"),
)
def _(docs: DataFrame) -> DataFrame:
    return W.examined(_parsed(docs).select("file", "doc")).select("file", F.array_join("reasons", "; ").alias("reasons"))
