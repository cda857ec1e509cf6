"""API documents as JSON texts, derived from the star-schema tables: items with nested types, attributes and stabilities, in mixed format
versions, some of them broken.

In the SQL, < > stand for braces, ~ ^ for angle brackets, ` for a backslash and ? for a number, since neither engine's quoting then matters.
"""

from __future__ import annotations

from weftline.derived import SQL

VERSIONS = (43, 44, 54, 57, 58, 59, 60, 61)


def _path(name: str, number: str, args: str = "null") -> str:
    return f'<"path":"{name}","id":{number},"args":{args}>'


def _named(name: str, number: str, args: str = "null") -> str:
    return f'<"resolved_path":{_path(name, number, args)}>'


def _angled(args: str, constraints: str = "") -> str:
    return f'<"angle_bracketed":<"args":[{args}],"constraints":[{constraints}]>>'


def _bound(path: str, params: str = "") -> str:
    return f'<"trait_bound":<"trait":{path},"generic_params":[{params}],"modifier":"none">>'


HIDDEN = f'<"name":"X","kind":<"type":<"bounds":[{_bound(_path("Hidden", "H"))}],"default":null>>>'
TYPES = [
    _named("std::vec::Vec", "N", _angled(f'<"lifetime":"`u0027a">,<"type":{_named("x::Inner", "M")}>,<"const":<"expr":"4","value":null,"is_literal":true>>')),
    f'<"borrowed_ref":<"lifetime":null,"is_mutable":false,"type":<"slice":{_named("Item", "N")}>>>',
    f'<"tuple":[{_named("A", "N")},<"primitive":"u8">,<"raw_pointer":<"is_mutable":true,"type":{_named("b::B", "M")}>>]>',
    f'<"function_pointer":<"sig":<"inputs":[["x",{_named("In", "N")}],["y",<"generic":"T">]],"output":{_named("Out", "M")},"is_c_variadic":false>,"generic_params":[{HIDDEN}]>>',
    f'<"impl_trait":[{_bound(_path("iter::Iterator", "N", _angled("", f"""<"name":"Item","args":{_angled(f"<`type`:{_named("Skipped", "H")}>".replace("`type`", chr(34) + "type" + chr(34)))},"binding":<"equality":<"type":{_named("fixture::Output", "M")}>>>,<"name":"Other","args":null,"binding":<"constraint":[<"outlives":"a">,{_bound(_path("Debug", "H"), HIDDEN)}]>>""")))},<"outlives":"s">]>',
    f'<"dyn_trait":<"traits":[<"trait":{_path("ops::Fn", "N", f"""<"parenthesized":<"inputs":[{_named("P1", "M")}],"output":<"tuple":[{_named("P2", "N")}]>>>""")},"generic_params":[{HIDDEN}]>,<"trait":{_path("Send", "H")},"generic_params":[]>],"lifetime":null>>',
    f'<"qualified_path":<"name":"Item","self_type":{_named("Own", "H")},"trait":{_path("I", "N")},"args":{_angled(f"""<"type":<"array":<"type":<"pat":<"type":{_named("Deep", "M")},"pat":"1..">>,"len":"say `"id`": 7">>>""")}>>',
    _named("Vec", "N", _angled(f"""<"type":{_named("Option", "H", _angled(f'''<"type":<"borrowed_ref":<"lifetime":"b","is_mutable":true,"type":{_named("Box", "M", _angled('<"type":<"primitive":"str">>,"infer"'))}>>>'''))}>""")),
]
GENERICS = f'<"params":[<"name":"T","kind":<"type":<"bounds":[{_bound(_path("Bound", "H"))}],"default":{_named("Default", "M")},"is_synthetic":false>>>,<"name":"l","kind":<"lifetime":<"outlives":[]>>>,<"name":"C","kind":<"const":<"type":{_named("Size", "N")},"default":null>>>],"where_predicates":[<"bound_predicate":<"type":<"generic":"T">,"bounds":[{_bound(_path("Where", "M"))}],"generic_params":[{HIDDEN}]>>,<"eq_predicate":<"lhs":<"generic":"T">,"rhs":<"type":{_named("Eq", "N")}>>>]>'
NO_GENERICS = '<"params":[],"where_predicates":[]>'

_WRAPPED = lambda payload: f'#[attr = {payload}]'
ATTRIBUTES = [
    _WRAPPED('Stability <stability: Stability <level: Stable <since: Version(RustcVersion < major: 1, minor: ?, patch: 0 >)>, feature: `"f?`">>'),
    _WRAPPED('Stability <stability: Stability <level: Unstable <reason: None, issue: ?>, feature: `"u?`">>'),
    _WRAPPED('ConstStability <level: Unstable <reason: Some(`"why [(?`"), issue: None>, feature: `"r?`">'),
    _WRAPPED("Inline(Hint)"), _WRAPPED("Inline(Always)"), _WRAPPED("Inline(No)"), _WRAPPED("CfgAttrTrace"), _WRAPPED('CfgTrace([All([Not(NameValue < name: `"m?`" >)])])'),
    "#[allow(deprecated)]", _WRAPPED('MustUse <`n   reason: `"x?`"`n`n>'), _WRAPPED("MacroExport"), _WRAPPED("Lang(OwnedBox)"), _WRAPPED('RustcDiagnosticItem(`"Vec?`")'),
    _WRAPPED("Optimize(Size)"), "#[~cfg_trace^(feature)]", "#[derive(A, B)]", _WRAPPED("Optimize(Fast?)"), _WRAPPED("FeatureGate(?)"), _WRAPPED("BodyStability <level: Stable <>>"), _WRAPPED(""),
]
SHAPED = [
    '"automatically_derived"', '<"must_use":<"reason":null>>', '<"must_use":<"reason":"use ?">>', '<"export_name":"e?">', '<"repr":<"align":?,"int":"u8","kind":"c","packed":null>>',
    '<"target_feature":<"enable":["sse","avx?"]>>', '<"brand_new":<"x":?>>', '<"link_section":"s?">', '<"repr":<"int":null,"kind":"unheard">>', '"no_mangle"',
]


def _choice(key: str, texts: list[str]) -> str:
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


def _filled(text: str, key: str) -> str:
    """N, M, H: ids of other customers' structs, as numbers of their own."""
    return f"replace(replace(replace({text}, ':N,', ':' || CAST(10000 + {key} * 20 AS STRING) || ','), ':M,', ':' || CAST(10020 + {key} * 20 AS STRING) || ','), ':H,', ':' || CAST(10040 + {key} * 20 AS STRING) || ',')"


def _type(shift: int) -> str:
    return _choice(f"(k + {shift})", TYPES)


def _item(place: int, kind: str, inner: str, name: str = "name") -> str:
    """One item for each customer; '@' followed by a number is an id of the same customer."""
    text = f"'\"{kind}\":' || {inner}"
    for n in range(13, -1, -1):
        if f"@{n}" in text:
            text = f"replace({text}, '@{n}', CAST(10000 + k * 20 + {n} AS STRING))"
    return f"SELECT file, version, k, 10000 + k * 20 + {place} AS item_id, {name} AS name, '{kind}' AS kind, {_filled(text, '(k + 1)')} AS body FROM {{api_slices}}"


_G = f"CASE k % 2 WHEN 0 THEN '{GENERICS}' ELSE '{NO_GENERICS}' END"
_FIELDS = """CASE k % 3 WHEN 0 THEN '<"plain":<"fields":[@1,@2],"has_stripped_fields":false>>' WHEN 1 THEN '<"tuple":[@1,null,@2]>' ELSE '"unit"' END"""
_BODIES = [
    _item(0, "struct", f"""'<"kind":' || {_FIELDS} || ',"generics":' || {_G} || ',"impls":[@4]>'"""),
    _item(1, "struct_field", _type(0), "'first'"), _item(2, "struct_field", _type(3), "'second'"),
    _item(3, "function", f"""'<"sig":<"inputs":[["a",' || {_type(1)} || '],["b",' || {_type(5)} || ']],"output":' || CASE k % 2 WHEN 0 THEN 'null' ELSE {_type(2)} END || ',"is_c_variadic":false>,"generics":' || {_G} || CASE WHEN version >= 60 AND k % 3 = 0 THEN ',"default_unstable":<"feature":"body">' ELSE '' END || '>'""", "'run'"),
    _item(4, "impl", f"""'<"generics":' || {_G} || ',"for":' || {_type(4)} || ',"trait":' || CASE k % 3 WHEN 0 THEN 'null' ELSE '<"path":"Tr","id":H,"args":<"angle_bracketed":<"args":[<"type":' || {_type(6)} || '>],"constraints":[]>>>' END || ',"items":[@3],"blanket_impl":' || {_type(7)} || '>'""", "NULL"),
    _item(5, "enum", f"""'<"generics":' || {_G} || ',"variants":[@6,@7]>'""", "'E'"),
    _item(6, "variant", """'<"kind":<"tuple":[@1,null]>,"discriminant":null>'""", "'V'"), _item(7, "variant", """'<"kind":<"struct":<"fields":[@2]>>,"discriminant":null>'""", "'W'"),
    _item(8, "trait", f"""'<"generics":{NO_GENERICS},"bounds":[' || '{_bound(_path("Super", "N"))}' || '],"items":[@3]>'""", "'Tr'"),
    _item(9, "type_alias", f"""'<"type":' || {_type(5)} || ',"generics":' || {_G} || '>'""", "'Alias'"),
    _item(10, "constant", f"""'<"type":' || {_type(2)} || ',"const":<"expr":"1">>'""", "'LIMIT'"), _item(11, "static", f"""'<"type":' || {_type(6)} || ',"expr":"">'""", "'STATE'"),
    _item(12, "trait_alias", f"""'<"generics":{NO_GENERICS},"params":[' || '{_bound(_path("Both", "M"))}' || ']>'""", "'Short'"),
    _item(13, "union", f"""'<"generics":{NO_GENERICS},"fields":[@1]>'""", "'U'"),
]

_BRACES = "replace(replace(replace(replace(replace({}, '<', chr(123)), '>', chr(125)), '~', chr(60)), '^', chr(62)), '`', chr(92))"
_OLD = f"""'"' || replace({_choice("item_id", ATTRIBUTES)}, '?', CAST(k % 50 AS STRING)) || '"'"""
_ATTRS = f"""CASE WHEN version < 54 THEN {_OLD} || ',' || {_OLD.replace("item_id %", "(item_id + 7) %")} ELSE '<"other":' || {_OLD} || '>,' || replace({_choice("k", SHAPED)}, '?', CAST(k % 50 AS STRING)) END"""
_LEVEL = """CASE WHEN k % 2 = 0 THEN '<"feature":"fixture","level":' || CASE WHEN k % 4 = 0 THEN CASE WHEN version >= 61 THEN '<"stable":<"since":"1.2.3">>>' ELSE '"stable","since":"1.2.3">' END ELSE '"unstable">' END ELSE 'null' END"""
_STABLE = f"""CASE WHEN version >= 58 THEN ',"stability":' || {_LEVEL} ELSE '' END || CASE WHEN version >= 59 THEN ',"const_stability":' || {_LEVEL.replace("k %", "(k + 1) %")} ELSE '' END"""
_ENTRY = f"""'"' || CAST(item_id AS STRING) || '":<"id":' || CAST(item_id AS STRING) || ',"crate_id":0,"name":' || coalesce('"' || name || '"', 'null') || ',"visibility":"public","attrs":[' || {_ATTRS} || ']' || {_STABLE} || ',"inner":<' || body || '>>'"""
_TARGET = """CASE WHEN version >= 44 THEN '"target":<"triple":"arch-os","target_features":["f"]>,' ELSE '' END"""
_EXTERNAL = """'"1":<"name":"std","html_root_url":null' || CASE WHEN version >= 57 THEN ',"path":"/std.rlib"' ELSE '' END || '>'"""

SQL["api_slices"] = f"""
SELECT c_custkey AS k, s.name, s.package, replace(s.module_id, '::', '-') || '-' || CAST(CAST(floor(c_custkey / 100) AS BIGINT) AS STRING) AS file, m.name AS module,
  CASE (CAST(floor(c_custkey / 100) AS BIGINT) + n_nationkey) % {len(VERSIONS)} {" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(VERSIONS))} END AS version FROM {{structs}} s JOIN {{modules}} m ON s.module_id = m.id"""
SQL["api_bodies"] = "\nUNION ALL ".join(_BODIES)
SQL["api_entries"] = f"SELECT file, version, k, item_id, name, kind, {_BRACES.format(_ENTRY)} AS entry FROM {{api_bodies}}"
#: A document for each hundred customers of a module.
SQL["api_docs"] = f"""
SELECT d.file, d.version, {_BRACES.format(f"'<' || {_TARGET} || CHR(34) || 'format_version' || CHR(34) || ':' || CAST(version AS STRING) || ',{chr(34)}root{chr(34)}:0,{chr(34)}index{chr(34)}:<{chr(34)}0{chr(34)}:<{chr(34)}id{chr(34)}:0,{chr(34)}crate_id{chr(34)}:0,{chr(34)}name{chr(34)}:{chr(34)}' || package || '{chr(34)},{chr(34)}inner{chr(34)}:<{chr(34)}module{chr(34)}:<{chr(34)}is_crate{chr(34)}:true,{chr(34)}items{chr(34)}:[' || children || ']>>>,'")} || entries
  || {_BRACES.format(f"'>,{chr(34)}paths{chr(34)}:<{chr(34)}0{chr(34)}:<{chr(34)}crate_id{chr(34)}:0,{chr(34)}path{chr(34)}:[{chr(34)}' || package || '{chr(34)}],{chr(34)}kind{chr(34)}:{chr(34)}module{chr(34)}>,{chr(34)}9{chr(34)}:<{chr(34)}crate_id{chr(34)}:1,{chr(34)}path{chr(34)}:[{chr(34)}std{chr(34)}],{chr(34)}kind{chr(34)}:{chr(34)}module{chr(34)}>>,{chr(34)}external_crates{chr(34)}:<' || {_EXTERNAL} || '>>'")} AS value
FROM (SELECT file, min(version) AS version, min(package) AS package, string_agg(CAST(10000 + k * 20 AS STRING), ',') AS children FROM {{api_slices}} GROUP BY file) d
JOIN (SELECT file, string_agg(entry, ',') AS entries FROM {{api_entries}} GROUP BY file) e ON d.file = e.file"""
#: The same, some of them broken in one way or two, by a hash of the file's name.
_BREAKS = [
    "substr(value, 1, 40)", "'[' || value || ']'", """replace(value, '"paths"', '"other"')""", """replace(value, '"format_version":', '"format_version":1')""", """replace(value, '"is_crate":true', '"is_crate":false')""",
    """replace(value, '"name":"std"', '"name":" "')""", """replace(value, '"items":[', '"items":[77,5,')""", """replace(replace(value, '"root":0', '"root":3'), '"name":"std"', '"named":"std"')""", """replace(value, '"root":0', '"root":-1')""",
    """replace(replace(value, '"external_crates":', '"external_crates":3,"rest":'), '"root":0', '"root":5000000000')""", """replace(replace(value, '"crate_id":1', '"crate_id":4'), '"items":[', '"items":[6,')""", """replace(value, '"index":', '"index":' || chr(123) || chr(125) || ',"rest":')""",
]
_BROKEN = "(length(file) * 7 + ascii(substr(file, length(file), 1)) * 5 + ascii(file)) % 23"
SQL["api_mixed_docs"] = f"SELECT file, version, CASE {_BROKEN} " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(_BREAKS)) + " ELSE value END AS value FROM {api_docs}"
