"""Whole API documents: attributes, types, older formats, gates, on hand-made documents."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.attributes import attribute_texts, cleaned
from weftline.sources import documents as D
from weftline.sources import gates as W
from weftline.sources import typetree as Y
from weftline.sources import upgrades as J


def parsed(spark, docs):
    """file, doc, format_version of documents by name; texts are taken as they are."""
    rows = [(name, d if isinstance(d, str) else json.dumps(d)) for name, d in docs.items()]
    df = spark.createDataFrame(rows, "file string, value string").withColumn("doc", F.try_parse_json("value"))
    return df.select("file", "doc", F.try_variant_get("doc", "$.format_version", "int").alias("format_version"))


def item(number, inner, **more):
    return {"id": number, "crate_id": 0, "name": f"i{number}", "attrs": [], "inner": inner, **more}


def document(**more):
    root = item(0, {"module": {"is_crate": True, "items": [1]}})
    function = item(1, {"function": {"sig": {"inputs": [], "output": None}, "generics": {"params": [], "where_predicates": []}}})
    return {"format_version": 61, "root": 0, "index": {"0": root, "1": function}, "paths": {"0": {"crate_id": 0, "path": ["fixture"], "kind": "module"}}, "external_crates": {}, **more}


ATTRIBUTES = [
    ('#[attr = Stability {stability: Stability {level: Stable {since: Version(RustcVersion { major: 1, minor: 28, patch: 0 })}, feature: "global_alloc"}}]', '#[stable(feature = "global_alloc", since = "1.28.0")]'),
    ('#[attr = Stability {stability: Stability {level: Unstable {reason: None, issue: 107540}, feature: "btree_cursors"}}]', '#[unstable(feature = "btree_cursors", issue = "107540")]'),
    ("#[attr = Inline(Hint)]", "#[inline]"), ("#[attr = Inline(Always)]", "#[inline(always)]"), ("#[attr = Inline(No)]", None), ("#[attr = Inline(Odd)]", "#[inline]"),
    ("#[attr = CfgAttrTrace]", None), ('#[attr = CfgTrace([All([Not(NameValue { name: "miri" })])])]', None), ('#[attr = AllowInternalUnstable(["liballoc_internals"])]', None), ("#[attr = CfgTraceable]", "#[cfg_traceable]"),
    ("#[allow(deprecated)]", "#[allow(deprecated)]"), ("#[<cfg_trace>(unix)]\n\n  #[<cfg_attr_trace>(x)] ", "#[cfg(unix)] #[cfg_attr(x)]"),
    ('#[attr = MustUse {\n    reason: "a\tb",\n}]', '#[MustUse { reason: "a\tb", }]'), ("#[attr = Optimize(Size)]", "#[optimize(size)]"), ("#[attr = Optimize(None)]", None), ("#[attr = Optimize(Odd)]", "#[optimize(odd)]"),
    ("#[attr = Lang(OwnedBox)]", '#[lang = "owned_box"]'), ('#[attr = RustcDiagnosticItem("Vec")]', '#[rustc_diagnostic_item = "Vec"]'), ("#[attr = NoMangleÄb]", "#[no_mangle_Äb]"), ("#[attr = ]", "#[]"), ("", ""),
    ('#[attr = ConstStability {level: Unstable {reason: Some("a (b) [c]"), issue: None}, feature: "f"}]', '#[unstable(feature = "f", reason = "a (b) [c]")]'), ("#[attr = Stability {level: Stable {}}]", "#[Stability {level: Stable {}}]"), (None, None),
]


def test_attribute_texts(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ATTRIBUTES)], "i int, a string").select("i", cleaned(F.col("a")).alias("text"))
    got = {r.i: r.text for r in df.collect()}
    assert [got[i] for i in range(len(ATTRIBUTES))] == [t for _, t in ATTRIBUTES]


def test_attributes_of_all_forms(spark):
    forms = ["non_exhaustive", {"must_use": {"reason": None}}, {"must_use": {"reason": "why"}}, "macro_export", {"export_name": "e"}, {"link_section": "s"}, "automatically_derived", {"repr": {"kind": "c", "int": "u8", "align": 4, "packed": 1}}, {"repr": {"kind": "transparent", "int": None, "align": None, "packed": None}}, "no_mangle", {"target_feature": {"enable": ["a", "b"]}}, {"other": "#[attr = Inline(No)]"}, {"other": "#[x]"}]
    df = spark.createDataFrame([(json.dumps(forms),)], "a string").select(attribute_texts(F.try_variant_get(F.try_parse_json("a"), "$", "array<variant>")).alias("t"))
    assert df.first().t == [
        "#[non_exhaustive]", "#[must_use]", '#[must_use = "why"]', "#[macro_export]", '#[export_name = "e"]', '#[link_section = "s"]', "#[automatically_derived]", "#[repr(C, u8, align(4), packed(1))]",
        "#[repr(transparent)]", "#[no_mangle]", '#[target_feature(enable = "a", enable = "b")]', "#[x]",
    ]


def test_old_formats_read_alike(spark):
    """One document in every format comes out the same, what the format can't say aside."""
    new = document(external_crates={"1": {"name": "std", "html_root_url": None, "path": "/p"}}, target={"triple": "t", "target_features": []})
    level = {"feature": "f", "level": {"stable": {"since": "1.2.3"}}}
    new["index"]["1"] |= {"attrs": [{"other": "#[a]"}], "stability": level, "const_stability": {"feature": "g", "level": "unstable"}}
    new["index"]["1"]["inner"]["function"]["default_unstable"] = {"feature": "body"}
    docs = {}
    for version in (43, 44, 54, 57, 58, 59, 60, 61):
        d = docs[str(version)] = copy.deepcopy(new)
        d["format_version"], one = version, d["index"]["1"]
        if version < 61:
            one["stability"] = {"feature": "f", "level": "stable", "since": "1.2.3"}
        for before, name in ((58, "stability"), (59, "const_stability")):
            if version < before:
                del one[name]
        if version < 60:
            del one["inner"]["function"]["default_unstable"]
        if version < 57:
            del d["external_crates"]["1"]["path"]
        if version < 54:
            one["attrs"] = ["#[a]"]
        if version < 44:
            del d["target"]
    df = parsed(spark, docs)
    items = {r.file: r for r in J.upgraded_items(df).where("item_id = 1").withColumn("texts", attribute_texts(F.col("attrs"))).collect()}
    for v, r in items.items():
        assert r.texts == ["#[a]"]
        assert r.stability == (("f", "stable", "1.2.3") if int(v) >= 58 else None)
        assert r.const_stability == (("g", "unstable", None) if int(v) >= 59 else None)
        assert r.default_unstable == ("body" if int(v) >= 60 else None)
    assert {r.file: r.path for r in J.packages(df).collect()} == {v: "/p" if int(v) >= 57 else "" for v in docs}
    assert {r.file: r.target_triple for r in J.upgraded_documents(df).collect()} == {v: "t" if int(v) >= 44 else "unknown" for v in docs}


def test_unheard_attributes_are_kept_as_text(spark):
    d = document()
    d["index"]["1"]["attrs"] = [{"brand_new": {"x": 1}}, {"repr": {"kind": "odd"}}, {"must_use": {"reason": 3}}, {"other": "#[x]", "more": 1}, "no_mangle"]
    attrs = J.upgraded_items(parsed(spark, {"f": d})).where("item_id = 1").select(F.transform("attrs", lambda a: F.to_json(a)).alias("a")).first().a
    assert [json.loads(a) for a in attrs] == [{"other": '{"brand_new":{"x":1}}'}, {"other": '{"repr":{"kind":"odd"}}'}, {"other": '{"must_use":{"reason":3}}'}, {"other": '{"more":1,"other":"#[x]"}'}, "no_mangle"]


# ---- types


def path(name, number, args=None):
    return {"path": name, "id": number, "args": args}


def resolved(name, number, args=None):
    return {"resolved_path": path(name, number, args)}


def angled(*args, constraints=()):
    return {"angle_bracketed": {"args": list(args), "constraints": list(constraints)}}


def plain_references(node):
    """The walk, row by row."""
    out = []

    def of_path(p):
        out.append((p["path"].split("::")[-1], str(p["id"])))
        of_args(p["args"])

    def of_args(args):
        if not args:
            return
        if "angle_bracketed" in args:
            for a in args["angle_bracketed"]["args"]:
                if isinstance(a, dict) and "type" in a:
                    of_type(a["type"])
            for c in args["angle_bracketed"]["constraints"]:
                if "equality" in c["binding"]:
                    if "type" in c["binding"]["equality"]:
                        of_type(c["binding"]["equality"]["type"])
                else:
                    for b in c["binding"]["constraint"]:
                        if "trait_bound" in b:
                            of_path(b["trait_bound"]["trait"])
        elif "parenthesized" in args:
            for i in args["parenthesized"]["inputs"]:
                of_type(i)
            if args["parenthesized"]["output"]:
                of_type(args["parenthesized"]["output"])

    def of_type(t):
        if not isinstance(t, dict):
            return
        ((kind, x),) = t.items()
        if kind == "resolved_path":
            of_path(x)
        elif kind == "dyn_trait":
            for y in x["traits"]:
                of_path(y["trait"])
        elif kind in ("borrowed_ref", "raw_pointer", "array", "pat"):
            of_type(x["type"])
        elif kind == "slice":
            of_type(x)
        elif kind == "tuple":
            for y in x:
                of_type(y)
        elif kind == "impl_trait":
            for b in x:
                if "trait_bound" in b:
                    of_path(b["trait_bound"]["trait"])
        elif kind == "qualified_path":
            of_type(x["self_type"])
            if x["trait"]:
                of_path(x["trait"])
            of_args(x["args"])
        elif kind == "function_pointer":
            for _, y in x["sig"]["inputs"]:
                of_type(y)
            if x["sig"]["output"]:
                of_type(x["sig"]["output"])

    of_type(node)
    return out


def random_type(r, depth):
    number, lazy = r.randrange(1000), lambda *choices: r.choice(choices)()
    sub = lambda: random_type(r, depth - 1)

    def bound(d):
        return lazy(lambda: {"outlives": "'a"}, lambda: {"trait_bound": {"trait": path("m::B", r.randrange(1000), args(d - 1)), "generic_params": [], "modifier": "none"}})

    def constraint(d):
        binding = lazy(lambda: {"equality": {"type": sub()}}, lambda: {"equality": {"constant": {"expr": "1"}}}, lambda: {"constraint": [bound(d), bound(d)]})
        return {"name": "N", "args": None, "binding": binding}

    def args(d=depth):
        if d <= 0 or r.random() < 0.3:
            return None
        whole = lambda: angled({"type": sub()}, {"lifetime": "'a"}, "infer", {"type": sub()}, constraints=[constraint(d)])
        return lazy(whole, lambda: {"parenthesized": {"inputs": [sub()], "output": lazy(lambda: None, sub)}}, lambda: "return_type_notation")

    if depth <= 0:
        return r.choice([{"generic": "T"}, {"primitive": "u8"}, "infer", resolved("a::b::C", number)])
    return lazy(
        lambda: resolved("x::Y", number, args()), lambda: {"tuple": [sub(), sub(), sub()]}, lambda: {"slice": sub()}, lambda: {"array": {"type": sub(), "len": "3"}}, lambda: {"pat": {"type": sub()}},
        lambda: {"raw_pointer": {"is_mutable": True, "type": sub()}}, lambda: {"borrowed_ref": {"lifetime": None, "is_mutable": False, "type": sub()}}, lambda: {"impl_trait": [bound(depth), bound(depth)]},
        lambda: {"dyn_trait": {"traits": [{"trait": path("D", number, args()), "generic_params": []}], "lifetime": None}},
        lambda: {"qualified_path": {"name": "I", "args": args(), "self_type": sub(), "trait": lazy(lambda: None, lambda: path("Q", number, args()))}},
        lambda: {"function_pointer": {"sig": {"inputs": [["a", sub()], ["b", sub()]], "output": lazy(lambda: None, sub)}, "generic_params": []}},
    )


def test_references_are_those_of_the_walk(spark):
    r = random.Random(4)
    types = [random_type(r, r.randrange(5)) for _ in range(150)]
    deep = resolved("End", 1)
    for _ in range(20):
        deep = {"borrowed_ref": {"type": {"tuple": [deep, {"primitive": "u8"}]}}}
    types.append(deep)
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(types)], "i int, t string").select("i", F.parse_json("t").alias("type"))
    got = {i: [] for i in range(len(types))}
    for x in Y.resolved_references(df, ["i"]).orderBy("i", "place").collect():
        got[x.i].append((x.display, x.id))
    assert got == {i: plain_references(t) for i, t in enumerate(types)}


def test_generic_argument_constraints_are_linked(spark):
    t = resolved("Iter", 1, angled(constraints=[{"name": "Item", "args": None, "binding": {"equality": {"type": resolved("fixture::Output", 2)}}}]))
    df = spark.createDataFrame([(json.dumps(t),)], "t string").select(F.lit(0).alias("i"), F.parse_json("t").alias("type"))
    assert [(x.display, x.id) for x in Y.resolved_references(df, ["i"]).orderBy("place").collect()] == [("Iter", "1"), ("Output", "2")]


def test_uses_of_items(spark):
    generics = {"params": [{"name": "T", "kind": {"type": {"bounds": [{"trait_bound": {"trait": path("B", 50), "generic_params": []}}], "default": None}}}], "where_predicates": []}
    none = {"params": [], "where_predicates": []}
    d = document()
    d["index"] |= {
        "2": item(2, {"struct": {"kind": {"plain": {"fields": [3]}}, "generics": generics, "impls": [9]}}), "3": item(3, {"struct_field": resolved("F", 51, angled({"type": resolved("G", 2)}))}),
        "4": item(4, {"enum": {"generics": none, "variants": [5, 6, 99]}}), "5": item(5, {"variant": {"kind": {"tuple": [3, None]}, "discriminant": None}}), "6": item(6, {"variant": {"kind": {"struct": {"fields": [7]}}}}),
        "7": item(7, {"struct_field": {"primitive": "u8"}}), "8": item(8, {"impl": {"generics": none, "for": resolved("X", 2), "trait": path("Tr", 52), "blanket_impl": resolved("No", 53), "items": [1]}}),
        "9": item(9, {"trait": {"generics": none, "bounds": [{"trait_bound": {"trait": path("Super", 54), "generic_params": []}}], "items": [1]}}), "10": item(10, {"constant": {"type": resolved("C", 55), "const": {"expr": '"id": 7'}}}),
    }
    got = {(r.owner, r.used) for r in Y.owner_uses(D.items(parsed(spark, {"f": d}))).collect()}
    assert got == {("2", "50"), ("2", "51"), ("4", "51"), ("4", "2"), ("8", "2"), ("8", "52"), ("9", "54"), ("10", "55")}


# ---- gates


def broken(**changes):
    d = document()
    for k, v in changes.items():
        if v is None:
            del d[k]
        else:
            d[k] = v
    return d


BAD = {
    "truncated": ("{", ["not JSON"]), "list": ("[1]", ["not an object"]), "no paths": (broken(paths=None), ["paths: missing"]), "many": (broken(paths=[], index=None, root="x"), ["root: not an unsigned integer", "index: missing", "paths: not an object"]),
    "newer": (broken(format_version=62), ["format_version: 62 is not supported"]), "old": (broken(format_version=34), ["format_version: 34 is not supported"]), "float": (broken(format_version=57.5), ["format_version: not an unsigned integer"]),
    "negative": (broken(root=-1), ["root: not an unsigned integer"]), "large": (broken(root=1 << 33), ["root: out of range"]), "larger": (broken(root=1 << 63), ["root: out of range"]), "empty": (broken(index={}), ["index: empty"]),
    "no root": (broken(root=7), ["root: no item 7"]), "root": (broken(root=1), ["root: item 1 is not a package's module"]),
    "unnamed": (broken(paths={"5": {"crate_id": 3, "path": ["x"], "kind": "struct"}, "12": {"crate_id": 2, "path": ["y"], "kind": "struct"}}, external_crates={"2": {"name": " "}}), ["path 5: package 3 has no name"]),
    "lost": (broken(index={"0": item(0, {"module": {"is_crate": True, "items": [10, 9]}})}), ["module 0: no item 9"]),
    "foreign": (broken(index={"0": item(0, {"module": {"is_crate": True, "items": []}}), "4": item(4, {"module": {"is_crate": False, "items": [9]}}) | {"crate_id": 2}}), []),
    "good": (document(), []), "stub": (broken(paths={"0": {"crate_id": 0, "path": ["fixture"], "kind": "module"}, "8": {"crate_id": 0, "path": ["fixture", "Lost"], "kind": "struct"}}), []),
}


def test_bad_documents_are_put_aside_with_their_reasons(spark):
    docs = parsed(spark, {k: d for k, (d, _) in BAD.items()})
    assert {r.file: r.reasons for r in W.examined(docs).collect()} == {k: reasons for k, (_, reasons) in BAD.items()}
    good, bad = W.divided(docs)
    assert {r.file for r in good.collect()} == {k for k, (_, reasons) in BAD.items() if not reasons} and bad.count() == sum(bool(r) for _, r in BAD.values())


@pytest.mark.parametrize(("strict", "compatible", "refused"), [(True, True, {"34", "62"}), (False, True, {"34"}), (True, False, {"34", "60", "62"})])
def test_format_policies(spark, strict, compatible, refused):
    docs = parsed(spark, {str(v): broken(format_version=v) for v in (34, 60, 61, 62)})
    assert {r.file for r in W.examined(docs, strict, compatible).where("outcome <> 'accepted'").collect()} == refused
