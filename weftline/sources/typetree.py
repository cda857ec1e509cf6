"""Type expressions inside API documents: which items an item's types name, and the references of a type in the order they are shown.

A type is a VARIANT tree without bound. What an item uses is a set, so every id below the chosen parts is taken from their text at
once. References need the tree: each round of a descent turns the types, paths and arguments that the round before reached
into their children, with the place of each, for all documents together; rounds are as many as the deepest nesting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import staged
from weftline.sources.documents import type_ids

#: Where an item's own types stand, by kind. An impl's members and blanket type aren't its own.
PARTS = {
    "struct": ("generics",), "union": ("generics",), "enum": ("generics",), "trait": ("generics", "bounds"), "trait_alias": ("generics", "params"),
    "type_alias": ("type", "generics"), "function": ("sig", "generics"), "impl": ("generics", "for", "trait"), "constant": ("type",), "static": ("type",),
}
#: Where items list fields, and variants of enums list theirs.
FIELDS = ("$.inner.struct.kind.plain.fields", "$.inner.struct.kind.tuple", "$.inner.union.fields")
VARIANT_FIELDS = ("$.inner.variant.kind.struct.fields", "$.inner.variant.kind.tuple")


def _lists(found: DataFrame, paths: tuple[str, ...], name: str) -> DataFrame:
    """file, owner, name: ids in the lists at these paths; a field that isn't shown is null and left out."""
    lists = [F.coalesce(F.try_variant_get("item", p, "array<string>"), F.array()) for p in paths]
    return found.select("file", F.col("item_id").alias("owner"), F.explode(F.flatten(F.array(*lists))).alias(name)).where(f"{name} is not null")


def owner_uses(found: DataFrame) -> DataFrame:
    """file, owner, used: the distinct items that the types of an item name (its generics, bounds, signature, fields, fields of its
    variants, aliased or constant type, what an impl is for), not the item itself. found: file, item_id, item."""
    ids = F.flatten(F.array(*[F.coalesce(type_ids(F.col("item"), f"$.inner.{kind}.{part}"), F.array()) for kind, parts in PARTS.items() for part in parts]))
    direct = found.select("file", F.col("item_id").alias("owner"), F.explode(F.array_distinct(ids)).alias("used"))
    items = found.select("file", F.col("item_id").alias("field"), type_ids(F.col("item"), "$.inner.struct_field").alias("types")).where("size(types) > 0")
    variants = _lists(found, ("$.inner.enum.variants",), "variant").join(_lists(found, VARIANT_FIELDS, "field").withColumnRenamed("owner", "variant"), ["file", "variant"]).drop("variant")
    held = _lists(found, FIELDS, "field").unionByName(variants)
    by_field = held.join(items, ["file", "field"]).select("file", "owner", F.explode("types").alias("used"))
    return direct.unionByName(by_field).where("owner <> used").distinct()


def _get(path: str, of: str = "value", kind: str = "variant") -> str:
    return f"try_variant_get({of}, '{path}', '{kind}')"


def _node(kind: str, value: str) -> str:
    return f"named_struct('kind', '{kind}', 'value', {value})"


def _one(kind: str, path: str) -> str:
    return f"array({_node(kind, _get(path))})"


def _many(kind: str, path: str, inner: str = "$") -> str:
    return f"coalesce(transform({_get(path, kind='array<variant>')}, x -> {_node(kind, _get(inner, 'x'))}), array())"


def _arguments(below: str) -> list[str]:
    """Children of generic arguments: types, then what associated items are equal to or bound by; or inputs, then the output."""
    bound = f"transform({_get('$.binding.constraint', 'c', 'array<variant>')}, b -> {_node('path', _get('$.trait_bound.trait', 'b'))})"
    constraint = f"concat(array({_node('type', _get('$.binding.equality.type', 'c'))}), coalesce({bound}, array()))"
    constraints = f"coalesce(flatten(transform({_get(below + '.angle_bracketed.constraints', kind='array<variant>')}, c -> {constraint})), array())"
    return [_many("type", below + ".angle_bracketed.args", "$.type"), constraints, _many("type", below + ".parenthesized.inputs"), _one("type", below + ".parenthesized.output")]


#: Children of a type and of a path in the order they are shown. Generic parameters of bounds and arguments of constraints aren't shown.
_CHILDREN = {
    "type": [
        _one("path", "$.resolved_path"), _many("path", "$.dyn_trait.traits", "$.trait"), _one("type", "$.borrowed_ref.type"), _one("type", "$.raw_pointer.type"),
        _one("type", "$.slice"), _many("type", "$.tuple"), _one("type", "$.array.type"), _many("path", "$.impl_trait", "$.trait_bound.trait"),
        _one("type", "$.qualified_path.self_type"), _one("path", "$.qualified_path.trait"), *_arguments("$.qualified_path.args"),
        _many("type", "$.function_pointer.sig.inputs", "$[1]"), _one("type", "$.function_pointer.sig.output"), _one("type", "$.pat.type"),
    ],
    "path": _arguments("$.args"),
}


def _children() -> Column:
    parts = {kind: f"filter(flatten(array({', '.join(lists)})), c -> c.value is not null and not is_variant_null(c.value))" for kind, lists in _CHILDREN.items()}
    return F.expr(f"CASE kind WHEN 'type' THEN {parts['type']} ELSE {parts['path']} END")


def resolved_references(types: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, display, id: every named type in a type, numbered in the order shown; display is the last segment of its path.
    types: keys and a VARIANT type."""
    frontier = staged(types.select(*keys, F.array().cast("array<int>").alias("place"), F.lit("type").alias("kind"), F.col("type").alias("value")), "types")
    reached = []
    while not frontier.isEmpty():
        reached.append(frontier.where("kind = 'path'").select(*keys, "place", F.expr(_get("$.path", kind="string")).alias("path"), F.expr(_get("$.id", kind="string")).alias("id")))
        below = frontier.select(*keys, "place", F.posexplode(_children()).alias("at", "child"))
        frontier = staged(below.select(*keys, F.concat("place", F.array("at")).alias("place"), "child.kind", "child.value"), "types")
    if not reached:
        reached = [frontier.select(*keys, "place", F.lit("").alias("path"), F.lit("").alias("id"))]
    found = reduce(DataFrame.unionByName, reached).where("id is not null")
    own = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "path", "id"))).alias("refs"))  # one type's references
    numbered = own.select(*keys, F.posexplode("refs").alias("place", "ref"))
    return numbered.select(*keys, "place", F.element_at(F.split("ref.path", "::"), -1).alias("display"), "ref.id")
