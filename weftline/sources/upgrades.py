"""Documents of older formats read as the newest: column expressions that each row's own format version switches.

Every fix is one expression over all rows; a table may mix versions, and is read once. What a fix adds is what newer documents
say when they have nothing to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.attributes import REPRESENTATIONS
from weftline.sources.documents import _exploded

#: The first versions with a target, structured attributes, paths of packages, nested levels. Stabilities (58, 59) and those
#: of default bodies (60) are null where a document has none, so they need no switch.
TARGET, ATTRIBUTES, PACKAGE_PATH, NESTED_LEVEL = 44, 54, 57, 61


def _get(of: str, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(of, path, kind)


def upgraded_documents(docs: DataFrame) -> DataFrame:
    """docs (with doc, format_version) with target_triple and target_features; before version 44 none were said."""
    old = F.col("format_version") < TARGET
    return docs.withColumns({
        "target_triple": F.coalesce(_get("doc", "$.target.triple", "string"), F.when(old, "unknown")),
        "target_features": F.coalesce(_get("doc", "$.target.target_features", "array<variant>"), F.when(old, F.array().cast("array<variant>"))),
    })


def packages(docs: DataFrame) -> DataFrame:
    """file, package_no, name, root_url, path of every package that a document names; before version 57 paths weren't said, and are ''."""
    found = _exploded(docs, "external_crates", "package_no", "package", extra="format_version")
    path = F.coalesce(_get("package", "$.path", "string"), F.when(F.col("format_version") < PACKAGE_PATH, ""))
    return found.select("file", F.col("package_no").cast("int").alias("package_no"), _get("package", "$.name", "string").alias("name"), _get("package", "$.html_root_url", "string").alias("root_url"), path.alias("path"))


def _known(attribute: Column) -> Column:
    """Whether an object is an attribute of the newest format."""
    get = lambda path, kind: F.try_variant_get(attribute, path, kind)
    one = F.size(F.map_keys(F.try_variant_get(attribute, "$", "map<string,variant>"))) == 1
    is_kind = lambda path, kind: F.coalesce(F.schema_of_variant(get(path, "variant")).startswith(kind), F.lit(False))
    shaped = (
        is_kind("$.other", "STRING") | is_kind("$.export_name", "STRING") | is_kind("$.link_section", "STRING")
        | (is_kind("$.must_use", "OBJECT") & ~is_kind("$.must_use.reason", "OBJECT") & ~is_kind("$.must_use.reason", "ARRAY") & ~is_kind("$.must_use.reason", "BIGINT"))
        | F.coalesce(get("$.repr.kind", "string").isin(*REPRESENTATIONS), F.lit(False)) | is_kind("$.target_feature.enable", "ARRAY<STRING>")
    )
    return F.coalesce(one & shaped, F.lit(False))


def _attribute(attribute: Column, version: Column) -> Column:
    """Before version 54 attributes were texts; whatever isn't an attribute of the newest format is kept as its JSON text."""
    other = lambda text: F.to_variant_object(F.struct(text.alias("other")))
    text = F.when(F.schema_of_variant(attribute) == "STRING", F.try_variant_get(attribute, "$", "string"))
    return F.when(text.isNotNull() & (version < ATTRIBUTES), other(text)).when(text.isNotNull() | _known(attribute), attribute).otherwise(other(F.to_json(attribute)))


def _stability(name: str, version: Column) -> Column:
    """feature, level, since; before version 61 ``since`` stood beside a plain level, since then inside it."""
    level = _get("item", f"$.{name}.level", "variant")
    plain = F.when(F.schema_of_variant(level) == "STRING", F.try_variant_get(level, "$", "string"))
    nested = F.try_variant_get(level, "$.stable", "variant").isNotNull()
    shown = F.when(nested, "stable").when((plain != "stable") | (version < NESTED_LEVEL), plain)
    since = F.when(nested, F.try_variant_get(level, "$.stable.since", "string")).when((plain == "stable") & (version < NESTED_LEVEL), _get("item", f"$.{name}.since", "string"))
    feature = _get("item", f"$.{name}.feature", "string")
    return F.when(feature.isNotNull(), F.struct(feature.alias("feature"), shown.alias("level"), since.alias("since")))


def upgraded_items(docs: DataFrame) -> DataFrame:
    """file, item_id, item, attrs (array of VARIANT), stability, const_stability (feature, level, since), default_unstable (the feature that
    a default body needs) of every item; docs: file, doc, format_version."""
    version = F.col("format_version")
    found = _exploded(docs, "index", "item_id", "item", extra="format_version")
    attributes = F.transform(F.coalesce(_get("item", "$.attrs", "array<variant>"), F.array().cast("array<variant>")), lambda a: _attribute(a, version))
    bodies = [_get("item", f"$.inner.{kind}.default_unstable.feature", "string") for kind in ("function", "assoc_const", "assoc_type")]
    return found.select("file", "item_id", "item", attributes.alias("attrs"), _stability("stability", version).alias("stability"), _stability("const_stability", version).alias("const_stability"), F.coalesce(*bodies).alias("default_unstable"))
