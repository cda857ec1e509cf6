"""API documents: one JSON object for each package version, exploded into items, paths and packages as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OLDEST, NEWEST = 35, 61


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, doc: each file whole; null where it isn't JSON."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))


def gate(docs: DataFrame, strict: bool = True) -> DataFrame:
    """docs with format_version and outcome: permanent errors of shape and format, else accepted."""
    version, root = F.try_variant_get("doc", "$.format_version", "int"), F.try_variant_get("doc", "$.root", "string")
    shape = F.expr("try_variant_get(doc, '$.index', 'variant') is not null and try_variant_get(doc, '$.paths', 'variant') is not null and try_variant_get(doc, '$.external_crates', 'variant') is not null")
    outcome = (
        F.when(F.col("doc").isNull(), "permanent: not JSON")
        .when(version.isNull() | root.isNull() | ~shape, "permanent: shape")
        .when(version < OLDEST, "permanent: format too old")
        .when((version > NEWEST) & F.lit(strict), "permanent: format too new")
        .otherwise("accepted")
    )
    return docs.withColumns({"format_version": version, "root": root, "outcome": outcome})


def items(docs: DataFrame) -> DataFrame:
    """file, item_id, item of every entry of the index."""
    return _exploded(docs, "index", "item_id", "item")


def _exploded(docs: DataFrame, part: str, key: str, value: str, extra: str = "file") -> DataFrame:
    more = "" if extra == "file" else f", {extra}"
    return docs.sparkSession.sql(
        f"SELECT file{more}, v.key AS {key}, v.value AS {value} FROM {{docs}}, LATERAL variant_explode(variant_get(doc, '$.{part}', 'variant')) AS v", docs=docs
    )


def paths(docs: DataFrame) -> DataFrame:
    """file, item_id, path (array), kind, package number of every path summary."""
    raw = _exploded(docs, "paths", "item_id", "p")
    return raw.select("file", "item_id", F.try_variant_get("p", "$.path", "array<string>").alias("path"), F.try_variant_get("p", "$.kind", "string").alias("kind"), F.try_variant_get("p", "$.crate_id", "int").alias("package_no"))


def item_nodes(found: DataFrame) -> DataFrame:
    """The plain fields of items, and the arm of their tagged union."""
    get = lambda p, kind: F.try_variant_get("item", p, kind)
    return found.select(
        "file", "item_id", get("$.name", "string").alias("name"), get("$.docs", "string").alias("docs"),
        get("$.visibility", "string").alias("visibility"), F.get(F.map_keys(F.from_json(F.to_json(get("$.inner", "variant")), "map<string,string>")), F.lit(0)).alias("kind"),
    )


def children(found: DataFrame) -> DataFrame:
    """file, parent, child, place of every module's items."""
    listed = found.select("file", F.col("item_id").alias("parent"), F.posexplode(F.try_variant_get("item", "$.inner.module.items", "array<string>")).alias("place", "child"))
    return listed


def type_ids(item: Column, part: str) -> Column:
    """Every id below a part of an item, as text: quotes inside JSON strings are escaped, so no text can look like a key."""
    return F.array_distinct(F.regexp_extract_all(F.to_json(F.try_variant_get(item, part, "variant")), F.lit(r'"id":\s*"?(\d+)'), 1))


def type_uses(found: DataFrame, part: str = "$.inner.function.sig") -> DataFrame:
    """file, owner, used: the distinct types that a signature names, not the owner itself."""
    used = found.select("file", F.col("item_id").alias("owner"), F.explode(type_ids(F.col("item"), part)).alias("used"))
    return used.where("owner <> used")


def dangling_children(found: DataFrame) -> DataFrame:
    """Children that no item is: a structural error of the document."""
    return children(found).join(found.select("file", F.col("item_id").alias("child")), ["file", "child"], "left_anti")
