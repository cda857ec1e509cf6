"""Gates for API documents: what is wrong with each, so that bad ones are put aside with all their reasons while good ones go on.

Shape and format are column expressions; structure is joins between a document's items, paths and packages. A document that
isn't well shaped has no structure to look at. Reasons are in the order of the gates, one of each kind, with the least id that
shows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.documents import NEWEST, OLDEST, _exploded

U32, U64 = (1 << 32) - 1, str((1 << 64) - 1)


def _get(path: str, kind: str = "variant", of: str = "doc") -> Column:
    return F.try_variant_get(of, path, kind)


def _is_object(path: str) -> Column:
    """A cast to a struct works for objects alone, and doesn't walk them."""
    return _get(path, "struct<_: string>").isNotNull()


def _object_reason(field: str) -> Column:
    return F.when(_get(f"$.{field}").isNull(), f"{field}: missing").when(~_is_object(f"$.{field}"), f"{field}: not an object")


def _number_reason(field: str) -> Column:
    kind, value = F.schema_of_variant(_get(f"$.{field}")), _get(f"$.{field}", "decimal(38,0)")
    whole = kind.isin("BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    return F.when(_get(f"$.{field}").isNull(), f"{field}: missing").when(~whole | value.isNull() | (value < 0) | (value > F.lit(U64).cast("decimal(38,0)")), f"{field}: not an unsigned integer").when(value > U32, f"{field}: out of range")


def shape_reasons(strict: bool = True, compatible: bool = True) -> Column:
    """Of a parsed ``doc``: reasons of shape and format. strict: newer formats are refused; compatible: older ones are read."""
    version = _get("$.format_version", "long")
    refused = (version < OLDEST) | ((version > NEWEST) & F.lit(strict)) | ((version < NEWEST) & F.lit(not compatible))
    number = _number_reason("format_version")
    inner = F.array(
        F.coalesce(number, F.when(refused, F.concat(F.lit("format_version: "), version.cast("string"), F.lit(" is not supported")))),
        _number_reason("root"), _object_reason("index"), _object_reason("paths"), _object_reason("external_crates"),
    )
    return F.when(F.col("doc").isNull(), F.array(F.lit("not JSON"))).when(~_is_object("$"), F.array(F.lit("not an object"))).otherwise(F.array_compact(inner))


def examined(docs: DataFrame, strict: bool = True, compatible: bool = True) -> DataFrame:
    """file, reasons (empty if the document is good), outcome; docs: file, doc (null: not JSON)."""
    shaped = docs.select("file", "doc", shape_reasons(strict, compatible).alias("shape"))
    bad = shaped.where("size(shape) > 0").select("file", F.posexplode("shape").alias("gate", "reason"))
    good = shaped.where("size(shape) = 0").select("file", "doc")
    found = reduce(DataFrame.unionByName, [bad, *_structure(good)])
    reasons = found.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("gate", "reason"))), lambda x: x["reason"]).alias("reasons"))  # one of each kind
    joined = docs.select("file").join(_shuffled(reasons), "file", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    return joined.withColumn("outcome", F.when(F.size("reasons") == 0, "accepted").otherwise("permanent"))


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows that grow with the documents: their compressed size would have them broadcast through the driver at many times that size."""
    return rows.hint("merge")


def _structure(docs: DataFrame) -> list[DataFrame]:
    """file, gate, reason: documents without items, roots that are no package's module, paths of unnamed packages, lost children."""
    items = _exploded(docs, "index", "item_id", "item")
    ids = items.select("file", "item_id")
    root = docs.select("file", _get("$.root", "string").alias("item_id"))
    is_root = items.select("file", "item_id", F.coalesce(_get("$.inner.module.is_crate", "boolean", "item"), F.lit(False)).alias("is_root"))
    roots = root.join(_shuffled(is_root), ["file", "item_id"], "left")
    filled = ids.select("file").distinct().withColumn("filled", F.lit(True))
    whole = roots.join(_shuffled(filled), "file", "left")
    reason = F.when(F.col("filled").isNull(), "index: empty").when(F.col("is_root").isNull(), F.concat(F.lit("root: no item "), "item_id")).when(~F.col("is_root"), F.concat(F.lit("root: item "), "item_id", F.lit(" is not a package's module")))
    packages = _exploded(docs, "external_crates", "package_no", "package").select("file", "package_no", F.trim(_get("$.name", "string", "package")).alias("name"))
    outer = _exploded(docs, "paths", "item_id", "path").select("file", "item_id", _get("$.crate_id", "string", "path").alias("package_no")).where("package_no <> '0'")
    unnamed = outer.join(_shuffled(packages), ["file", "package_no"], "left").where("name is null or name = ''")
    modules = items.where(_get("$.crate_id", "int", "item") == 0).select("file", F.col("item_id").alias("module"), F.explode(_get("$.inner.module.items", "array<string>", "item")).alias("item_id"))
    lost = modules.join(_shuffled(ids), ["file", "item_id"], "left_anti")
    number = lambda c: F.col(c).try_cast("long")
    return [
        whole.select("file", F.lit(10).alias("gate"), reason.alias("reason")).where("reason is not null"),
        unnamed.groupBy("file").agg(F.min(F.struct(number("item_id"), "item_id", "package_no")).alias("m")).select("file", F.lit(11).alias("gate"), F.concat(F.lit("path "), "m.item_id", F.lit(": package "), "m.package_no", F.lit(" has no name")).alias("reason")),
        lost.groupBy("file").agg(F.min(F.struct(number("module"), number("item_id"), "module", "item_id")).alias("m")).select("file", F.lit(12).alias("gate"), F.concat(F.lit("module "), "m.module", F.lit(": no item "), "m.item_id").alias("reason")),
    ]


def divided(docs: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The good documents, and the file, reasons and outcome of the others."""
    found = examined(docs, strict)
    return docs.join(found.where("outcome = 'accepted'").select("file"), "file", "left_semi"), found.where("outcome <> 'accepted'")
